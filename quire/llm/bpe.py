"""Byte-level BPE over whole texts.

The pre-tokenizer's pattern cuts a text into pre-tokens, each of which is encoded alike wherever it occurs. So a text costs one
scan and one dictionary lookup a pre-token; the merges run once for each distinct pre-token in a
bounded cache. Characters whose class differs between versions of Unicode are left to the tokenizer's own
scanner; a text is cut for that before single spaces between characters that aren't white space,
which the pattern never joins.

Long texts take tree concatenation instead: pieces of fixed length, cut
anywhere, are encoded on their own, then joined level by level of a tree; those of very long
texts are encoded by different tasks and joined by others. A
join encodes a window around the seam anew and doubles it until both sides agree on it
(``join``). The result is that of encoding the whole text.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, small_batches, text_of

#: The white space of the pre-tokenizer's pattern: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
#: Below this, all versions of Unicode agree on the classes of characters.
_SETTLED = 0x530
_ODD = re.compile(f"[^\0-{chr(_SETTLED - 1)}]")
#: Pre-tokens longer than this are not cached.
_CACHED_CHARS = 64
#: Characters of a piece; a text of more is encoded in pieces.
PIECE_CHARS = 16_384
#: Full pieces beyond which those of a text go to many tasks; the tree of fewer is built where the text is.
SPREAD = 4


def _scanner() -> re.Pattern:
    """The pattern for settled characters; any other one comes out alone."""
    spaces = re.compile(f"[{SPACE}]")
    of: dict[str, list[str]] = {"L": [], "N": [], "": []}
    for c in map(chr, range(_SETTLED)):
        if not spaces.match(c):
            kind = unicodedata.category(c)[0]
            of[kind if kind in "LN" else ""].append(re.escape(c))
    letters, numbers, others = ("".join(of[k]) for k in ("L", "N", ""))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[{others}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+|[^{SPACE}]")


_SCAN = _scanner()


class _Unsettled(Exception):
    """A pre-token for the tokenizer's own scanner."""


class Cache(dict):
    """Pre-token -> what ``make`` gives for it; bounded, of two generations."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            if ord(piece[-1]) >= _SETTLED:
                raise _Unsettled
            value = self.make(piece)
            if len(piece) > _CACHED_CHARS:
                return value
        return self.keep(piece, value)

    def keep(self, piece: str, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


def _shown() -> dict[int, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer file, for one Python process."""

    def __init__(self, path: str, cache: int = 100_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", ())):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        #: The printable stand-in of each byte in this kind of vocabulary.
        self._shown = _shown()
        self._byte = {c: b for b, c in self._shown.items()}
        size = max(self.tokenizer.get_vocab(True).values()) + 1
        self.token_bytes = [b""] * size
        for token, i in self.tokenizer.get_vocab(True).items():
            self.token_bytes[i] = token.encode() if token in self.specials else bytes(self._byte[ord(c)] for c in token)
        self._core = self._merger(spec["model"])
        self._cache = Cache(self._make, cache)
        self._wide: dict[str, bytes] = {}  # apart: in the cache they would pass for settled

    def _merger(self, model: dict):
        """A faster merger of the same ranks, or None where the ids don't follow the merges' order."""
        merges = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
        vocab = model["vocab"]
        if len(vocab) != 256 + len(merges) or any(vocab.get(x.replace(" ", "")) != 256 + i for i, x in enumerate(merges)):
            return None
        import tiktoken

        ranks = {self.token_bytes[i]: i for i in vocab.values()}
        core = tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        # it takes a whole piece that is in the vocabulary as one token, which must be what the merges give
        return core if all(self._library(b) == _packed([i]) for b, i in ranks.items()) else None

    # whole texts

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self._special is not None and any(s in text for s in self.specials):
            parts = self._special.split(text)
            return b"".join(_packed([self.specials[x]]) if i % 2 else self._plain(x) for i, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        try:
            return b"".join(map(self._cache.__getitem__, _SCAN.findall(text)))
        except _Unsettled:
            return b"".join(map(self.pre_token, self.pre_tokens(text)))

    def _make(self, piece: str) -> bytes:
        return self.merge(piece.encode())

    def pre_tokens(self, text: str) -> list[str]:
        """What the tokenizer's pattern makes of ``text``, whatever its characters."""
        if not _ODD.search(text):
            return _SCAN.findall(text)
        found: list[str] = []
        for i, part in enumerate(_CUT.split(text)):
            part = " " + part if i else part
            if not part:
                continue
            if not _ODD.search(part):
                found += _SCAN.findall(part)
            else:
                found += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return found

    def pre_token(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        found = self._wide.get(piece)
        if found is None:
            found = self.merge(piece.encode())
            if len(piece) <= _CACHED_CHARS:
                if len(self._wide) >= 50_000:
                    self._wide.clear()
                self._wide[piece] = found
        return found

    def merge(self, data: bytes) -> bytes:
        """The merges of the vocabulary over bytes that no pre-token boundary divides."""
        if self._core is not None and data:
            return _packed(self._core.encode_single_piece(data))
        return self._library(data)

    def _library(self, data: bytes) -> bytes:
        shown = data.decode("latin-1").translate(self._shown)
        return _packed([t.id for t in self.tokenizer.model.tokenize(shown)])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")

    # pieces of long texts

    def runs(self, text: str) -> list[str]:
        """What special strings divide, and at odd places these strings."""
        return self._special.split(text) if self._special is not None else [text]

    def encode_tree(self, text: str, piece_chars: int) -> bytes:
        """The ids of ``text`` by tree concatenation of pieces."""
        out = []
        for i, part in enumerate(self.runs(text)):
            if i % 2:
                out.append(_packed([self.specials[part]]))
            elif part:
                out.append(join_all(self, [self.encode_piece(part[at : at + piece_chars]) for at in range(0, len(part), piece_chars)]).ids)
        return b"".join(out)

    def encode_piece(self, text: str) -> Piece:
        try:
            pres = _SCAN.findall(text)
            packed = list(map(self._cache.__getitem__, pres))
        except _Unsettled:
            pres = self.pre_tokens(text)
            packed = [self.pre_token(p) for p in pres]
        return Piece.of(text, [len(p) for p in pres], [len(p) // 4 for p in packed], b"".join(packed))


#: The pattern that splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters before a cut that the pattern may still look at: of a contraction and the one after a run.
_AHEAD = 4


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Piece:
    """A piece of text with its pre-tokens' first characters, the ids before each of them, and the ids."""

    def __init__(self, text: str, starts: np.ndarray, before: np.ndarray, ids: bytes):
        self.text, self.starts, self.before, self.ids = text, starts, before, ids

    @classmethod
    def of(cls, text: str, lengths, counts, ids: bytes) -> Piece:
        """From the characters and the ids of each pre-token."""
        starts, before = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (lengths, counts))
        return cls(text, starts[:-1], before, ids)

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.text))

    def begins(self, at: int) -> bool:
        """Whether a pre-token begins at this character."""
        i = int(self.starts.searchsorted(at))
        return i < len(self.starts) and int(self.starts[i]) == at


def join(enc: Encoder, left: Piece, right: Piece, window: int = 64) -> Piece:
    """The encoding of ``left.text + right.text``, as if it had been encoded whole.

    Left of its last boundary which lies ``_AHEAD`` characters before the seam, nothing that follows can
    change the left side. From there the pattern runs over a window that reaches into the right side; it
    doubles until one of its boundaries is one of the right side's too, after which both go on alike.
    A pre-token across the seam is merged anew in ``_join_merges``.
    """
    if not left.text or not right.text:
        return right if not left.text else left
    at = max(0, bisect_left(left.starts, len(left.text) - _AHEAD + 1) - 1)
    begin = int(left.starts[at])
    tail = left.text[begin:]
    while True:
        whole = window >= len(right.text)
        pres = enc.pre_tokens(tail + right.text[:window])
        end, met = 0, None
        for i, p in enumerate(pres):
            if end >= len(tail) and right.begins(end - len(tail)) and (whole or end <= len(tail) + window - _AHEAD):
                met = i
                break
            end += len(p)
        if met is None and whole:
            met = len(pres)
        if met is not None:
            break
        window *= 2
    pres = pres[:met]
    over = sum(map(len, pres)) - len(tail)
    to = int(bisect_left(right.starts, over))
    packed, pos = [], 0
    for p in pres:
        seam = len(tail) - pos
        if 0 < seam < len(p) and len(p) > 4 * _CACHED_CHARS and at + 1 < len(left.before):
            packed.append(_across(enc, left, right, begin + pos, p, seam))
        else:
            packed.append(enc.pre_token(p))
        pos += len(p)
    starts = np.concatenate([left.starts[:at], begin + np.cumsum([0, *map(len, pres)])[:-1], right.starts[to:] + len(left.text)]).astype(np.int64)
    ids = left.ids[: 4 * int(left.before[at])] + b"".join(packed) + right.ids[4 * int(right.before[to]) :]
    mid = left.before[at] + np.cumsum([0, *(len(p) // 4 for p in packed)])
    before = np.concatenate([left.before[:at], mid[:-1], right.before[to:] - right.before[to] + mid[-1]]).astype(np.int64)
    return Piece(left.text + right.text, starts, before, ids)


def _across(enc: Encoder, left: Piece, right: Piece, start: int, pre: str, seam: int) -> bytes:
    """A long pre-token of which each side has encoded a part as one pre-token of its own."""
    i = int(bisect_left(left.starts, start))
    exact = i == len(left.starts) - 1 and int(left.starts[i]) == start
    rest = len(pre) - seam
    exact = exact and (int(right.starts[1]) if len(right.starts) > 1 else len(right.text)) == rest
    if not exact:
        return enc.merge(pre.encode())
    return join_merges(enc, left.ids[4 * int(left.before[i]) :], right.ids[: 4 * int(right.before[1])])


def join_merges(enc: Encoder, left: bytes, right: bytes, window: int = 8) -> bytes:
    """The merges over two byte strings put together, from the ids of each.

    A row of tokens is what the merges give if every two neighbours are what the merges give
    for the two alone. So a window of tokens around the seam, merged anew, may
    replace them once its first token is the left side's there and its last is the right side's.
    """
    a, b = array("I", left), array("I", right)
    while True:
        la, lb = min(window, len(a)), min(window, len(b))
        head, tail = a[len(a) - la :], b[:lb]
        new = array("I", enc.merge(b"".join(map(enc.token_bytes.__getitem__, (*head, *tail)))))
        left_agrees = la == len(a) or (len(new) > 1 and new[:2] == head[:2])
        right_agrees = lb == len(b) or (len(new) > 1 and new[-2:] == tail[-2:])
        if left_agrees and right_agrees:
            return (a[: len(a) - la] + new + b[lb:]).tobytes()
        window *= 2


def join_all(enc: Encoder, row: list[Piece]) -> Piece:
    """Joins neighbours two by two, level by level."""
    while len(row) > 1:
        row = [join(enc, *row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Adds the ids of each whole text as little-endian unsigned 32-bit integers in a binary column.

    A null text counts as empty and has no ids. A column already called ``ids`` is replaced; all others, and repeated
    rows, stay as they are; an empty table gives an empty table. Texts of more than ``piece_chars`` characters are encoded in pieces; of more than
    ``SPREAD`` times as many, once for each distinct text and over many tasks, so that one long text doesn't hold up a partition.
    The tokenizer's special strings inside texts become their special ids, as is its default.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def short(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for batch in texts:
            yield pa.array([enc.encode(x) if len(x) <= piece_chars else enc.encode_tree(x, piece_chars) for x in batch.to_pylist()], pa.binary())

    kept = [c for c in df.columns if c.lower() != ids.lower() or c == text]
    whole = df.select(*[F.col(f"`{c}`") for c in kept])
    longest = whole.agg(F.max(F.length(text_of(text)))).first()[0] or 0
    is_long = F.length(text_of(text)) > SPREAD * piece_chars
    fast = whole.filter(~is_long).withColumn(ids, short(text_of(text)))
    if longest <= SPREAD * piece_chars:
        return fast
    key, got = free_name(df, "quire_key"), free_name(df, "quire_ids")
    slow = whole.filter(is_long).withColumn(key, F.sha2(text_of(text), 256))
    done = encode_long(slow.select(F.col(key).alias("key"), text_of(text).alias("text")).dropDuplicates(["key"]), tokenizer, longest, piece_chars)
    slow = slow.join(done.withColumnRenamed("key", key).withColumnRenamed("ids", got), key).withColumn(ids, F.col(got)).drop(key, got)
    return fast.unionByName(slow.select(*fast.columns))


#: Pieces that one task joins to one, at each level of the tree.
FAN = 8
#: A piece between tasks: of each pre-token the characters and the number of ids; the text is what the ids spell.
_PIECE = "key string, run int, no int, lengths binary, counts binary, ids binary"


def encode_long(df: DataFrame, tokenizer: str, longest: int, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(key, text) with one row a key, of ``longest`` characters at most -> (key, ids), by tree concatenation.

    A text's runs between special strings are cut into pieces, which go to many tasks; at each level of the tree, ``FAN`` neighbours are joined by one task.
    """

    names = ["key", "run", "no", "lengths", "counts", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[tuple[str, int, int, bool, str]] = []
            for key, text in zip(b["key"].to_pylist(), b["text"].to_pylist()):
                for run, part in enumerate(enc.runs(text)):
                    rows += [(key, run, no, run % 2 == 1, part[at : at + piece_chars]) for no, at in enumerate(range(0, len(part), len(part) if run % 2 else piece_chars))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))], names=["key", "run", "no", "special", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            done = [Piece.of(t, [len(t)], [1], _packed([enc.specials[t]])) if special else enc.encode_piece(t) for t, special in zip(b["text"].to_pylist(), b["special"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["key"], b["run"], b["no"], *_columns(done)], names=names)

    def merge(group: pa.Table) -> pa.Table:
        if len(group) > 1:
            enc = encoder(tokenizer)
            group = group.sort_by("no")
            row = [Piece.of(enc.decode(ids), _unpacked(n), _unpacked(k), ids) for n, k, ids in zip(*(group[c].to_pylist() for c in names[3:]))]
            parts = _columns([join_all(enc, row)])
        else:
            parts = [group[c] for c in names[3:]]
        return pa.table([group["key"][:1], group["run"][:1], pa.array([group["no"][0].as_py() // FAN], pa.int32()), *parts], names=names)

    def gather(group: pa.Table) -> pa.Table:
        return pa.table({"key": group["key"][:1], "ids": pa.array([b"".join(group.sort_by("run")["ids"].to_pylist())], pa.binary())})

    # by place as well as key, so that the pieces of one text go to many tasks
    parts = df.mapInArrow(cut, "key string, run int, no int, special boolean, text string").repartition("key", "run", "no")
    level, n = parts.mapInArrow(leaves, _PIECE), -(-longest // piece_chars)
    while n > 1:
        level, n = level.groupBy("key", "run", F.expr(f"no div {FAN}")).applyInArrow(merge, _PIECE), -(-n // FAN)
    return level.select("key", "run", "ids").groupBy("key").applyInArrow(gather, "key string, ids binary")


def _columns(done: list[Piece]) -> list[pa.Array]:
    return [pa.array(x, pa.binary()) for x in ([_narrow(p.lengths()) for p in done], [_narrow(np.diff(p.before)) for p in done], [p.ids for p in done])]


def _narrow(values: np.ndarray) -> bytes:
    """The values in the fewest bytes each that hold them all, after a byte that says how many."""
    found = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([found.itemsize]) + found.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


@lru_cache(maxsize=2)
def _bytes_of_tokens(path: str) -> list[bytes]:
    """Each id's bytes, from the file alone: what decodes needs no merges."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    known = spec["model"]["vocab"] | specials
    byte = {c: b for b, c in _shown().items()}
    out = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        out[i] = token.encode() if token in specials else bytes(byte[ord(c)] for c in token)
    return out


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each row's packed ids; special tokens stay visible; null or no ids give the empty text; all rows and other columns stay."""
    small_batches(df.sparkSession)

    @F.arrow_udf(T.StringType())
    def run(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _bytes_of_tokens(tokenizer).__getitem__
        for batch in packed:
            yield pa.array([b"".join(map(token, array("I", x or b""))).decode("utf-8", "replace") for x in batch.to_pylist()], pa.string())

    return df.withColumn(text, run(F.col(ids)))
