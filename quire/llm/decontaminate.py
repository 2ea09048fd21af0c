"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike, on UTF-8 bytes: A-Z becomes a-z, every other ASCII character but digits and letters
ends a word. An item's windows of consecutive words are the automaton's patterns; a document
is scanned once for all of them, and what is found is mapped back to words and to characters of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, small_batches, text_of

_ASCII = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of pattern text that one automaton may hold; beyond, the items go in several.
BLOCK_BYTES = 16 << 20
_automata: dict[int, object] = {}

HITS = "struct<n_words:long,runs:array<struct<first:int,last:int>>,items:array<string>>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(_ASCII).split()


def windows(text: str, size: int) -> list[bytes]:
    """The patterns of an item: its windows of ``size`` words; all of it, if it has fewer but any."""
    w = words(text)
    return list({b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))}) if w else []


class Automaton:
    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        found: dict[bytes, set[str]] = {}
        for item, text in items:
            for p in windows(text, size):
                found.setdefault(p, set()).add(item)
        self.machine = ahocorasick.Automaton() if found else None
        for p, of in found.items():
            self.machine.add_word(p.decode("latin-1"), (len(p), p.count(b" ") - 1, tuple(sorted(of))))
        if found:
            self.machine.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text; runs of hit words, first and last; the items found."""
        w = words(text)
        if not w or self.machine is None:
            return len(w), [], set()
        line = b" " + b" ".join(w) + b" "
        found, items = [], set()
        ends = None
        for end, (n, k, of) in self.machine.iter(line.decode("latin-1")):
            if ends is None:
                ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            first = int(np.searchsorted(ends, end - n + 1))
            items.update(of)
            found.append((first, first + k - 1))
        return len(w), merged(found), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automaton(of, size: int) -> Automaton:
    if of.id not in _automata:
        while len(_automata) >= 2:
            _automata.pop(next(iter(_automata)))
        _automata[of.id] = Automaton(of.value[1], size)
    return _automata[of.id]


class _Block:
    """A broadcast with a number of its own, to know its automaton by."""

    def __init__(self, spark, items):
        import uuid

        self.id, self._bc = uuid.uuid4().int, spark.sparkContext.broadcast((0, items))

    @property
    def value(self):
        return self._bc.value


def scan(df: DataFrame, items: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``out``: the words of each text, the runs of words inside any window of an item, and the items found.

    A null or empty text has no words; an item without words is never found; a null item counts under the empty name; equal items
    are one. Other columns and repeated rows stay, a column called ``out`` is replaced. With no items, nothing is hit. No shuffle:
    the patterns are broadcast, ``block_bytes`` of them at a time after their size was summed, each block
    with a scan of its own that adds to what those before it found.
    """
    spark = df.sparkSession
    small_batches(spark)
    named = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), text_of(item_text).alias("text")).distinct()
    total = named.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-total * size // block_bytes))
    result = df.withColumn(out, F.lit(None).cast(HITS))
    for b in range(blocks):
        part = named if blocks == 1 else named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        block = _Block(spark, [(r.item, r.text) for r in part.collect()])
        result = result.withColumn(out, _scanner(block, size)(F.col(text), F.col(out)))
    return result


def _scanner(block: _Block, size: int):
    @F.arrow_udf(HITS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = _automaton(block, size)
        for texts, before in batches:
            rows = []
            for t, old in zip(texts.to_pylist(), before.to_pylist()):
                n, runs, names = machine.scan(t or "")
                if old is not None:
                    runs = merged(runs + [(r["first"], r["last"]) for r in old["runs"]])
                    names |= set(old["items"])
                rows.append({"n_words": n, "runs": [{"first": a, "last": z} for a, z in runs], "items": sorted(names)})
            yield pa.array(rows, pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))]))

    return run


def spans(df: DataFrame, text: str = "text", hits: str = "hits", out: str = "hit_spans") -> DataFrame:
    """Adds the hit runs as first and past-the-end characters of the original text."""
    small_batches(df.sparkSession)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            rows = []
            for t, h in zip(texts.to_pylist(), found.to_pylist()):
                at = [m.span() for m in _WORD.finditer((t or "").lower() if (t or "").isascii() else _lower(t))] if h and h["runs"] else []
                rows.append([{"start": at[r["first"]][0], "end": at[r["last"]][1]} for r in h["runs"]] if at else [])
            yield pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return df.withColumn(out, run(F.col(text), F.col(hits)))


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    return text.translate(_LOWER)


def clean(df: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """The rows in which no window of any item occurs."""
    hits = free_name(df, "quire_hits")
    return scan(df, items, size, text=text, out=hits).filter(F.size(f"{hits}.runs") == 0).drop(hits)
