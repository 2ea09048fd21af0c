"""Removal of long repeated substrings, exactly, in UTF-8 bytes.

Every window of ``LENGTH`` bytes picks as its anchor the leftmost of the 64-byte strings in it that have the least hash.
Equal windows pick the same anchor at the same offset, so a window can only repeat where its anchor does. Runs of windows
with one anchor are classes by the bytes they cover: a class seen twice repeats whole. The others of an
anchor are compared by suffix sorting (``deep_shallow``): what follows the anchor, and what comes before it read backwards, are
sorted; the common prefixes of neighbours give those of all pairs, and a window repeats if one other class shares
enough on both sides. Anchors with very many classes are compared window by window, by digest and count, so that no task
holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, small_batches, stored, text_of

LENGTH = 200
_GRAM = 64
#: Window starts looked at together.
_PIECE = 1 << 20
#: Classes of an anchor up to which they are compared in one task, for which two tables of their common prefixes are held.
_FEW = 4096
_R = np.random.default_rng(20240229)
_TABLE = _R.integers(0, 1 << 64, 256, np.uint64)
_FACTORS = _R.integers(0, 1 << 63, 6, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


# suffix sorting


def deep_shallow(texts: list[bytes], shallow: int = 48) -> tuple[list[int], list[int]]:
    """The order of the texts, and the common prefix of each with the one before it in that order (0 for the first).

    Multikey quicksort on words of 8 bytes down to ``shallow`` bytes; groups that still agree there are ordered by a blind trie.
    """
    order: list[int] = []
    stack = [(list(range(len(texts))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            order += group
        elif depth >= shallow:
            order += _blind_trie(texts, group)
        else:
            pivot = texts[group[len(group) // 2]][depth : depth + 8]
            less = [i for i in group if texts[i][depth : depth + 8] < pivot]
            same = [i for i in group if texts[i][depth : depth + 8] == pivot]
            more = [i for i in group if texts[i][depth : depth + 8] > pivot]
            ended = len(pivot) < 8  # then all of ``same`` are equal to their ends
            stack.append((more, depth))
            stack.append((same, shallow if ended else depth + 8))
            stack.append((less, depth))
    return order, [0] + [common(texts[a], texts[b]) for a, b in zip(order, order[1:])]


def _blind_trie(texts: list[bytes], group: list[int]) -> list[int]:
    """Orders texts by a trie that knows only where it branches, by insertion: a blind descent by the branching bytes, one
    comparison with the leaf it ends at, then a new branch at the height of the first difference.

    A node is [depth, {byte or -1 at the end: child}], a leaf the list of equal texts' numbers.
    """
    root: list = [group[0]]
    is_node = lambda x: len(x) == 2 and isinstance(x[1], dict)
    byte = lambda t, d: t[d] if d < len(t) else -1
    for i in group[1:]:
        t, node = texts[i], root
        while is_node(node):
            node = node[1].get(byte(t, node[0])) or next(iter(node[1].values()))
        other = texts[node[0]]
        at = common(t, other)
        if at == len(t) == len(other):
            node.append(i)
            continue
        parent, key, node = None, None, root
        while is_node(node) and node[0] < at:
            parent, key = node, byte(t, node[0])
            node = node[1][key]
        if is_node(node) and node[0] == at:
            node[1][byte(t, at)] = [i]
            continue
        fresh = [at, {byte(other, at): node, byte(t, at): [i]}]
        if parent is None:
            root = fresh
        else:
            parent[1][key] = fresh
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if is_node(node):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def pairwise(texts: list[bytes]) -> np.ndarray:
    """The common prefixes of all pairs, as the least of the neighbours' between them in sorted order."""
    order, lcp = deep_shallow(texts)
    n = len(texts)
    out = np.zeros((n, n), np.int16)
    steps, order = np.array(lcp, np.int16), np.array(order)
    for i in range(n - 1):
        low = np.minimum.accumulate(steps[i + 1 :])
        out[order[i], order[i + 1 :]] = low
        out[order[i + 1 :], order[i]] = low
    return out


def shared_windows(classes: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each class (bytes, anchor's place in them): its windows, first and last start, that another class has too."""
    rights = pairwise([b[a:] for b, a in classes])
    lefts = pairwise([b[:a][::-1] for b, a in classes])
    np.fill_diagonal(rights, 0)
    out = []
    for i, (data, a) in enumerate(classes):
        # with offset o before the anchor: length - right <= o <= left
        first = np.maximum(0, a - lefts[i].astype(np.int64))
        last = np.minimum(len(data) - length, a - np.maximum(0, length - rights[i].astype(np.int64)))
        fits = first <= last
        marks = np.zeros(len(data) - length + 2, np.int64)
        np.add.at(marks, first[fits], 1)
        np.add.at(marks, last[fits] + 1, -1)
        inside = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]]).astype(np.int8)))
        out.append([(int(x), int(y) - 1) for x, y in zip(inside[::2], inside[1::2])])
    return out


def _union(runs: list[tuple[int, int]], near: int = 0) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(r for r in runs if r[0] <= r[1]):
        if out and a <= out[-1][1] + near:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# anchors


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: first start, last start, anchor, anchor's hash; a piece at a time.

    data: the texts' bytes one after another; windows lie within one text, begins[i] to ends[i].
    """
    width = length - _GRAM + 1
    valid = np.zeros(len(data) + 1, np.int8)
    for b, e in zip(begins, ends):
        if e - b >= length:
            valid[b] += 1
            valid[e - length + 1] -= 1
    valid = np.cumsum(valid, dtype=np.int8)[:-1].astype(bool)
    for p in range(0, max(0, len(data) - length + 1), _PIECE):
        here = data[p : p + _PIECE + length - 1]
        h = _TABLE[here]
        for level in range(6):
            k = 1 << level
            h = h[:-k] * _FACTORS[level] + h[k:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= width:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if width > k:
            least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
        at = (least & _PLACE).astype(np.int64)
        ok = valid[p : p + len(at)]
        turn = np.empty(len(at) + 1, bool)
        turn[0] = turn[-1] = True
        turn[1:-1] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
        edges = np.flatnonzero(turn)
        first, last = edges[:-1], edges[1:] - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        yield first + p, last + p, at[first] + p, h[at[first]].view(np.int64)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    return np.frombuffer(data, np.uint8), begins, ends, data


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(t: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(t)
    return _signed(d >> 64), _signed(d & ((1 << 64) - 1))


def _runs(batches: Iterator[pa.RecordBatch], length: int, full: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(t or "").encode() for t in b[0].to_pylist()]
        data, begins, ends, raw = _flat(texts)
        ids = [_digest(t) for t in texts] if full else None
        for first, last, at, h in anchors(data, begins, ends, length):
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(h)], names=["anchor"])
                continue
            of = np.searchsorted(ends, first, "right")
            base = begins[of]
            span = [_signed(xxhash.xxh3_64_intdigest(raw[f : z + length], a - f)) for f, z, a in zip(first.tolist(), last.tolist(), at.tolist())]
            hi, lo = np.array([ids[i][0] for i in of.tolist()], np.int64), np.array([ids[i][1] for i in of.tolist()], np.int64)
            place = (first - base) << 16 | (at - first) << 8 | (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, np.array(span, np.int64), hi, lo, place)], names=["anchor", "span", "hi", "lo", "place"])


# the operator


def repeated_ranges(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(hi, lo, first, last): for each text, by digest, starts of windows that also occur elsewhere."""
    small_batches(df.sparkSession)
    if not 2 * _GRAM <= length <= _GRAM + 255:
        raise ValueError(f"length must be {2 * _GRAM} to {_GRAM + 255}")
    texts = df.select(text_of(text).alias("text"))
    often = texts.mapInArrow(lambda b: _runs(b, length, False), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    rows = texts.mapInArrow(lambda b: _runs(b, length, True), "anchor long, span long, hi long, lo long, place long")
    found = stored(rows.join(often, "anchor", "left_semi"), "runs")
    # one row a class: how often it was seen, and one place where it is
    classes = stored(found.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("hi", "lo", "place")).alias("at")), "classes")
    of_anchor = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.max(F.when(F.col("n") == 1, 1).otherwise(0)).alias("open")).filter("m > 1 and open = 1")
    start = F.shiftright("place", 16).cast("long")
    tail = F.col("place").bitwiseAND(255)
    whole = found.join(classes.filter("n > 1").select("anchor", "span"), ["anchor", "span"], "left_semi").select("hi", "lo", start.alias("first"), (start + tail).alias("last"))

    doubtful = classes.join(of_anchor.select("anchor", "m"), "anchor").select("anchor", "m", "n", "at.*")
    held = _bytes_of(texts, doubtful, length)
    held = stored(held, "held")

    def compare(group: pa.Table) -> pa.Table:
        # a group is several anchors' classes
        rows = group.sort_by([("anchor", "ascending")]).to_pylist()
        out: list[tuple[int, int, int, int]] = []
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j]["anchor"] == rows[i]["anchor"]:
                j += 1
            part = rows[i:j]
            for r, runs in zip(part, shared_windows([(r["bytes"], r["place"] >> 8 & 255) for r in part], length)):
                if r["n"] == 1:
                    first = r["place"] >> 16
                    out += [(r["hi"], r["lo"], first + a, first + b) for a, b in runs]
            i = j
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["hi", "lo", "first", "last"])

    few = held.filter(F.col("m") <= _FEW)
    # many anchors a group, so that a call pays; how many groups follows the rows
    n = max(64, few.count() // 2048)
    local = few.withColumn("g", F.pmod(F.xxhash64("anchor"), F.lit(n))).groupBy("g").applyInArrow(compare, "hi long, lo long, first long, last long")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = r["place"] >> 16
                k = len(r["bytes"]) - length + 1
                d = [_digest(r["bytes"][i : i + length]) for i in range(k)]
                yield pa.RecordBatch.from_pydict({"w1": [x for x, _ in d], "w2": [y for _, y in d], "hi": [r["hi"]] * k, "lo": [r["lo"]] * k, "first": list(range(first, first + k)), "n": [r["n"]] * k})

    windows = held.filter(F.col("m") > _FEW).select("bytes", "hi", "lo", "place", "n").mapInArrow(split, "w1 long, w2 long, hi long, lo long, first long, n long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("k")).filter("k > 1").select("w1", "w2")
    many = windows.filter("n = 1").join(twice, ["w1", "w2"], "left_semi").select("hi", "lo", "first", F.col("first").alias("last"))
    return whole.unionByName(local).unionByName(many)


def _bytes_of(texts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of classes, cut from the texts of their digests."""
    wanted = classes.groupBy("hi", "lo").agg(F.collect_list(F.struct("anchor", "m", "n", "place")).alias("rows"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [_digest((t or "").encode()) for t in b[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64()), b[0]], names=["hi", "lo", "text"])

    known = texts.filter(F.octet_length("text") >= length).mapInArrow(digests, "hi long, lo long, text string")
    joined = known.join(wanted, ["hi", "lo"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hi, lo, text, rows in zip(*(b[c].to_pylist() for c in ("hi", "lo", "text", "rows"))):
                data = text.encode()
                out = [data[r["place"] >> 16 : (r["place"] >> 16) + (r["place"] & 255) + length] for r in rows]
                k = len(rows)
                yield pa.RecordBatch.from_pydict({"hi": [hi] * k, "lo": [lo] * k} | {c: [r[c] for r in rows] for c in ("anchor", "m", "n", "place")} | {"bytes": out})

    # copies of a text give the same rows again: one of each
    return joined.mapInArrow(cut, "hi long, lo long, anchor long, m long, n long, place long, bytes binary").dropDuplicates(["hi", "lo", "anchor", "place"])


def remove_repeats(df: DataFrame, text: str = "text", out: str = "kept", length: int = LENGTH) -> DataFrame:
    """Adds ``out``, the bytes left of each whole text once all that lies in a repeated window is gone, with n_removed and n_spans.

    A window repeats if its bytes also start anywhere else, in the same text or another row's; overlaps count. Null is empty; texts of fewer
    bytes than ``length`` stay whole; columns of these names are replaced, others and repeated rows stay; an empty table stays empty.
    What is left needn't be valid UTF-8, so it is binary.
    """
    ranges = stored(repeated_ranges(df, text, length).distinct(), "ranges").groupBy("hi", "lo").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    hi, lo, runs = (free_name(df, f"quire_{x}") for x in ("hi", "lo", "runs"))

    @F.arrow_udf("struct<hi:long,lo:long>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            d = [_digest(t.encode()) for t in b.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64())], ["hi", "lo"])

    @F.arrow_udf("struct<kept:binary,n_removed:long,n_spans:long>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            kept, removed, spans = [], [], []
            for t, r in zip(texts.to_pylist(), found.to_pylist()):
                data = t.encode()
                gone = _union([(x["first"], x["last"] + length) for x in r or ()])
                at, parts = 0, []
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                removed.append(len(data) - len(kept[-1]))
                spans.append(len(gone))
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["kept", "n_removed", "n_spans"])

    d = free_name(df, "quire_digest")
    keyed = df.withColumn(d, digest(text_of(text))).withColumn(hi, F.col(f"{d}.hi")).withColumn(lo, F.col(f"{d}.lo")).drop(d)
    joined = keyed.join(ranges.select(F.col("hi").alias(hi), F.col("lo").alias(lo), F.col("runs").alias(runs)), [hi, lo], "left")
    done = joined.withColumn(d, cut(text_of(text), F.col(runs)))
    return done.withColumn(out, F.col(f"{d}.kept")).withColumn("n_removed", F.col(f"{d}.n_removed")).withColumn("n_spans", F.col(f"{d}.n_spans")).drop(d, hi, lo, runs)
