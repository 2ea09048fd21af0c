"""Exact n-gram Jaccard join and its connected components, by a size-aware heavy-light join.

A document's set holds 64-bit hashes of its distinct word n-grams; sets are named by 128 bits, and equal sets are one from the start.

Light: two sets up to a size chosen by cost link exactly if they share a subset of the fixed size that the threshold asks of
their sizes. All such subsets are enumerated, each under its size pair, so that whoever meets under one links, unverified.

Heavy: larger sets, and light ones that may link with them, scan inverted lists of n-grams. Of sets that link at
``percent`` hundredths, each has one of its first (100 - percent) / 100 n + 1 n-grams, in any order that all sets share, in common with the
other's. The order puts n-grams of a fixed share of the hash space first, and among them rare ones, as counted over all sets; so
only that share is counted, most lists have one member, and common passages are hardly ever listed.

Lists are never expanded into all pairs. First every set of a list is compared with one member, the one with fewest n-grams
of its own, which mostly is the text that the others were copied from. Then sets outside a list's largest component so far are
joined with its members in other components. Length, place in the order and a 512-bit parity sketch decide within the join
which pairs are compared as whole sets; the bounds are exact, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, drop, free_name, stored, text_of

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: 64-bit words of a sketch.
_WORDS = 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_words = _Words()


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of the n-grams of words; of the whole sequence, if it has fewer but any words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _M2 + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def least_common(a: int, b: int, percent: int) -> int:
    """How many elements sets of these sizes must share for 100 |A & B| >= percent |A | B|."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """So many first elements of a set of n meet those of any set it links with, in any order that both share."""
    return n + percent * n // -100 + 1


@lru_cache(maxsize=8)
def plan(percent: int, verify_cost: int = 8) -> tuple[int, dict[int, list[tuple[int, int, int]]]]:
    """The largest light size, and for each light size what its subsets are enumerated for: smaller size, larger size, elements shared.

    A size is light while its subsets cost no more than ``verify_cost`` times its list entries: a subset
    is one row and needs no candidate looked at.
    """
    def asked(size: int) -> list[tuple[int, int, int]]:
        sizes = [m for m in range(1, 2 * size + 2) if 100 * min(m, size) >= percent * max(m, size)]
        return [(min(m, size), max(m, size), c) for m in sizes if (c := least_common(size, m, percent)) <= min(size, m)]

    light = 0
    while light < 63 and sum(_choose(light + 1, light + 1 - c) for _, _, c in asked(light + 1)) <= verify_cost * max(2, prefix(light + 1, percent)):
        light += 1
    return light, {s: [x for x in asked(s) if x[1] <= light] for s in range(1, light + 1)}


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def subsets(s: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """128-bit names of a light set's subsets, each with the sizes that it is for; odd where these differ."""
    asked = plan(percent)[1].get(len(s), [])
    out: set[tuple[int, int]] = set()
    with np.errstate(over="ignore"):
        for low, high, c in asked:
            names = []
            for factor in (_M1, _M3):
                m = _mix(s * factor + factor)
                d = len(s) - c
                left = [np.uint64(0)] if d == 0 else list(m) if d == 1 else [sum(x, np.uint64(0)) for x in combinations(m, d)]
                names.append(_mix((m.sum(dtype=np.uint64) - np.array(left, np.uint64)) ^ np.uint64(low << 32 | high << 16 | c)))
            first = names[0] & ~np.uint64(1) | np.uint64(low != high)
            out.update(zip(first.view(np.int64).tolist(), names[1].view(np.int64).tolist()))
    return sorted(out)


def counted_share(percent: int) -> float:
    """The share of the hash space that comes first in the order: sets reach 2.5 times their prefix with it, on average."""
    share = 2.5 * (100 - percent) / 100
    return share if share <= 0.5 else 1.0


def head(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The elements that may be in the set's prefix, and how many of them lie in the share that is counted; of a set that meets no heavy one, none.

    Elements beyond that share come last in the order, by hash, and are needed only where the others don't fill the prefix.
    """
    n = len(s)
    if not n or 100 * n < percent * (plan(percent)[0] + 1):
        return s[:0], 0
    share = counted_share(percent)
    inside = n if share == 1.0 else int(np.searchsorted(s, np.uint64(int(share * 2**64))))
    return s[: max(inside, min(n, prefix(n, percent)))], inside


def sketch(s: np.ndarray) -> np.ndarray:
    """Each bit is the parity of the elements it stands for, so sketches differ in no more bits than the sets in elements."""
    bits = np.bincount((s % np.uint64(64 * _WORDS)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _may_link(percent: int, a: str, b: str) -> Column:
    """Whether sets may link that meet in a list at places ``pos`` of the order: by sizes, by what is left after the places, by sketches."""
    both = f"({a}.n + {b}.n)"
    need = f"(({percent} * {both} + {99 + percent}) div {100 + percent})"
    differ = " + ".join(f"bit_count({a}.b{i} ^ {b}.b{i})" for i in range(_WORDS))
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need} and {differ} <= {both} - 2 * {need}")


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _named(df: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """(key, d1, d2, n, part) of every row: digests of its text, the size of its set, and what names its component (null without a set)."""
    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text")).select("key", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n) for t in b["text"].to_pylist()]
            heads = [head(s, percent) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b["key"], b["d1"], b["d2"], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([[{"k1": x, "k2": y} for x, y in subsets(s, percent)] for s in sets], pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))),
                    pa.array([h.view(np.int64) for h, _ in heads], pa.list_(pa.int64())), pa.array([i for _, i in heads], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["key", "d1", "d2", "n", "sid", "subsets", "es", "inside", "bits"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(listing, f"key {kind}, d1 long, d2 long, n long, sid binary, subsets array<struct<k1:long,k2:long>>, es array<long>, inside long, bits array<long>")
    docs = stored(found.withColumn("id", F.monotonically_increasing_id()), "sets")
    # of equal sets one goes on
    firsts = stored(docs.filter("sid is not null").groupBy("sid").agg(F.min("id").alias("id")), "firsts")
    own = _small(firsts.select("id"))

    light = docs.filter(F.size("subsets") > 0).join(own, "id", "left_semi").select("id", "n", F.explode("subsets").alias("k")).select("id", "n", "k.*")
    met = light.groupBy("k1", "k2").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"))
    met = met.filter("lead <> last and (k1 % 2 = 0 or low <> high)").select("k1", "k2", "lead")
    edges = stored(light.join(met, ["k1", "k2"]).filter("id <> lead").select(F.col("id").alias("u"), F.col("lead").alias("v")).distinct(), "light")

    entries = _entries(docs, own, percent)
    pairs = stored(_with_hubs(entries, percent), "pairs")
    more = _verified(pairs, rows, docs, n, percent)
    parts = connected(edges.unionByName(more))
    rest = stored(_across(entries, parts, percent), "pairs")
    last = _verified(rest, rows, docs, n, percent)
    drop(entries, pairs, rest)
    if not last.isEmpty():
        parts = connected(parts.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(last))
    # a component is named by the set of its root
    roots = parts.join(firsts.select(F.col("id").alias("root"), F.col("sid").alias("part")), "root").select(F.col("node").alias("id"), "part")
    parts = stored(firsts.join(roots, "id").select("sid", "part"), "parts")
    return docs.select("key", "d1", "d2", "n", "sid").join(parts, "sid", "left").select("key", "d1", "d2", "n", F.coalesce("part", "sid").alias("part"))


def _entries(docs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The inverted lists, as rows (e, id, n, own, pos, b0...): prefix elements that more than one set has; own: counted elements that no other has."""
    sets = docs.filter(F.size("es") > 0).join(own, "id", "left_semi")
    elements = sets.select("id", "n", "inside", F.explode("es").alias("e"))
    # written apart, so that its shuffle is gone before the elements are shuffled again
    seen = stored(elements.groupBy("e").agg(F.count("*").alias("f")).filter("f > 1"), "seen")
    share = counted_share(percent)
    counted = F.lit(True) if share == 1.0 else F.col("e").between(0, int(share * 2**64) - 1)
    shared = elements.join(seen, "e").withColumn("f", F.when(counted, F.col("f")).otherwise(0))
    mine = shared.groupBy("id", "n", "inside").agg(F.array_sort(F.collect_list(F.when(F.col("f") > 0, F.struct("f", "e")))).alias("l"), F.collect_list(F.when(F.col("f") == 0, F.col("e"))).alias("beyond"))
    mine = mine.withColumn("own", F.col("inside") - F.size("l"))
    length = F.expr(f"cast(greatest(0, n + ({percent} * n) div -100 + 1 - own) as int)")
    near = F.transform(F.slice("l", F.lit(1), length), lambda x, i: F.struct(x["e"].alias("e"), (F.col("own") + i).alias("pos")))
    # the place of an element beyond is after all counted ones, at least
    far = F.transform("beyond", lambda e: F.struct(e.alias("e"), F.col("inside").alias("pos")))
    listed = mine.select("id", "n", "own", F.explode(F.concat(near, far)).alias("x")).select("id", "n", "own", "x.*")
    several = listed.groupBy("e").agg(F.count("*").alias("m")).filter("m > 1").select("e")
    listed = stored(listed.join(several, "e"), "listed")
    bits = docs.select("id", *[F.col("bits")[i].alias(f"b{i}") for i in range(_WORDS)])
    out = stored(listed.join(bits, "id"), "entries")
    drop(seen, listed)
    return out


def _with_hubs(entries: DataFrame, percent: int) -> DataFrame:
    """(u, v): each set with the hub of one of its lists, if the two may link. A list's hub has the fewest elements of its own."""
    hub = ["own", "id", "n", "pos", *[f"b{i}" for i in range(_WORDS)]]
    hubs = entries.groupBy("e").agg(F.min(F.struct(*hub)).alias("h")).select(F.col("e").alias("e_"), "h.*")
    met = entries.alias("x").join(hubs.alias("y"), F.expr("x.e = y.e_ and x.id <> y.id") & _may_link(percent, "x", "y"))
    return met.groupBy(F.col("x.id").alias("u")).agg(F.min_by(F.col("y.id"), F.xxhash64("x.e", "y.id")).alias("v"))


def _across(entries: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs of lists that may link and aren't in one component yet."""
    named = entries.join(parts.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("part", F.coalesce("root", "id")).drop("root")
    sizes = named.groupBy("e", "part").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("e").agg(F.max(F.struct("m", "part")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("e", F.col("x.part").alias("largest"))
    left = stored(named.join(mixed, "e"), "mixed")
    met = left.filter("part <> largest").alias("x").join(left.alias("y"), F.expr("x.e = y.e and x.part <> y.part") & _may_link(percent, "x", "y"))
    return met.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) that link; the sets of those concerned are made again from their texts."""
    concerned = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    wanted = stored(docs.select("id", "d1", "d2").join(concerned, "id"), "wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([shingles(t, n).tobytes() for t in b["text"].to_pylist()], pa.binary())], names=["id", "set"])

    texts = rows.select("d1", "d2", "text").join(_small(wanted), ["d1", "d2"]).select("id", "text").dropDuplicates(["id"])
    sets = stored(texts.mapInArrow(whole, "id long, set binary"), "whole")

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x.to_pylist(), y.to_pylist())], pa.bool_())

    one = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u")
    both = one.join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    out = stored(both.filter(run(F.col("a"), F.col("b"))).select("u", "v"), "links")
    drop(wanted, sets)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): the least node of each component, by alternating large and small stars.

    Each step replaces edges by edges to least neighbours, with grouped minima and joins; none holds a component in one task.
    """
    current, before = edges.filter("u <> v").select("u", "v").distinct(), None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: greater neighbours go to the least one
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: lesser neighbours and the node itself go to the least one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("a").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stored(after, "stars")
        if before is not None:
            drop(before)
        # done once every node points straight at a root, and no root points on
        roots = after.select(F.col("v").alias("u")).distinct()
        many = after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
        if many.isEmpty() and after.join(roots, "u", "left_semi").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current = before = after


def components(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: rows link when their sets' Jaccard similarity is at least ``percent`` hundredths.

    component_id is the least key reachable by links. Keys may be of any type that has an order. Null, empty and blank texts have no set and
    link with nothing; a row whose key is null takes part, but gives no name (a component of such rows alone is null). Repeated rows and keys
    stay; an empty table gives no rows; columns beyond key and text are ignored. Very long texts are sets like others.
    """
    named = _named(df, n, percent, key, text)
    least = named.filter("part is not null").groupBy("part").agg(F.min("key").alias("least"))
    return named.join(least, "part", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("part").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows less all but one of each component: the one of least key (null last), and of equal keys one text by digest.

    Rows without a set (null and blank texts) all stay, whatever their keys. Other columns stay as they are; an empty table stays empty. Of rows that repeat key and
    text exactly one is taken, whichever.
    """
    named = _named(df, n, percent, key, text).withColumn("nokey", F.col("key").isNull())
    mark = ["nokey", "key", "d1", "d2"]
    counts = named.filter("part is not null").groupBy("part", *mark).agg(F.count("*").alias("times"))
    kept = stored(counts.groupBy("part").agg(F.min(F.struct(*mark, "times")).alias("x")).select("x.*"), "kept")
    d1, d2 = free_name(df, "quire_d1"), free_name(df, "quire_d2")
    marked = df.withColumn(d1, F.xxhash64(text_of(text))).withColumn(d2, F.xxhash64(F.lit(1), text_of(text)))
    blank = ~F.rlike(text_of(text), F.lit(r"[^ \t-\r]"))
    fits = lambda k: (marked[d1] == k["d1"]) & (marked[d2] == k["d2"]) & marked[key].eqNullSafe(k["key"])
    single, several = kept.filter("times = 1"), kept.filter("times > 1")
    out = marked.filter(blank).unionByName(marked.filter(~blank).join(single, fits(single), "left_semi"))
    again = marked.filter(~blank).join(several, fits(several), "left_semi").dropDuplicates([key, d1, d2])
    return out.unionByName(again).drop(d1, d2)
