"""Quality by hierarchical empirical Bayes.

A document's own evidence is the log likelihood ratio of a naive Bayes classifier over all its significant features, one
for poor quality and one for toxicity. Features overlap, so what speaks for a label and what speaks against it are
scaled by two factors each, fitted by logistic regression across two halves of the sample. The prior isn't the same everywhere: each host's rate of
poor documents is estimated from all its documents and shrunk towards the global rate, each path's (a part of a host)
towards its host's, the more the fewer documents there are; how strongly, the spread between hosts and paths says.
Posterior log odds = evidence + log odds of the shrunken rate.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded, drop, free_name, stored, text_of

_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LABELS = ("poor", "toxic")
#: Paths up to which their rates are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 50_000
#: Hashes by which near copies are told in the fit, and their least similarity.
SKETCH, NEAR = 64, 0.8


def features(text: str) -> set[str]:
    """Words, and the document's shape in coarse steps (marked §): endings, capitals, repetition, length."""
    raw = text.split()
    if not raw:
        return {"§empty"}
    n = len(raw)
    kinds = Counter(raw)
    found: set[str] = set()
    ends: Counter[str] = Counter()
    upper = digits = 0
    for w, k in kinds.items():
        stem = w.strip(_STRIP)
        if stem:
            found.add(stem.lower())
            upper += k * (len(stem) > 1 and stem.isupper())
            digits += k * stem[0].isdigit()
            if len(stem) != len(w):
                ends[w[w.rindex(stem) + len(stem) :][:3] or "<"] += k
        else:
            ends[w[:3]] += k
    found |= {f"§end {e} {_step(k / n)}" for e, k in ends.items() if k > 2}
    symbols = sum(k for e, k in ends.items() if len(e) > 1)
    found |= {f"§symbols {_step(symbols / n)}", f"§upper {_step(upper / n)}", f"§digits {_step(digits / n)}", f"§distinct {_step(len(kinds) / n)}", f"§top {_step(max(kinds.values()) / n)}", f"§words {n.bit_length()}"}
    return found


def sketch(text: str) -> list[int]:
    """The least ``SKETCH`` hashes of the text's word pairs, ascending; of a word or none, that of the text."""
    words = text.split()
    found = {xxhash.xxh3_64_intdigest(f"{a} {b}") >> 1 for a, b in zip(words, words[1:])} or {xxhash.xxh3_64_intdigest(text) >> 1}
    return heapq.nsmallest(SKETCH, found)


def near(a: list[int], b: list[int]) -> bool:
    """Whether the texts of these sketches have a Jaccard similarity of ``NEAR`` or more, by the least hashes of both."""
    x, y = set(a), set(b)
    both = heapq.nsmallest(SKETCH, x | y)
    return sum(h in x and h in y for h in both) >= NEAR * len(both)


def _step(x: float) -> str:
    return "0" if x <= 0 else f"{min(9, int(x * 10))}" if x >= 0.1 else "0+"


@dataclass(frozen=True)
class Model:
    """Weights of each label's features, the sample's rates, and for each label what is added to and multiplies the sums of negative and positive weights."""

    weights: dict[str, tuple[float, float]]
    rate: tuple[float, float]
    scale: tuple[tuple[float, float, float], ...] = ((0.0, 1.0, 1.0), (0.0, 1.0, 1.0))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, min_z: float = 5.0, text: str = "text", key: str = "doc_id") -> Model:
    """Fits on about ``fit_rows`` labelled documents at most, dealt by a hash of their key.

    labels: ``key``, quality (0 is poor), toxic (1 is toxic). A feature is kept if the likelihood ratio test finds it
    ``min_z`` standard deviations from chance. Null keys and labels are left out; near copies count once; without labels nothing is evidence.
    """
    marks = labels.select(F.col(key).alias("k"), (F.col("quality") == 0).cast("int").alias("poor"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna()
    n = marks.count()
    few = F.lit(True) if n <= fit_rows else F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n)
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("text")).filter(few).join(marks.filter(few), "k")

    @F.arrow_udf("array<long>")
    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([sketch(t) for t in b.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([near(a, b) for a, b in zip(x.to_pylist(), y.to_pylist())], pa.bool_())

    # near copies with equal labels are one piece of evidence: with the first of their least hash counts what isn't like it
    rows = rows.withColumn("sketch", sketches(F.col("text")))
    equal = Window.partitionBy("sketch", "poor", "toxic").orderBy("k", F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(equal)).filter("place = 1")
    alone = Window.partitionBy(F.col("sketch")[0], "poor", "toxic").orderBy("k", F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(alone)).withColumn("lead", F.first("sketch").over(alone))
    rows = rows.withColumn("copy", alike(F.col("sketch"), F.col("lead"))).filter("place = 1 or not copy")

    rows = stored(rows.select("text", "poor", "toxic", F.pmod(F.xxhash64("k", F.lit(2)), F.lit(2)).cast("int").alias("half")), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, int, int, int]] = Counter()
        for b in batches:
            for t, p, x, h in zip(*(b[c].to_pylist() for c in ("text", "poor", "toxic", "half"))):
                total[("", p, x, h)] += 1
                for f in features(t):
                    total[(f, p, x, h)] += 1
            if len(total) > 200_000:
                yield _table(total)
                total.clear()
        yield _table(total)

    sums = [F.sum(F.when(F.col("half") == h, F.col("n") if x is None else F.when(F.col(x) == 1, F.col("n")).otherwise(0)).otherwise(0)).alias(f"{x or 'n'}{h}") for h in (0, 1) for x in (None, *LABELS)]
    counts = stored(rows.mapInArrow(run, "feature string, poor int, toxic int, half int, n long").groupBy("feature").agg(*sums), "counts")
    total = counts.filter("feature = ''").first()
    if total is None:
        drop(rows, counts)
        return Model({}, (0.05, 0.05))
    add = lambda r, x, halves: sum(r[f"{x}{h}"] for h in halves)
    # a feature of fewer documents can't reach min_z in any of the fits; the sample bounds what comes to the driver
    fits = ((0,), (1,), (0, 1))
    least = min(least_count([add(total, x, halves) for x in LABELS], add(total, "n", halves), min_z) for halves in fits)
    found = {r.feature: r for r in counts.filter(F.col("n0") + F.col("n1") >= least).filter("feature <> ''").collect()}

    def weights(halves: tuple[int, ...]) -> dict[str, tuple[float, float]]:
        out = {f: tuple(_weight(add(r, x, halves), add(r, "n", halves), add(total, x, halves), add(total, "n", halves), min_z) for x in LABELS) for f, r in found.items()}
        return {f: w for f, w in out.items() if any(w)}

    crossed = docs.sparkSession.sparkContext.broadcast((weights((1,)), weights((0,))))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_sums(t, crossed.value[h]) for t, h in zip(b["text"].to_pylist(), b["half"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["poor"], b["toxic"], pa.array(got, pa.list_(pa.float64()))], names=["poor", "toxic", "sums"])

    with bounded(docs.sparkSession):
        told = rows.mapInArrow(judged, "poor int, toxic int, sums array<double>").collect()
    drop(rows, counts)
    rate = tuple((add(total, x, (0, 1)) + 0.5) / (add(total, "n", (0, 1)) + 1) for x in LABELS)
    scale = tuple(calibrated([r.sums[2 * i : 2 * i + 2] for r in told], [r[x] for r in told], rate[i]) for i, x in enumerate(LABELS))
    return Model(weights((0, 1)), rate, scale)


def calibrated(sums: list[list[float]], bad: list[int], rate: float) -> tuple[float, float, float]:
    """What is added, and the factors of the sums of negative and positive weights, that fit the labels best: a little-ridged logistic regression, by Newton steps.

    Factors stay between 0 and 1.5. With fewer than ten rows of either kind, sums count as they are.
    """
    y = np.array(bad, float)
    if min(y.sum(), len(y) - y.sum()) < 10:
        return 0.0, 1.0, 1.0
    x = np.column_stack([np.ones(len(y)), np.array(sums, float)])
    base = math.log(rate / (1 - rate))
    b = np.array([0.0, 0.5, 0.5])
    ridge, towards = np.diag([0.01, 1.0, 1.0]), np.array([0.0, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(base + x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ (b - towards))
        b = b + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return float(b[0]), *(float(v) for v in np.clip(b[1:], 0.0, 1.5))


def least_count(bad: list[int], n: int, min_z: float) -> int:
    """The fewest documents whose feature can reach ``min_z``: all of one kind, by the likelihood ratio test."""
    for k in range(1, n + 1):
        if any(_test(x, k, a, n) >= min_z * min_z for a in bad for x in (min(k, a), max(0, k - (n - a)))):
            return k
    return n + 1


def _test(bad: int, n: int, all_bad: int, all_n: int) -> float:
    cells = ((bad, all_bad, n), (n - bad, all_n - all_bad, n), (all_bad - bad, all_bad, all_n - n), (all_n - n - all_bad + bad, all_n - all_bad, all_n - n))
    # the likelihood ratio test also holds where a cell is empty
    return 2 * sum(x * math.log(x * all_n / (row * col)) for x, row, col in cells if x > 0)


def _weight(bad: int, n: int, all_bad: int, all_n: int, min_z: float) -> float:
    if _test(bad, n, all_bad, all_n) < min_z * min_z:
        return 0.0
    return math.log((bad + 0.5) / (all_bad + 1)) - math.log((n - bad + 0.5) / (all_n - all_bad + 1))


def _table(total: Counter) -> pa.RecordBatch:
    f, p, x, h = zip(*total) if total else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), *[pa.array(c, pa.int32()) for c in (p, x, h)], pa.array(list(total.values()), pa.int64())], names=["feature", "poor", "toxic", "half", "n"])


def _sums(text: str | None, weights: dict[str, tuple[float, float]]) -> list[float]:
    """For each label the sums of the text's negative and of its positive weights."""
    hit = [weights[f] for f in features(text or "") if f in weights]
    return [math.fsum(h[i] for h in hit if (h[i] > 0) == up) for i in range(len(LABELS)) for up in (False, True)]


def evidence(df: DataFrame, model: Model, text: str = "text", out: str = "evidence") -> DataFrame:
    """Adds each text's log likelihood ratios, of all significant features; null counts as empty."""
    held = df.sparkSession.sparkContext.broadcast((model.weights, model.scale))  # no larger than the fitting sample makes it

    @F.arrow_udf("struct<poor:double,toxic:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, scale = held.value
        for batch in batches:
            sums = [_sums(t, weights) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([c + a * s[2 * i] + b * s[2 * i + 1] for s in sums], pa.float64()) for i, (c, a, b) in enumerate(scale)], list(LABELS))

    return df.withColumn(out, run(text_of(text)))


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(c, F.lit(-30.0)), F.lit(30.0))))


def _logit(c: Column) -> Column:
    return F.log(c / (1 - c))


def rates(scored: DataFrame, model: Model, host: str, path: str, evidence_: str = "evidence") -> DataFrame:
    """(host, path) -> shrunken rates of poor and of toxic documents, over all rows.

    Strength of shrinking, by the method of moments: with m documents on average and variance v between groups around the rate r above them,
    r (1 - r) / v - 1 pseudo-documents of the level above, kept between 1 and 1000. A null host or path is a group of its own.
    """
    own = {x: _sigmoid(F.col(f"{evidence_}.{x}") + math.log(r / (1 - r))) for x, r in zip(LABELS, model.rate)}
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), *[F.sum(own[x]).alias(x) for x in LABELS])
    paths = stored(paths, "paths")  # so that the texts are scored once for all that follows
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in LABELS])

    def spread(level: DataFrame) -> list[tuple[float, float]]:
        """Each label's rate, and the strength of shrinking towards it."""
        got = level.agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in LABELS], *[F.sum(F.col(x) * F.col(x) / F.col("n")).alias(f"{x}_2") for x in LABELS], F.count("*").alias("groups")).first()
        out = []
        for x in LABELS:
            r = min(max((got[x] or 0) / got["n"], 1e-6), 1 - 1e-6) if got["n"] else 0.05
            between = max(0.0, ((got[f"{x}_2"] or 0) - r * (got[x] or 0)) / got["n"] - r * (1 - r) * got["groups"] / got["n"]) if got["n"] else 0.0
            out.append((r, min(1000.0, max(1.0, r * (1 - r) / between - 1)) if between > 0 else 1000.0))
        return out

    of_hosts, of_paths = spread(hosts), spread(paths)
    hosts = hosts.select("host", *[((F.col(x) + k * r) / (F.col("n") + k)).alias(f"host_{x}") for x, (r, k) in zip(LABELS, of_hosts)])
    up = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    return up.select("host", "path", *[((F.col(x) + k * F.col(f"host_{x}")) / (F.col("n") + k)).alias(f"rate_{x}") for x, (_, k) in zip(LABELS, of_paths)])


def score(df: DataFrame, model: Model, host: str, path: str, text: str = "text", reject: float = 0.5, carry_text: bool = True) -> DataFrame:
    """Adds p_poor, p_toxic (posterior) and keep: neither exceeds ``reject``. Columns of these names are replaced.

    Every row is kept and scored, null and empty texts by what an empty text shows; an empty table stays empty; repeated rows and other columns stay.
    Texts are scored once: the rows are written with their evidence, and without ``carry_text`` without their texts.
    """
    ev, h, p = (free_name(df, f"quire_{x}") for x in ("evidence", "host", "path"))
    prior = {x: free_name(df, f"quire_{x}") for x in LABELS}
    scored = evidence(df, model, text, ev)
    scored = stored(scored if carry_text else scored.drop(text), "scored")
    table = rates(scored, model, host, path, ev).select(F.col("host").alias(h), F.col("path").alias(p), *[F.col(f"rate_{x}").alias(prior[x]) for x in LABELS])
    table = stored(table, "rates")
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    joined = scored.join(table, scored[host].eqNullSafe(table[h]) & scored[path].eqNullSafe(table[p]), "left")
    for x, r in zip(LABELS, model.rate):
        of = F.least(F.greatest(F.coalesce(F.col(prior[x]), F.lit(r)), F.lit(1e-6)), F.lit(1 - 1e-6))
        joined = joined.withColumn(f"p_{x}", _sigmoid(F.col(f"{ev}.{x}") + _logit(of)))
    return joined.withColumn("keep", (F.col("p_poor") <= reject) & (F.col("p_toxic") <= reject)).drop(ev, h, p, *prior.values())
