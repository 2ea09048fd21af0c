"""Document fingerprints by consistent weighted sampling, with DataFrame operations alone.

A document is a set of terms, its words between spaces, weighted by how often each occurs. In each of ``SLOTS``
independent draws, term x of weight w gets r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of term and round; with
t = floor(ln w / r + b), the term of least ln c - r (t - b) - r wins, and (x, t) is the sample. Two sets of terms get the
same sample with a probability of their generalised Jaccard similarity, sum of min over sum of max of the weights.
Each slot is drawn over the whole set, so the share of equal slots follows that similarity however few the terms or uneven their weights.
A slot keeps 16 bits of a hash of its sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import text_of

SLOTS = 64
#: Steps in which r and ln c are drawn.
_STEPS = 1024
_ID_BITS = 20


def _gamma_quantiles(n: int) -> list[float]:
    """The middle quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    out, x = [], 0.01
    for i in range(n):
        p = (i + 0.5) / n
        for _ in range(50):
            step = (1 - (1 + x) * math.exp(-x) - p) / (x * math.exp(-x))
            x = max(x - step, x / 4)
            if abs(step) < 1e-13:
                break
        out.append(x)
    return out


def _sample(k: int) -> str:
    """What slot k takes the least of: the rank of a term's sample above 20 bits of the sample's hash.

    Over columns term, ln_n, rs and ln_cs; a term's rank is ln c - r (t - b + 1), where t <= ln n / r + b.
    """
    h = f"xxhash64(term, {k})"
    r = f"rs[cast({h} & {_STEPS - 1} as int)]"
    ln_c = f"ln_cs[cast(shiftrightunsigned({h}, 10) & {_STEPS - 1} as int)]"
    b = f"((shiftrightunsigned({h}, 20) & 1048575) * {2.0**-20!r}D)"
    t = f"floor(ln_n / {r} + {b})"
    rank = f"cast(({ln_c} - {r} * ({t} - {b}) - {r} + 1024D) * {2.0**32!r}D as bigint)"
    ident = f"((shiftrightunsigned({h}, 40) + {t} * 40503) & {(1 << _ID_BITS) - 1})"
    return f"shiftleft({rank}, {_ID_BITS}) | {ident}"


def signature(term_rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, term, n) -> (by, slots array<int>): the signature of each group of weighted terms."""
    q = _gamma_quantiles(_STEPS)
    # a broadcast row, not constants, of which the plan would hold two copies a slot
    tables = term_rows.sparkSession.createDataFrame([(q, [math.log(x) for x in q])], "rs array<double>, ln_cs array<double>")
    rows = term_rows.select(*by, "term", F.log("n").alias("ln_n")).crossJoin(F.broadcast(tables))
    mins = [F.min(F.expr(_sample(k))).alias(f"s{k}") for k in range(SLOTS)]
    slots = [(F.col(f"s{k}") % (1 << 16)).cast("int") for k in range(SLOTS)]
    return rows.groupBy(*by).agg(*mins).select(*by, F.array(*slots).alias("slots"))


def text_form(slots: Column) -> Column:
    """Four hexadecimal digits a slot."""
    return F.lower(F.array_join(F.transform(slots, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(SLOTS))


def _search(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by a search of two levels."""
    if not bounds:
        return F.lit(0)
    wide = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    array = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    heads = F.expr(array([r[0] for r in rows]))
    row = F.size(F.filter(heads, lambda x: x <= value))
    inner = F.element_at(F.expr("array(" + ",".join(map(array, rows)) + ")"), F.greatest(row, F.lit(1)))
    return F.when(row == 0, 0).otherwise((row - 1) * wide + F.size(F.filter(inner, lambda x: x <= value)))


def in_order(df: DataFrame, key: str = "doc_id", text: str = "text", per_partition: int = 4) -> DataFrame:
    """(bucket, place, key, text, own, next): the rows by ascending key in buckets of consecutive keys, each with the text that follows.

    One shuffle. A row that begins a bucket is also given to the bucket before it, as one that isn't its ``own``; the first row of all
    follows the last. Equal keys stand by their text's hash, a null key stands first, a null text is empty.
    """
    spark = df.sparkSession
    low = -(1 << 63) + 1
    rows = df.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")).withColumn("k", F.coalesce("key", F.lit(low)))
    buckets = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], max(10_000, 20 * buckets)).alias("q"), F.min("k").alias("first")).first()
    first = low if cuts["first"] is None else cuts["first"]
    bounds = sorted({x for x in cuts["q"] or () if x > first})
    spec = rows.withColumn("b", _search(F.col("k"), bounds))
    isin = _search(F.col("k"), bounds) != _search(F.col("k") - 1, bounds)
    seat = lambda b, own, wrap: F.struct(b.cast("int").alias("bucket"), F.lit(own).alias("own"), F.lit(wrap).alias("wrap"))
    seats = F.array(seat(F.col("b"), True, 0), F.when(isin, seat(F.col("b") - 1, False, 0)), F.when(F.col("k") == first, seat(F.lit(len(bounds)), False, 1)))
    seated = spec.select("k", "text", F.explode(F.filter(seats, lambda s: s.isNotNull())).alias("seat")).select("seat.*", "k", "text")
    w = Window.partitionBy("bucket").orderBy("wrap", "k", F.xxhash64("text"), "text")
    return seated.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("text").over(w)).select("bucket", "place", F.when(F.col("k") != low, F.col("k")).alias("key"), "text", "own", F.coalesce("next", F.lit("")).alias("next"))


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced by the beginning of the next one, and their likeness.

    Null texts are empty; a text without terms has the fingerprint of the empty term alone, so equal texts have equal
    fingerprints; rows with equal keys are told apart by place; an empty table gives no rows.
    The text is shuffled once; all later steps are grouped within its buckets.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    base = in_order(df, key, text).withColumn("n_chars", F.length("text").cast("long"))
    base = base.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.expr("left(next, cast(floor(n_chars / 4) as int))")))
    variants = F.when(F.col("own"), F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t"))))
    words = base.select("bucket", "place", F.explode(variants).alias("x")).select("bucket", "place", F.col("x.v").alias("v"), F.explode(F.split("x.t", " ")).alias("word"))
    terms = words.select("bucket", "place", "v", F.xxhash64("word").alias("term")).groupBy("bucket", "place", "v", "term").agg(F.count("*").alias("n"))
    prints = signature(terms, ["bucket", "place", "v"])
    both = prints.groupBy("bucket", "place").agg(F.max(F.when(F.col("v") == 0, F.col("slots"))).alias("a"), F.max(F.when(F.col("v") == 1, F.col("slots"))).alias("e"))
    following = both.withColumn("f", F.lead("a").over(Window.partitionBy("bucket").orderBy("place")))
    kept = base.filter("own").select("bucket", "place", "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    return kept.join(following, ["bucket", "place"]).select(
        F.col("key").alias(key), "n_chars", "edited_sha256", text_form(F.col("a")).alias("fingerprint"), text_form(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("f")).alias("near_next")
    )
