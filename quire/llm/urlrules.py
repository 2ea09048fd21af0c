"""URL filters: written rules first, then association rules mined from labels.

A URL is a set of tokens: scheme, host labels, path segments (numbers as one), query keys. FP-growth over a bounded sample of
labelled URLs finds the token combinations that go with a bad label; they are pruned by support,
confidence, lift and simpler rules that do as well. An inverted index from each rule's rarest token
finds the rules that a URL contains.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name

BAD = "=bad"


@dataclass(frozen=True)
class Rule:
    """A written rule: a host, meant with all its subdomains, and the path's beginning."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: list[Rule], host: Column, path: Column) -> Column:
    """The text of the longest rule that fits, or null; of equally long ones, the first."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; none for null."""
    host, path = host_of(url), path_of(url)
    part = lambda c, sep, tag: F.transform(F.filter(F.split(c, sep), lambda x: x != ""), lambda x: F.concat(F.lit(tag), F.regexp_replace(x, r"^[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1))))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    return F.coalesce(F.array_distinct(F.concat(scheme, part(host, r"\.", "h:"), part(path, "/", "p:"), keys)), F.array().cast("array<string>"))


def surely(hits: float, rows: float, z: float) -> float:
    """The lower end of Wilson's interval, ``z`` standard deviations wide, for a share of hits among rows."""
    p = hits / rows
    return (p + z * z / (2 * rows) - z * math.sqrt(p * (1 - p) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)


def mine(labelled: DataFrame, min_confidence: float = 0.8, min_lift: float = 2.0, z: float = 1.96, fit_rows: int = 20_000, url: str = "url", bad: str = "bad") -> list[tuple[frozenset[str], float, float]]:
    """The kept rules: tokens that together go with ``bad``, their confidence and support; the best first.

    Fits on at most about ``fit_rows`` rows, dealt by a hash of the URL; null URLs and labels are left out; no rows give no rules; repeated rows count each.
    A rule's confidence must be ``min_confidence`` even at the lower end of its interval (``surely``). From this follows the least support that FP-growth is asked for: a rule
    that nothing contradicts needs min_confidence z^2 / (1 - min_confidence) rows. A rule is dropped where a simpler one is as confident.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.select(F.col(url).alias("url"), F.col(bad).cast("boolean").alias("bad")).filter("url is not null and bad is not null")
    n = rows.count()
    if n > fit_rows:
        rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
        n = rows.count()
    if not n:
        return []
    baskets = rows.select(F.when(F.col("bad"), F.concat(tokens_of(F.col("url")), F.array(F.lit(BAD)))).otherwise(tokens_of(F.col("url"))).alias("items"))
    least = min_confidence * z * z / (1 - min_confidence) if min_confidence < 1 else n
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift)).collect()
    return pruned([(frozenset(r.antecedent), r.confidence, r.support) for r in found if surely(r.support * n, r.support * n / r.confidence, z) >= min_confidence])


def pruned(rules: list[tuple[frozenset[str], float, float]]) -> list[tuple[frozenset[str], float, float]]:
    """The rules of which no part is a rule as confident; the best first."""
    kept: list[tuple[frozenset[str], float, float]] = []
    for own, confidence, support in sorted(rules, key=lambda r: (len(r[0]), -r[1], -r[2], sorted(r[0]))):
        if not any(k <= own and c >= confidence for k, c, _ in kept):
            kept.append((own, confidence, support))
    return sorted(kept, key=lambda k: (-k[1], -k[2], sorted(k[0])))


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[frozenset[str]]):
        uses: dict[str, int] = defaultdict(int)
        for r in rules:
            for t in r:
                uses[t] += 1
        self.by: dict[str, list[tuple[int, frozenset[str]]]] = defaultdict(list)
        for i, r in enumerate(rules):
            self.by[min(r, key=lambda t: (uses[t], t))].append((i, r))

    def first(self, tokens: list[str]) -> int | None:
        """The best rule whose tokens are all there."""
        own = set(tokens)
        return min((i for t in own for i, r in self.by.get(t, ()) if r <= own), default=None)


def judge(df: DataFrame, rules: list[Rule], mined: list[tuple[frozenset[str], float, float]], url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and mined_rule; columns of these names are replaced.

    A written rule decides where one fits; else a URL with a mined rule is blocked, all others allowed. Null and
    malformed URLs have an empty host and path, fit nothing and are allowed. One pass, no shuffle; other columns and repeated rows stay.
    """
    u = F.col(url)
    src = free_name(df, "quire_url")
    out = df.withColumn(src, u).withColumn("host", host_of(F.col(src))).withColumn("path", path_of(F.col(src)))
    out = out.withColumn("rule", F.when(F.col("host") != "", matched(rules, F.col("host"), F.col("path"))))
    written = F.lit(None).cast("string")
    for r in rules:
        written = F.when(F.col("rule") == r.text, r.verdict).otherwise(written)
    if mined:
        names = [" & ".join(sorted(r[0])) for r in mined]
        held = df.sparkSession.sparkContext.broadcast([r[0] for r in mined])

        @F.arrow_udf(T.StringType())
        def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = Index(held.value)
            for batch in batches:
                found = [index.first(t or []) for t in batch.to_pylist()]
                yield pa.array([None if i is None else names[i] for i in found], pa.string())

        out = out.withColumn("mined_rule", best(tokens_of(F.col(src))))
    else:
        out = out.withColumn("mined_rule", F.lit(None).cast("string"))
    return out.withColumn("verdict", F.coalesce(written, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))).drop(src)


def oracle(rules: list[Rule]) -> str:
    """The written rules' part in DuckDB's SQL, where no rule was mined."""
    order = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"((host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}'))"
    rule = "case " + " ".join(f"when {fits(r)} then '{r.text}'" for r in order) + " end"
    verdict = "case " + " ".join(f"when {fits(r)} then '{r.verdict}'" for r in order) + " else 'allow' end"
    return rf"""
with parts as (
  select page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages)
select page_id, host, path, {rule} as rule, {verdict} as verdict, null::varchar as mined_rule from parts"""
