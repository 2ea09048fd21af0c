"""Personal data: patterns, and an information-theoretic look at what stands around them. DataFrame operations alone.

Base spans come from four patterns. Matches and what lies between them come from one pattern each, and positions are
running lengths in code points. The patterns are written so that no start is tried twice: a run of
characters is entered at its beginning, and loops are possessive.

The method: each found value is a protected entity e. A term t of the words around it discloses e by
PMI(e; t) = ln(n(e,t) N / (n(e) df(t))), against the information of e itself, IC(e) = ln(N / n(e)). Contexts n are counted
once each however often they are copied, df and N over all documents. A term with PMI >= alpha IC in enough different
contexts gives e away even when e is masked; in texts that mention e it is generalised too. For an entity of few contexts,
a term must be in all of them, and that must not be chance: (df(t) / N)^n(e,t) is tested.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, stored, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def _may_have(kind: str, text: Column) -> Column:
    """Cheap, and true wherever a match that counts is."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]" if kind == "ip" else r"(?:[0-9][ -]?){11}[0-9]"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _counts(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: Column, kind: str) -> Column:
    """The matches that count, with their places in code points."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & _counts(kind, x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda acc: acc["out"])


def _in_order(spans: Column) -> Column:
    rank = {k: i for i, k in enumerate((*KINDS, "term"))}
    place = lambda s: s["start"] * 8 + F.coalesce(*[F.when(s["kind"] == k, i) for k, i in rank.items()])
    return F.array_sort(spans, lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))


def find(df: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds the base spans of each whole text, by start, then kind. Null counts as empty and has none."""
    t = text_of(text)
    found = [F.when(_may_have(k, t), _spans(t, F.lit(_PATTERN[k]), k)).otherwise(F.array().cast(_SPAN)) for k in KINDS]
    return df.withColumn(out, _in_order(F.concat(*found)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)


def disclosing(df: DataFrame, text: str = "text", window: int = 5, min_contexts: int = 3, alpha: float = 0.8, reach: int = 100, chance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(entity, term) of terms that disclose an entity, and (digest, entity) of the texts that mention it.

    A context is up to ``window`` words within ``reach`` characters on each side. A hot entity is no hot task: contexts are made distinct
    and counted with partial sums. A term must be in ``min_contexts`` contexts, or in all of an entity that has fewer; then the chance of that,
    by its df, must be at most ``chance`` over the terms of a context. So a lone context tells nothing in a table of few documents.
    """
    base = find(df.select(text_of(text).alias("text")), "text", "base").filter(F.size("base") > 0)
    one = base.select(F.sha2("text", 256).alias("digest"), "text", F.explode("base").alias("s"))
    left = F.substr("text", F.greatest(F.lit(1), F.col("s.start") - reach + 1), F.least(F.lit(reach), F.col("s.start")))
    right = F.substr("text", F.col("s.end") + 1, F.lit(reach))
    before, after = _words(left), _words(right)
    around = F.array_distinct(F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - window + 1), window), F.slice(after, 1, window)))
    entity = F.concat_ws(":", F.col("s.kind"), F.lower("s.value"))
    mentions = stored(one.select("digest", entity.alias("entity"), F.array_sort(around).alias("around")).distinct(), "mentions")
    contexts = mentions.select("entity", "around").distinct()
    known = contexts.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = contexts.join(known, "entity").select("entity", "n_e", F.explode("around").alias("term")).groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= F.least(F.lit(min_contexts), "n_e"))
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term"), mentions.select("digest", "entity")
    terms = pairs.select("term").distinct()
    words = df.select(F.explode(F.array_distinct(_words(text_of(text)))).alias("term"))
    # counted before the join, which then sees each term once and not each of its documents; a semi join would be pushed below the count
    counted = words.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term")
    n = df.count()
    pmi = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.greatest("df", "n_et")))
    sure = (F.col("n_et") >= min_contexts) | (F.col("n_et") * F.log(F.lit(float(n)) / F.greatest("df", "n_et")) >= math.log(2 * window / chance))
    kept = pairs.join(counted, "term").filter(sure).filter(pmi >= alpha * F.log(F.lit(float(max(n, 2))) / F.col("n_e")))
    return stored(kept.select("entity", "term"), "disclosing"), mentions.select("digest", "entity")


def annotate(df: DataFrame, text: str = "text", base: str = "base", spans: str = "spans", window: int = 5, min_contexts: int = 3, alpha: float = 0.8) -> DataFrame:
    """Adds ``base`` spans and all ``spans``: those and the method's, whose kind is term.

    Null texts are empty; equal texts get equal spans; columns of these names are replaced, others and repeated rows stay; an empty table
    stays empty. Where no term discloses anything, the texts aren't shuffled.
    """
    terms, mentions = disclosing(df, text, window, min_contexts, alpha)
    if terms.isEmpty():
        found = find(df, text, base)
        return found.withColumn(spans, F.col(base))
    digest, listed = free_name(df, "quire_digest"), free_name(df, "quire_terms")
    of_text = mentions.join(terms, "entity").groupBy("digest").agg(F.array_sort(F.collect_set("term")).alias(listed)).withColumnRenamed("digest", digest)
    marked = df.withColumn(digest, F.sha2(text_of(text), 256)).join(of_text, digest, "left")
    found = find(marked, text, base)
    # terms are letters and digits alone, so they need no quoting
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(listed, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    clear = lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    more = F.when(F.col(listed).isNotNull(), F.filter(_spans(text_of(text), pattern, "term"), clear)).otherwise(F.array().cast(_SPAN))
    return found.withColumn(spans, _in_order(F.concat(F.col(base), more))).drop(digest, listed)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span put as its kind in brackets; what overlaps a span before it goes with that."""
    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with personal data in their texts masked; a null text stays null."""
    base, spans = free_name(df, "quire_base"), free_name(df, "quire_spans")
    return annotate(df, text, base, spans).withColumn(text, masked(F.col(text), F.col(spans))).drop(base, spans)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
