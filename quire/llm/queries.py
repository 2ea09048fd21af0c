"""The thin queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, fingerprint, pii, quality, simjoin, sstable, suffixes, tokencount, urlrules
from quire.llm.common import read, text_of


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    path = tokenizer_file()
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode(ids, path).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in a passage of ten words of a benchmark item."""
    found = decontaminate.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: The written rules.
RULES = [
    urlrules.Rule("block", "com", "/en/"),
    urlrules.Rule("allow", "example.com", "/en/7"),
    urlrules.Rule("allow", "net", "/de/"),
    urlrules.Rule("block", "example.net", "/de/8"),
    urlrules.Rule("block", "org", "/es/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path and verdict: by the written rules, else by rules mined from the labels of its document."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    mined = urlrules.mine(pages.join(labels, "page_id"))
    return urlrules.judge(pages, RULES, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's posterior of being poor or toxic, with its source as host and its language as path, and whether it is kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, "source", "lang", carry_text=False).select("doc_id", "p_poor", "p_toxic", "keep")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it is over 512 tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, tokenizer_file()).select("doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness."""
    return fingerprint.compare_with_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts by kind, the base spans' digest, and all spans."""
    found = pii.annotate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of any 200-byte string that starts elsewhere too."""
    done = suffixes.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under three-word shingles of a Jaccard similarity of 0.9 or more."""
    return simjoin.components(read(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


def op10_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read from the shards that hold all ids."""
    rows = sstable.write_and_read(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), end_id=2)
    return rows.select(F.col("key").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_weighted_fingerprints": op6_weighted_fingerprints,
    "op7_pii_spans": op7_pii_spans,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_components": op9_jaccard_components,
    "op10_sorted_string_tables": op10_sorted_string_tables,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": f"""
with items as (select item_id, {_WORDS} as w from benchmark),
spots as (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s from spots),
docs as (select doc_id, {_WORDS} as w from documents),
places as (select doc_id, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) as i from docs, (select distinct n from windows)),
found as (select doc_id, i, p.n, item_id from places p join windows x on p.n = x.n and array_to_string(p.w[i : i + p.n - 1], ' ') = x.s),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct doc_id, item_id::varchar as name from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)""",
    # where no rule is mined, as from labels that say nothing of URLs
    "op3_url_filter": urlrules.oracle(RULES),
}
