"""Page and document reports in long form, and how they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def page_audit(blocks: DataFrame, limit: int = 180, first: int = 3) -> DataFrame:
    """A row for each page: blocks and characters by role, and the first content and other texts."""
    kind = F.when(F.coalesce("role", F.lit("content")) == "content", "content").otherwise("other")
    w = Window.partitionBy("doc_id", "page_number", "kind").orderBy("block_index")
    rows = blocks.withColumn("kind", kind).withColumn("i", F.row_number().over(w)).withColumn("sample", F.when(F.col("i") <= first, F.struct("block_index", F.substring(T.collapsed(F.col("text")), 1, limit).alias("text"))))
    per_role = rows.groupBy("doc_id", "page_number", "role").agg(F.count("*").alias("n"))
    roles = per_role.groupBy("doc_id", "page_number").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))
    samples = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("sample")))), lambda s: s["text"]).alias(f"{k}_examples")
    out = rows.groupBy("doc_id", "page_number").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), samples("content"), samples("other"))
    return out.join(roles, ["doc_id", "page_number"])


def totals(rows: DataFrame, by: str) -> DataFrame:
    """Counts by a column for each page, for each document (page null) and over all (both null), in one pass."""
    return rows.groupingSets([["doc_id", "page_number", by], ["doc_id", by], [by]], "doc_id", "page_number", by).agg(F.count("*").alias("n"))


def as_text(report: DataFrame, *columns: str) -> DataFrame:
    """A line of text for each row: name=value, in the order given; nested values as JSON."""
    nested = {f.name for f in report.schema if f.dataType.typeName() in ("array", "map", "struct")}
    value = lambda c: F.to_json(c) if c in nested else F.col(c).cast("string")
    return report.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(value(c), F.lit("-"))) for c in columns]).alias("value"))


def write_pair(report: DataFrame, path: str, *columns: str) -> None:
    """The report as JSON lines and as text."""
    report.write.mode("overwrite").json(f"{path}/json")
    as_text(report, *(columns or report.columns)).write.mode("overwrite").text(f"{path}/text")


def read_report(spark, path: str, schema: str) -> DataFrame:
    """A report written before, by its schema; nothing is inferred."""
    return spark.read.schema(schema).json(f"{path}/json")


def violations(summaries: DataFrame, **expected: str) -> DataFrame:
    """Rows that fail a named condition in SQL; none means passed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), n) for n, c in expected.items()]))
    return summaries.withColumn("violations", failed).filter(F.size("violations") > 0)
