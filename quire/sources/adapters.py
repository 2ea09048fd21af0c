"""Test bindings: the driver's tables read as documents with pages, blocks, images and recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as pages of a document for each source; a line is a block, its place computed from its number."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
    n = F.col("block_index")
    y0 = 40 + 7 * (n % 114)
    size = F.when(n == 0, 16.0).otherwise(10.0)
    x1 = 40 + F.least(F.lit(515), 5 * F.length("text"))
    bbox = G.box(F.lit(40), y0, x1, y0 + 6)
    line = F.struct(F.col("text").alias("text"), bbox.alias("bbox"), F.array(F.struct(F.col("text").alias("text"), F.lit("helv").alias("font"), size.alias("size"), F.lit(0).alias("flags"), F.lit(0).alias("color"))).alias("spans"))
    return docs.select("doc_id", "page_number", "block_index", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), bbox.alias("bbox"), "text", F.array(line).alias("lines"))


def order_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as images: an order is a page, a line an image whose size comes from its quantity and price."""
    li = table(spark, sf_dir, "lineitem")
    w, h = F.col("l_quantity") * 8, F.col("l_extendedprice") / 100
    return li.select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("image_index"), w.alias("width"), h.alias("height"), (w * h / (595.0 * 842.0)).alias("area_ratio"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as documents of one page: a turn is a block, its lines are lines."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), F.col("turn").alias("block_pos"), F.posexplode(F.split("text", "\n")).alias("line_pos", "text"))
