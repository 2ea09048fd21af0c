"""What a parser's raw blocks leave of a page: text blocks without blanks, numbered anew, and images to recognise or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import routing

KEY = ["doc_id", "page_number"]


def text_blocks(raw: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_index, bbox, text, lines) of raw blocks of type 0: doc_id, page_number, pos, type, bbox, lines of (bbox, spans of (text, ...)).

    Blank spans go, then lines without text, then blocks without lines; a line is its spans' texts, a block its lines', each without space around it.
    """
    held = F.transform("lines", lambda l: F.struct(l["bbox"].alias("bbox"), F.filter(l["spans"], lambda s: T.strip(F.coalesce(s["text"], F.lit(""))) != "").alias("spans")))
    named = F.transform(held, lambda l: F.struct(T.strip(F.array_join(F.transform(l["spans"], lambda s: s["text"]), "")).alias("text"), l["bbox"].alias("bbox"), l["spans"].alias("spans")))
    kept = raw.filter("type = 0").withColumn("lines", F.filter(named, lambda l: l["text"] != "")).filter(F.size("lines") > 0)
    text = T.strip(F.array_join(F.transform("lines", lambda l: l["text"]), "\n"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) - 1
    return kept.select(*KEY, number.alias("block_index"), "bbox", text.alias("text"), "lines")


def images(raw: DataFrame) -> DataFrame:
    """Raw blocks of type 1 with width, height and share of the page, numbered and told apart as candidates and ignored ones; raw also has page_width and page_height."""
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) - 1
    share = G.area_ratio(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    return routing.split_images(raw.filter("type = 1").select(*KEY, number.alias("image_index"), "bbox", G.width(F.col("bbox")).alias("width"), G.height(F.col("bbox")).alias("height"), share.alias("area_ratio")))
