"""Text recognised in images: parsing it, judging it, and bringing it together with the text of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def parse_tsv(tsv: DataFrame) -> DataFrame:
    """doc_id, tsv -> a row for each word or box of a recogniser's table; short rows are filled with nothing."""
    raw = tsv.select("doc_id", F.filter(F.split("tsv", r"\r?\n"), lambda x: T.strip(x) != "").alias("ls")).filter(F.size("ls") > 1)
    rows = raw.select("doc_id", F.split(F.element_at("ls", 1), "\t").alias("head"), F.posexplode(F.slice("ls", 2, F.size("ls") - 1)).alias("pos", "line"))
    cells = F.split("line", "\t")
    get = lambda n: F.coalesce(F.get(cells, F.array_position("head", F.lit(n)).cast("int") - 1), F.lit(""))
    number = lambda n, kind="int", default=0: F.coalesce(F.nullif(get(n), F.lit("")).cast(kind), F.lit(default).cast(kind)).alias(n)
    return rows.select("doc_id", "pos", *[number(n) for n in ("level", "page_num", "block_num", "par_num", "line_num", "left", "top", "width", "height")], number("conf", "double", -1), get("text").alias("text"))


def tsv_lines(words: DataFrame, margin: int = 3) -> DataFrame:
    """Words to lines: text in order, box, mean confidence, and which edges of the image, as far as any row reaches, a line touches."""
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    extent = words.groupBy("doc_id").agg(F.max(right).alias("image_width"), F.max(bottom).alias("image_height"))
    own = words.filter((F.col("level") == 5) & (T.strip(F.col("text")) != ""))
    conf = F.when(F.col("conf") >= 0, F.col("conf"))
    grouped = own.groupBy("doc_id", "page_num", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", T.strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(right).alias("x1"), F.max(bottom).alias("y1"), F.avg(conf).alias("confidence"), F.count("*").alias("word_count"), F.min("pos").alias("first"),
    )
    out = grouped.join(extent, "doc_id").withColumn("line_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "page_num", "block_num", "par_num", "line_num")))
    edges = {"left": F.col("x0") <= margin, "right": (F.col("image_width") > 0) & (F.col("x1") >= F.col("image_width") - margin), "top": F.col("y0") <= margin, "bottom": (F.col("image_height") > 0) & (F.col("y1") >= F.col("image_height") - margin)}
    return out.select("doc_id", "line_index", "page_num", "block_num", "par_num", "line_num", "text", "x0", "y0", "x1", "y1", *[c.alias(f"touches_{e}_edge") for e, c in edges.items()], "confidence", "word_count")


def review(regions: DataFrame) -> DataFrame:
    """Adds quality, word_count and preview to recognised regions (ocr_status, ocr_text); what wasn't recognised has its status as quality."""
    t = T.ocr_normalized(F.coalesce("ocr_text", F.lit("")))
    return regions.withColumn("quality", F.when(F.col("ocr_status") == "ok", T.ocr_quality(F.col("ocr_text"))).otherwise(F.col("ocr_status"))).withColumn("word_count", F.size(T.words(t))).withColumn("preview", T.preview(t))


def fuse(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """A row for each page that has either: native (doc_id, page_number) regions and ocr (doc_id, page_number, route) regions, counted."""
    key = ["doc_id", "page_number"]
    n = native.groupBy(*key).agg(F.count("*").alias("native_region_count"))
    o = ocr.groupBy(*key).agg(F.count("*").alias("ocr_region_count"), F.min("route").alias("ocr_route"))
    out = n.join(o, key, "full")
    route = F.coalesce("ocr_route", F.when(F.col("native_region_count").isNotNull(), "native_only").otherwise("ocr_only"))
    return out.select(*key, route.alias("route"), F.coalesce("native_region_count", F.lit(0)).alias("native_region_count"), F.coalesce("ocr_region_count", F.lit(0)).alias("ocr_region_count"))


def missing_pages(selected: DataFrame, rendered: DataFrame) -> DataFrame:
    return selected.join(rendered, ["doc_id", "page_number"], "left_anti")


def reading_order(regions: DataFrame, large: float = 80.0) -> DataFrame:
    """Adds reading_order. regions: doc_id, page_number, region_pos, bbox.

    Pages of fewer than eight regions keep their order. Where starts fall into columns, the last gap of ``large`` or more between
    them divides the page if both sides hold four regions of some height; then headers, left, right and notes at the bottom follow each other.
    """
    page = Window.partitionBy("doc_id", "page_number")
    x = F.bround(F.coalesce(F.col("bbox.x0"), F.lit(0.0)), 1)
    y0, y1 = F.coalesce(F.col("bbox.y0"), F.lit(0.0)), F.coalesce(F.col("bbox.y1"), F.lit(0.0))
    starts = regions.select("doc_id", "page_number", x.alias("x")).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    # starts within 8 of the one kept before are one column
    kept = F.aggregate("xs", F.array().cast("array<double>"), lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) > 8), F.concat(acc, F.array(v))).otherwise(acc))
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("cols") - 1, F.lit(1))), lambda i: F.when(F.get("cols", i) - F.get("cols", i - 1) >= large, (F.get("cols", i) + F.get("cols", i - 1)) / 2)), lambda g: g.isNotNull())
    cut = starts.withColumn("cols", kept).select("doc_id", "page_number", F.when(F.size(gaps) > 0, F.element_at(gaps, -1)).alias("cut"))
    tall = y1 - y0 >= 12
    left = F.coalesce(F.col("bbox.x0"), F.lit(0.0)) < F.col("cut")
    out = regions.join(cut, ["doc_id", "page_number"], "left").withColumn("_n", F.count("*").over(page)).withColumn("_l", F.count_if(left & tall).over(page)).withColumn("_r", F.count_if(~left & tall).over(page))
    out = out.withColumn("_top", F.min(y0).over(page)).withColumn("_h", F.greatest(F.lit(1.0), F.max(y1).over(page) - F.min(y0).over(page)))
    wide = F.col("bbox.x1") - F.col("bbox.x0") >= 220
    bucket = F.when((y0 <= F.col("_top") + F.col("_h") * 0.10) & wide, 0).when(y0 >= F.col("_top") + F.col("_h") * 0.82, 3).when(left, 1).otherwise(2)
    columns = (F.col("_l") >= 4) & (F.col("_r") >= 4)
    order = F.when(F.col("_n") < 8, F.struct(F.lit(0).alias("b"), F.col("region_pos").cast("double").alias("y"), F.lit(0.0).alias("x"))).otherwise(F.struct(F.when(columns, bucket).otherwise(0).alias("b"), y0.alias("y"), F.coalesce(F.col("bbox.x0"), F.lit(0.0)).alias("x")))
    return out.withColumn("_o", order).withColumn("reading_order", F.row_number().over(page.orderBy("_o", "region_pos")) - 1).drop("cut", "_n", "_l", "_r", "_top", "_h", "_o")


def segments(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Both kinds in one table: native (doc_id, page_number, block_index, text) and recognised (doc_id, page_number, candidate_index, quality, text)."""
    p = F.col("page_number").cast("string")
    n = native.select("doc_id", "page_number", F.format_string("P%sN%s", p, F.col("block_index").cast("string")).alias("segment_id"), F.lit("native").alias("source_kind"), "text", T.is_candidate(F.col("text")).alias("translate"))
    o = ocr.select("doc_id", "page_number", F.format_string("P%sO%sS1", p, F.col("candidate_index").cast("string")).alias("segment_id"), F.lit("ocr").alias("source_kind"), "text", F.col("quality").isin("usable", "review").alias("translate"))
    return n.unionByName(o)


def method_of(methods: Column) -> Column:
    """Of the chunks' methods: none, the only one, or mixed."""
    return F.when(F.size(methods) == 0, "skipped").when(F.size(methods) == 1, F.element_at(methods, 1)).otherwise("mixed")


#: Headers of tables, and what buttons say.
HEADERS = ["designation", "désignation", "quantite", "quantité", "unite", "unité", "prix ht", "total ht"]
CONTROLS = ["traduction complete", "ocr uniquement", "relecture humaine", "export debug", "valider"]


def is_control(c: Column) -> Column:
    return F.regexp_replace(F.lower(T.collapsed(c)), "^[ :]+|[ :]+$", "").isin(CONTROLS)


def is_list(c: Column) -> Column:
    cells = T.lines(c)
    marked = F.size(F.filter(cells, lambda x: F.rlike(x, F.lit(r"(?U)^(?:[-*•] |\d[.)] )"))))
    return (F.size(cells) >= 2) & (marked >= F.greatest(F.lit(2), F.size(cells) - 1))


def is_table_header(c: Column) -> Column:
    cells = F.array_distinct(F.transform(T.lines(c), lambda x: F.lower(T.collapsed(x))))
    return (F.size(T.lines(c)) >= 2) & (F.size(F.array_intersect(cells, F.array(*map(F.lit, HEADERS)))) >= 3)


def is_table_row(c: Column) -> Column:
    cells = T.lines(c)
    short = (F.length(c) <= 220) & F.forall(cells, lambda x: F.length(x) <= 80)
    return (F.size(cells) >= 2) & ~is_list(c) & short & (F.exists(cells, lambda x: F.rlike(x, F.lit(r"(?U)\d"))) | is_table_header(c))


def plan(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """The segments of both kinds, with role and whether to translate: (doc_id, page_number, segment_id, source_kind, source_ref, role, text, bbox, translate).

    native: doc_id, page_number, block_index, role, text, bbox, lines (text, bbox); a table's header gives a segment for each line, controls and table
    rows aren't translated. ocr: doc_id, page_number, candidate_index, ocr_status, quality, text, bbox.
    """
    p, b = F.col("page_number").cast("string"), F.col("block_index").cast("string")
    t = F.coalesce("text", F.lit(""))
    known = native.withColumn("_header", is_table_header(t) & (F.coalesce(F.size("lines"), F.lit(0)) > 0)).withColumn("_control", is_control(t)).withColumn("_row", is_table_row(t))
    role = F.when(F.col("_control"), "ui_control").when(F.col("_row"), "table_row").otherwise(F.coalesce("role", F.lit("content")))
    key = ["doc_id", "page_number"]
    whole = known.filter(~F.col("_header")).select(*key, F.format_string("P%sN%s", p, b).alias("segment_id"), F.lit("native").alias("source_kind"), F.concat(F.lit("block:"), b).alias("source_ref"), role.alias("role"), "text", "bbox", (~F.col("_control") & ~F.col("_row")).alias("translate"))
    cells = known.filter("_header").select(*key, "block_index", F.col("bbox").alias("_box"), F.posexplode("lines").alias("_i", "_l")).withColumn("text", T.strip(F.coalesce("_l.text", F.lit("")))).filter("text <> ''")
    i = (F.col("_i") + 1).cast("string")
    heads = cells.select(*key, F.format_string("P%sN%sL%s", p, b, i).alias("segment_id"), F.lit("native").alias("source_kind"), F.format_string("block:%s:line:%s", b, i).alias("source_ref"), F.lit("table_header_cell").alias("role"), "text", F.coalesce("_l.bbox", "_box").alias("bbox"), F.lit(True).alias("translate"))
    c = F.col("candidate_index").cast("string")
    wanted = F.coalesce((F.col("ocr_status") == "ok") & F.col("quality").isin("usable", "review"), F.lit(False))
    read = ocr.select(*key, F.format_string("P%sO%sS1", p, c).alias("segment_id"), F.lit("ocr").alias("source_kind"), F.concat(F.lit("ocr:"), c).alias("source_ref"), F.lit("ocr_region").alias("role"), "text", "bbox", wanted.alias("translate"))
    return whole.unionByName(heads).unionByName(read)
