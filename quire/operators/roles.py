"""What a block is on its page: repeats, roles, table runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Patterns and words that tell roles apart.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"\b(?:https?://|www\.|[A-Za-z0-9.-]+\.(?:fr|com|net|org)\b)"
PHONE = r"\b(?:\d[\s.]){3,}\d\b"
CUSTOMER_ID = r"\bn[°o]\s*(?:de\s*)?(?:client|compte(?:\s+internet)?|ligne(?:\s+livebox)?)\b|\b(?:client|compte(?:\s+internet)?|ligne(?:\s+livebox)?)\s*:"
BILLING = r"\b(?:n[°o]\s*(?:de\s*)?facture|facture\s*n[°o]?|date de facture)"
CURRENCY = r"^[+\-]?\d[\d\s,.]*(?:€|eur|%)?$"
SHORT_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
POSTAL = r"\b\d{5}\s+[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ\s-]{2,}\b"
CAPTION = r"^(?:fig(?:ure)?\.?|tableau|table)\s*\d+\s*[:.-]"
LIST_ITEM = r"^\s*(?:[-•*]\s+|\d{1,2}[.)]\s+)"
QUANTITY = r"^\s*\d+(?:[,.]\d+)?\s*(?:g|kg|mg|l|ml|cl|v|a|ma|ua|µa|k|%|[A-Za-zÀ-ÖØ-öø-ÿ]{2,})\b"
SECTION_STEP = r"^\s*(?:étape|etape|step|phase|partie|section)\s+\d+\b"
LEGAL = ["rcs", "sa au capital", "siret"]
SUPPORT = ["nous contacter", "vos espaces clients", "service clients", "assistance technique", "contact.orange", "orange et moi", "orange.fr", "tarifs de vos communications", "tarifsetcontrats", "paiement facture"]

CANDIDATE_ROLES = ["content", "slide_title", "title", "section_step", "short_label", "list_item", "caption", "table_cell", "table_header", "diagram_label"]


def _has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit("(?U)" + pattern))


def _has_i(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit("(?iuU)" + pattern))


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def looks_like_list_item(t: Column) -> Column:
    return _has(t, LIST_ITEM) | ((F.length(t) <= 80) & _has_i(t, QUANTITY) & _has(t, "[A-Za-zÀ-ÖØ-öø-ÿ]"))


def repeat_counts(blocks: DataFrame) -> DataFrame:
    """Adds norm_text and repeat_count: blocks of the document with the same text but for numbers and spaces.

    Counted with partial sums and joined back, so a text that is in a third of all blocks is no hot task.
    """
    named = blocks.withColumn("norm_text", T.normalized(F.col("text")))
    counts = named.groupBy(F.col("doc_id").alias("_d"), F.col("norm_text").alias("_t")).agg(F.count("*").alias("repeat_count"))
    return named.join(counts, named["doc_id"].eqNullSafe(counts["_d"]) & named["norm_text"].eqNullSafe(counts["_t"])).drop("_d", "_t")


def top_repeats(blocks: DataFrame, least: int = 5, top: int = 10) -> DataFrame:
    """The most repeated texts of each document; of equally frequent ones those that come first."""
    counts = blocks.groupBy("doc_id", T.normalized(F.col("text")).alias("norm_text")).agg(F.count("*").alias("repeat_count"), F.min(F.struct("page_number", "block_index")).alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("repeat_count"), "first")
    return counts.filter(F.col("repeat_count") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("doc_id", "rank", "norm_text", "repeat_count")


def page_fonts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number) -> exact median and maximum of the sizes of all spans."""
    sizes = blocks.select("doc_id", "page_number", F.explode(F.flatten(F.transform("lines", lambda l: F.transform(l["spans"], lambda s: s["size"])))).alias("size"))
    return sizes.groupBy("doc_id", "page_number").agg(F.median("size").alias("page_median"), F.max("size").alias("page_max"))


def role_of(text: Column, norm: Column, reps: Column, page_height: Column, y0: Column, y1: Column, size: Column, bold: Column, median: Column, largest: Column) -> Column:
    """The first rule that fits decides."""
    t = T.strip(F.coalesce(text, F.lit("")))
    low, n = F.lower(t), F.length(t)
    ls = T.lines(t)
    compact = F.regexp_replace(t, "[\n ]", "")
    capitals = F.size(F.regexp_extract_all(t, F.lit("[A-ZÀ-ÖØ-Þ]{2,}"), F.lit(0)))
    tokens = F.filter(F.transform(F.split(t, r"\|"), T.strip), lambda x: x != "")
    big = (size >= median * 1.7) | ((y0 < page_height * 0.25) & (size >= median * 1.15) & ((largest <= 0) | (size >= largest * 0.9)))
    return (
        F.when(_has(t, r"^\d+$") | _has(low, r"^page\s*:\s*\d+\s*/\s*\d+$"), "page_number")
        .when(_has_i(t, CURRENCY), "numeric_value")
        .when((y1 > page_height * 0.92) & _any(low, LEGAL), "legal_footer")
        .when(_any(low, SUPPORT), "support_metadata")
        .when(_has_i(low, BILLING) | _has(t, SHORT_DATE), "billing_metadata")
        .when(F.contains(low, F.lit("vos coordonnées")) | _has_i(low, CUSTOMER_ID) | _has(t, EMAIL) | _has(t, PHONE) | _has(t, POSTAL), "sensitive_metadata")
        .when(_has(t, URL) & (n <= 120), "support_metadata")
        .when(_has_i(t, CAPTION), "caption")
        .when((F.length(compact) <= 3) & _has(compact, r"^[+\-=/|*A-ZΑ-Ωα-ω]+$"), "diagram_token")
        .when((y0 < page_height * 0.08) & (n >= 24) & (capitals >= 3), "slide_title")
        .when((y0 < page_height * 0.18) & reps.between(5, 79) & (n >= 20) & (capitals >= 3), "slide_title")
        .when((reps >= 20) & (y0 < page_height * 0.18), "header")
        .when((reps >= 20) & (y1 > page_height * 0.82), "footer")
        .when(t.isin("-", "–", "—"), "ornament")
        .when(_has_i(t, SECTION_STEP), "section_step")
        .when(looks_like_list_item(t), "list_item")
        .when((median > 0) & big & (n >= 8) & (F.size(ls) <= 2) & (y0 < page_height * 0.45) & ~F.contains(t, F.lit("@")), "title")
        .when((capitals >= 1) & (n <= 24) & _has(t, r"^[A-ZÀ-ÖØ-Þ0-9\s|+\-_/]+$"), "diagram_label")
        .when(F.contains(t, F.lit("|")) & (n <= 32) & (F.size(tokens) > 0) & F.forall(tokens, lambda x: F.length(x) <= 6), "diagram_label")
        .when(F.size(ls).between(2, 4) & F.forall(ls, lambda x: (F.length(x) <= 6) & _has(x, r"^[A-Za-zÀ-ÖØ-öø-ÿ0-9+\-=/|*.]+$")), "diagram_label")
        .when(F.contains(t, F.lit("\uf06e")), "diagram_label")
        .when((median > 0) & (F.size(ls) == 1) & n.between(3, 60) & (bold | (size >= median * 1.25)) & ~_has(t, "[.!?;:]$") & ~F.contains(t, F.lit("@")), "short_label")
        .when((reps >= 20) & (F.length(norm) < 80), "repeated_chrome")
        .otherwise("content")
    )


def roles(blocks: DataFrame) -> DataFrame:
    """Adds norm_text, repeat_count and role; blocks: doc_id, page_number, block_index, height, bbox, text, lines.

    Repeats are counted over whole documents, so pages must be selected after this. A block without spans has size 0.
    """
    counted = repeat_counts(blocks)
    if "lines" not in blocks.columns:
        counted = counted.withColumn("lines", F.lit(None).cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,spans:array<struct<text:string,font:string,size:double,flags:int,color:int>>>>"))
    fonts = page_fonts(counted)
    joined = counted.join(fonts, ["doc_id", "page_number"], "left")
    size = F.coalesce(F.array_max(F.transform(F.flatten(F.transform("lines", lambda l: l["spans"])), lambda s: s["size"])), F.lit(0.0))
    bold = F.coalesce(F.exists(F.flatten(F.transform("lines", lambda l: l["spans"])), lambda s: F.coalesce(s["flags"], F.lit(0)).bitwiseAND(16) != 0), F.lit(False))
    edge = lambda n: F.coalesce(F.col(f"bbox.{n}"), F.lit(0.0))
    role = role_of(F.col("text"), F.col("norm_text"), F.col("repeat_count"), F.coalesce("height", F.lit(0.0)), edge("y0"), edge("y1"), size, bold, F.coalesce("page_median", F.lit(0.0)), F.coalesce("page_max", F.lit(0.0)))
    return table_runs(joined.withColumn("role", role)).drop("page_median", "page_max")


def is_table_row(role: Column, lines: Column) -> Column:
    """Two or more lines on one height that start in different columns."""
    held = F.filter(lines, lambda l: (T.strip(F.coalesce(l["text"], F.lit(""))) != "") & l["bbox"].isNotNull())
    ys = F.transform(held, lambda l: (l["bbox"]["y0"] + l["bbox"]["y1"]) / 2)
    starts = F.array_distinct(F.transform(held, lambda l: F.bround(l["bbox"]["x0"] / 8)))
    return F.coalesce((role == "content") & (F.size(held) >= 2) & (F.array_max(ys) - F.array_min(ys) <= 4.0) & (F.size(starts) >= 2), F.lit(False))


def table_runs(blocks: DataFrame, row: Column | None = None) -> DataFrame:
    """Runs of two or more table rows: the first becomes table_header, the others table_cell. Islands within a page."""
    page = Window.partitionBy("doc_id", "page_number").orderBy("block_index")
    marked = blocks.withColumn("_row", is_table_row(F.col("role"), F.col("lines")) if row is None else row)
    islands = marked.withColumn("_turn", F.sum(F.when(F.col("_row") == F.coalesce(F.lag("_row").over(page), ~F.col("_row")), 0).otherwise(1)).over(page))
    island = Window.partitionBy("doc_id", "page_number", "_turn")
    sized = islands.withColumn("_n", F.count("*").over(island)).withColumn("_i", F.row_number().over(island.orderBy("block_index")))
    run = F.col("_row") & (F.col("_n") >= 2)
    return sized.withColumn("role", F.when(run & (F.col("_i") == 1), "table_header").when(run, "table_cell").otherwise(F.col("role"))).drop("_row", "_turn", "_n", "_i")


def role_summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "role").agg(F.count("*").alias("blocks"))
