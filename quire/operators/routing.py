"""Images worth reading, kinds of documents, routes of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles whose text is translated where it stands.
NATIVE_ROLES = ["content", "slide_title", "title", "section_step", "short_label", "list_item", "caption", "table_cell", "table_header", "figure_label"]


def ignored_reason(width: Column, height: Column, area_ratio: Column) -> Column:
    """Why an image isn't read, or null."""
    aspect = F.greatest(width / F.greatest(height, F.lit(1.0)), height / F.greatest(width, F.lit(1.0)))
    return F.when((width < 32) | (height < 24), "image_too_small_for_ocr").when(area_ratio < 0.01, "image_area_below_ocr_threshold").when(aspect > 8, "image_aspect_ratio_too_extreme")


def ignored_class(width: Column, height: Column, area_ratio: Column, reason: Column) -> Column:
    tiny = (area_ratio < 0.002) | (F.greatest(width, height) < 16)
    return (
        F.when(reason == "image_area_below_ocr_threshold", "illustration_or_figure")
        .when(reason == "image_aspect_ratio_too_extreme", "decorative")
        .when(reason == "image_too_small_for_ocr", F.when(tiny, "decorative").otherwise("too_small_for_ocr"))
        .when(reason.isNotNull(), "unknown")
    )


def split_images(images: DataFrame) -> DataFrame:
    """images: doc_id, page_number, image_index, width, height, area_ratio. Adds reason, classification, and an index of its own for each side of the split."""
    out = images.withColumn("reason", ignored_reason(F.col("width"), F.col("height"), F.col("area_ratio")))
    out = out.withColumn("classification", ignored_class(F.col("width"), F.col("height"), F.col("area_ratio"), F.col("reason")))
    w = Window.partitionBy("doc_id", "page_number", F.col("reason").isNull()).orderBy("image_index")
    return out.withColumn("candidate_index", F.when(F.col("reason").isNull(), F.row_number().over(w) - 1))


def document_kind(pages: DataFrame) -> DataFrame:
    """pages: doc_id, has_text, has_image -> pdf_kind. With neither it counts as hybrid."""
    text, image = F.max(F.col("has_text").cast("int")) == 1, F.max(F.col("has_image").cast("int")) == 1
    kind = F.when(text & ~image, "born_digital").when(image & ~text, "scanned").otherwise("hybrid")
    return pages.groupBy("doc_id").agg(kind.alias("pdf_kind"), F.count("*").alias("page_count"))


def route(image_count: Column, candidates: Column, blocks: Column, native: Column) -> Column:
    return (
        F.when((native > 0) & (candidates > 0), "native_plus_ocr_candidates")
        .when((native > 0) & (image_count > 0), "native_with_decorative_images")
        .when(native > 0, "native_only")
        .when(candidates > 0, "ocr_only")
        .when(image_count > 0, "image_only_no_ocr_candidates")
        .when(blocks > 0, "native_non_content_only")
        .otherwise("empty")
    )


def reasons(image_count: Column, candidates: Column, blocks: Column, native: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(native > 0, "has_native_content_blocks"),
            F.when(image_count > 0, "contains_raster_images"),
            F.when((image_count > 0) & (candidates == 0), "no_ocr_sized_image_regions"),
            F.when(candidates > 0, "has_ocr_candidate_regions"),
            F.when((blocks > 0) & (native == 0), "native_text_classified_as_non_content_only"),
        )
    )


def routing_report(pages: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """A row for each page: route, reasons and counts. pages: doc_id, page_number, raw_text, image_count; blocks with roles; images as split.

    Images that the page counts but that aren't listed add to the ignored ones.
    """
    key = ["doc_id", "page_number"]
    b = blocks.groupBy(*key).agg(F.count("*").alias("blocks"), F.count_if(F.coalesce("role", F.lit("content")).isin(NATIVE_ROLES)).alias("native"))
    i = images.groupBy(*key).agg(F.count_if(F.col("reason").isNull()).alias("candidates"), F.count_if(F.col("reason").isNotNull()).alias("ignored"))
    out = pages.join(b, key, "left").join(i, key, "left").fillna(0, ["blocks", "native", "candidates", "ignored", "image_count"])
    untracked = F.greatest(F.lit(0), F.col("image_count") - F.col("candidates") - F.col("ignored"))
    four = [F.col(c) for c in ("image_count", "candidates", "blocks", "native")]
    return out.select(
        *key, route(*four).alias("route"), reasons(*four).alias("reasons"), F.length(F.coalesce("raw_text", F.lit(""))).alias("native_text_chars"), "image_count", F.col("blocks").alias("block_count"), F.col("native").alias("content_blocks"),
        (F.col("blocks") - F.col("native")).alias("excluded_blocks"), F.col("candidates").alias("ocr_candidate_count"), (F.col("ignored") + untracked).alias("ignored_ocr_image_count"), untracked.alias("untracked_images"),
    )


def route_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("doc_id", "route").agg(F.count("*").alias("pages"))
