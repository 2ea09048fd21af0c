"""Whether a translation fits its box, and what is done with it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T


class Sizes(NamedTuple):
    """What the rules ask of a source text, its translation and their box."""

    source_length: Column
    translated_length: Column
    source_lines: Column
    translated_lines: Column
    box_width: Column
    box_height: Column

    @property
    def area(self) -> Column:
        return self.box_width * self.box_height


def sizes(source: Column, translated: Column, box: Column) -> Sizes:
    return Sizes(T.text_length(source), T.text_length(translated), T.line_count(source), T.line_count(translated), G.width(box), G.height(box))


def measured(df: DataFrame, source: Column, translated: Column, box: Column) -> tuple[DataFrame, Sizes]:
    """The rows with the sizes as columns, so that rules go over numbers and texts are read once."""
    named = sizes(source, translated, box)._asdict()
    return df.withColumns(named), Sizes(*map(F.col, named))


def over(x: Sizes) -> Column:
    return F.when(x.source_length > 0, x.translated_length / x.source_length).otherwise(1.0)


def dense(x: Sizes) -> Column:
    """Characters per 1000 square points."""
    return F.when(x.area > 0, x.translated_length / x.area * 1000.0).otherwise(0.0)


def ratio(source: Column, translated: Column) -> Column:
    return over(sizes(source, translated, F.lit(None).cast(G.BOX)))


def density(translated: Column, box: Column) -> Column:
    return dense(sizes(translated, translated, box))


def flags_of(x: Sizes, line_ratio: Column | None = None, fitted: Column | None = None, source_size: Column | None = None, native: bool = True) -> Column:
    """Sorted flags. line_ratio, fitted and source_size come from font metrics; without them their flags don't arise."""
    found = [
        F.when(x.area <= 0, "missing_bbox"),
        F.when(x.translated_length == 0, "empty_translation"),
        F.when((x.source_length > 0) & (x.translated_length / F.greatest(x.source_length, F.lit(1)) > 1.6), "large_translation_expansion"),
        F.when(x.translated_length > 260, "long_translation"),
        F.when((x.source_lines > 0) & (x.translated_lines > x.source_lines + 1), "more_translated_lines_than_source"),
        F.when(dense(x) > 18.0, "dense_text_for_region"),
    ]
    if native:
        found.append(F.when((x.box_width < 24) | (x.box_height < 6), "very_small_region"))
        if line_ratio is not None:
            found += [F.when(line_ratio > 1.0, "translated_line_overflow"), F.when(line_ratio > 1.35, "severe_line_overflow")]
        if fitted is not None and source_size is not None:
            found.append(F.when(fitted <= source_size - 2.5, "requires_significant_font_shrink"))
    return F.array_sort(F.array_compact(F.array(*found)))


def flags(source: Column, translated: Column, box: Column, line_ratio: Column | None = None, fitted: Column | None = None, source_size: Column | None = None, native: bool = True) -> Column:
    return flags_of(sizes(source, translated, box), line_ratio, fitted, source_size, native)


def _any(flags: Column, *names: str) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, names)))


def native_risk(role: Column, status: Column, overflow: Column, flags: Column, dense: Column, line_ratio: Column | None = None) -> Column:
    lines = F.lit(0.0) if line_ratio is None else F.coalesce(line_ratio, F.lit(0.0))
    unlined = F.lit(True) if line_ratio is None else line_ratio.isNull()
    return (
        F.when(status == "timeout", "high")
        .when(status != "translated", "low")
        .when(_any(flags, "missing_bbox", "empty_translation", "severe_line_overflow"), "high")
        .when(_any(flags, "very_small_region") & (overflow > 1.15), "high")
        .when(_any(flags, "large_translation_expansion") & ((dense > 18.0) | (lines > 1.2)), "high")
        .when((dense > 24.0) & unlined, "high")
        .when((role == "slide_title") & (overflow <= 1.5), F.when(overflow > 1.1, "medium").otherwise("low"))
        .when(_any(flags, "translated_line_overflow", "requires_significant_font_shrink", "dense_text_for_region"), "medium")
        .when(overflow > 1.35, "high")
        .when(overflow > 1.1, "medium")
        .otherwise("low")
    )


def native_strategy(status: Column, risk: Column, flags: Column) -> Column:
    return (
        F.when(status == "timeout", "native_review_required")
        .when(status != "translated", "native_skipped")
        .when((risk == "high") | _any(flags, "missing_bbox", "empty_translation", "severe_line_overflow"), "native_review_required")
        .when(_any(flags, "translated_line_overflow", "requires_significant_font_shrink", "dense_text_for_region"), "native_overlay_with_fit_adjustment")
        .otherwise("native_overlay_candidate")
    )


def page_policy(readiness: Column) -> Column:
    return F.when(readiness == "soft_review", "apply_overlay_with_soft_review").when(readiness == "hard_review", "skip_overlay_hard_review").when(readiness == "blocked", "skip_overlay_blocked").otherwise("apply_overlay")


def render_decision(policy: Column, status: Column, strategy: Column, risk: Column, risks: tuple[str, ...] = ("low", "medium"), statuses: tuple[str, ...] = ("translated",)) -> Column:
    return (
        F.when(F.startswith(policy, F.lit("skip_overlay_")), "skipped_page_policy")
        .when(~F.coalesce(status.isin(*statuses), F.lit(False)), "skipped_status")
        .when(strategy.isin("native_review_required", "native_skipped"), "skipped_apply_strategy")
        .when(~F.coalesce(risk.isin(*risks), F.lit(False)), "skipped_fit_risk")
        .otherwise("applied")
    )


def fusion_risk_of(x: Sizes, kind: Column) -> Column:
    ratio, m = over(x), x.translated_length
    ocr = F.when(m == 0, "review").when((ratio > 1.6) | (m > 260), "high").when((ratio > 1.25) | (m > 180), "medium").otherwise("low")
    return F.when(kind == "ocr", ocr).otherwise(F.when(ratio > 1.35, "high").when(ratio > 1.1, "medium").otherwise("low"))


def fusion_risk(source: Column, translated: Column, kind: Column) -> Column:
    return fusion_risk_of(sizes(source, translated, F.lit(None).cast(G.BOX)), kind)


def ocr_strategy_of(x: Sizes, risk: Column, flags: Column) -> Column:
    a, d, m = x.area, dense(x), x.translated_length
    few_lines = x.translated_lines <= F.greatest(F.lit(3), x.source_lines + 1)
    return (
        F.when((m == 0) | (a <= 0) | _any(flags, "missing_bbox", "edge_clipping_detected"), "ocr_review_required")
        .when((a >= 35000) & (m <= 1200) & (d <= 18.0), "ocr_overlay_candidate")
        .when((m <= 140) & few_lines & (d <= 16.0), "ocr_overlay_candidate")
        .when(d > 22.0, "ocr_side_annotation")
        .when(risk.isin("low", "medium") & (d <= 18.0), "ocr_overlay_candidate")
        .otherwise("ocr_side_annotation")
    )


def ocr_strategy(source: Column, translated: Column, box: Column, risk: Column, flags: Column) -> Column:
    return ocr_strategy_of(sizes(source, translated, box), risk, flags)


def ocr_advice(x: Sizes, status: Column, risk: Column, overflow: Column, flags: Column, cut_lines: Column) -> Column:
    """struct(recommendation, reasons) for recognised text; the first thing that stands in the way is the reason for a manual review."""
    manual = lambda *reasons: F.struct(F.lit("manual_review").alias("recommendation"), F.array(*reasons).alias("reasons"))
    expands = overflow > 1.25
    side = F.array_compact(F.array(F.when(_any(flags, "dense_text_for_region"), "dense_text_for_region"), F.when(_any(flags, "long_translation"), "long_translation"), F.when(expands, "translation_expands_beyond_source_region")))
    side = F.when(F.size(side) == 0, F.array(F.concat(F.lit("fit_risk="), risk))).otherwise(side)
    return (
        F.when(~F.coalesce(status == "translated", F.lit(False)), manual(F.concat(F.lit("status="), F.coalesce(status, F.lit("missing")))))
        .when(x.translated_length == 0, manual(F.lit("empty_translation")))
        .when(x.area <= 0, manual(F.lit("missing_bbox")))
        .when(_any(flags, "edge_clipping_detected"), manual(F.lit("edge_clipping_detected"), F.concat(F.lit("edge_clipping_lines="), cut_lines.cast("string"))))
        .when((risk == "low") & ~expands & (x.translated_length <= 180), F.struct(F.lit("image_overlay_candidate").alias("recommendation"), F.array(F.lit("translation_size_close_to_source"), F.lit("low_fit_risk")).alias("reasons")))
        .otherwise(F.struct(F.lit("side_annotation_recommended").alias("recommendation"), F.array_append(side, F.lit("side_note_preserves_scanned_image")).alias("reasons")))
    )


def ocr_blocking(x: Sizes, status: Column, flags: Column) -> Column:
    """All that blocks recognised text from being drawn."""
    found = [
        F.when(~F.coalesce(status == "translated", F.lit(False)), F.concat(F.lit("status="), F.coalesce(status, F.lit("missing")))),
        F.when(x.translated_length == 0, "empty_translation"),
        F.when(x.area <= 0, "missing_bbox"),
        F.when(_any(flags, "edge_clipping_detected"), "edge_clipping_detected"),
    ]
    return F.array_compact(F.array(*found))


def ocr_recommendation(translated: Column, box: Column, status: Column, risk: Column, overflow: Column, clipped: Column) -> Column:
    t = T.strip(translated)
    return (
        F.when((status != "translated") | (t == "") | (G.area(box) <= 0) | clipped, "manual_review")
        .when((risk == "low") & (overflow <= 1.25) & (F.length(t) <= 180), "image_overlay_candidate")
        .otherwise("side_annotation_recommended")
    )


def ocr_readiness(translated: Column, box: Column, status: Column, clipped: Column, recommendation: Column) -> Column:
    blocked = (status != "translated") | (T.strip(translated) == "") | (G.area(box) <= 0) | clipped
    return F.when(blocked, "blocked").when(recommendation == "image_overlay_candidate", "ready_for_image_overlay").when(recommendation == "side_annotation_recommended", "side_annotation_review").otherwise("manual_review")
