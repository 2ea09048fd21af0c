"""Regions translated by rules first and by a translator where none fits, line by line under their source lines, and the plan to replace them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import chunks, glossary, structural
from quire.functions import text as T
from quire.operators import fit

KEY = ["doc_id", "page_number"]
#: Fixed value: where a line that timed out is divided.
CLAUSES = re.compile(r"(\s*[:;,]\s*)")
_MODEL = "translated_text string, status string, translation_method string, translation_attempt_count int"


def by_rule(text: Column, role: Column, translate: Column) -> Column:
    """struct(text, status, method) of what needs no translator, else null: what stays, titles, labels of diagrams, then outline, label and structure."""
    done = lambda t, method, status="translated": F.struct(t.alias("text"), F.lit(status).alias("status"), F.lit(method).alias("method"))
    found = lambda t, method: T.let(t, lambda v: F.when(v.isNotNull(), done(v, method)))
    label = glossary.label(text)
    shown = T.strip(F.coalesce(label, text))
    return (
        F.when(~F.coalesce(translate, F.lit(True)), done(text, "skipped", "skipped"))
        .when(role == "slide_title", done(glossary.title(text), "glossary"))
        .when(role == "diagram_label", F.struct(shown.alias("text"), F.when(shown != text, "translated").otherwise("skipped").alias("status"), F.when(label.isNull(), "skipped").otherwise("glossary").alias("method")))
        .otherwise(F.coalesce(found(glossary.outline(text), "outline_fallback"), found(label, "glossary"), found(structural.structural(text), "structural_fallback")))
    )


def with_fallback(text: str, known: list[str | None], translate: Callable[[str], str]) -> tuple[str, str, str, int]:
    """A translator's answer; on a timeout a single line is asked for by clauses, several lines one by one unless a rule knows them."""
    tries = 0

    def ask(t: str) -> str:
        nonlocal tries
        tries += 1
        return translate(t)

    try:
        return ask(text), "translated", "model", tries
    except TimeoutError:
        pass
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    parts = [p for p in CLAUSES.split(lines[0]) if p] if len(lines) == 1 else []
    try:
        if len(parts) > 1:
            return "".join(p if CLAUSES.fullmatch(p) else ask(p.strip()) for p in parts), "translated", "model", tries
        if len(lines) > 1:
            before = tries
            out = [k if k is not None else ask(x) for x, k in zip(lines, known, strict=True)]
            return "\n".join(out), "translated", "model" if tries > before else "structural_fallback", tries
    except TimeoutError:
        pass
    return f"[TIMEOUT] {text.replace(chr(10), ' | ')}", "timeout", "timeout", tries


def translated(regions: DataFrame, translate: Callable[[str], str] | Column) -> DataFrame:
    """Adds translated_text, status, translation_method and translation_attempt_count. regions: role, source_text, translate.

    A column in place of a function is a translator that never fails and runs in the engine. Only rows that no rule knows are sent to a function.
    """
    src = F.col("source_text")
    ruled = regions.withColumn("_rule", by_rule(src, F.col("role"), F.col("translate")))
    skipped = F.col("_rule.status") == "skipped"
    clean = F.when(skipped, F.col("_rule.text")).otherwise(structural.sanitised(src, F.col("_rule.text")))
    of_rule = [clean.alias("translated_text"), F.col("_rule.status").alias("status"), F.col("_rule.method").alias("translation_method"), F.lit(0).alias("translation_attempt_count")]
    if isinstance(translate, Column):
        asked = [structural.sanitised(src, translate), F.lit("translated"), F.lit("model"), F.lit(1)]
        return ruled.select(*regions.columns, *[F.when(F.col("_rule").isNull(), a).otherwise(r).alias(n) for a, r, n in zip(asked, of_rule, ("translated_text", "status", "translation_method", "translation_attempt_count"))])
    rest = ruled.filter("_rule is null").drop("_rule").withColumn("_known", F.transform(T.lines(src), structural.line))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", " + _MODEL

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [with_fallback(t, list(k), translate) for t, k in zip(frame["source_text"], frame["_known"])]
            yield frame.assign(**{n: [g[i] for g in got] for i, n in enumerate(("translated_text", "status", "translation_method", "translation_attempt_count"))})

    sent = rest.mapInPandas(run, schema).drop("_known").withColumn("translated_text", structural.sanitised(src, F.col("translated_text")))
    return ruled.filter("_rule is not null").select(*regions.columns, *of_rule).unionByName(sent)


def translated_lines(text: Column, status: Column, method: Column, source_lines: Column) -> Column:
    """The texts under the source lines, or null: as many lines as there were, else words shared out by the lines' lengths, else the whole under a lone line."""
    own, n = T.lines(text), F.size(source_lines)
    shared = chunks.to_source_lines(text, F.transform(source_lines, lambda x: F.greatest(F.lit(1), F.length(T.strip(x)))))
    by_model = (status == "translated") & (n > 0)
    return F.when(status == "skipped", source_lines).when(by_model, F.when(F.size(own) == n, own).when(shared.isNotNull(), shared).when(n == 1, F.array(text)))


def replacement_plan(regions: DataFrame, readiness: DataFrame | None = None) -> DataFrame:
    """A row for each region, numbered on its page, with fit, strategy, its page's policy and whether it is drawn.

    regions: doc_id, page_number, region_pos, role, source_text, translated_text, status, bbox; readiness: doc_id, page_number, status of pages; a
    page without one is ready. Texts are measured once, in a projection of their own.
    """
    page = Window.partitionBy(*KEY).orderBy("region_pos")
    rows = regions.withColumn("replacement_index", F.row_number().over(page))
    if readiness is None:
        rows = rows.withColumn("page_status", F.lit("ready"))
    else:
        pages = readiness.select(*KEY, F.col("status").alias("_ready"))
        rows = rows.join(pages, KEY, "left").withColumn("page_status", F.coalesce("_ready", F.lit("ready"))).drop("_ready")
    rows, size = fit.measured(rows, F.col("source_text"), F.col("translated_text"), F.col("bbox"))
    rows = rows.withColumn("overflow_ratio", fit.over(size)).withColumn("chars_per_1000pt2", F.round(fit.dense(size), 2)).withColumn("flags", fit.flags_of(size))
    rows = rows.withColumn("fit_risk", fit.native_risk(F.col("role"), F.col("status"), F.col("overflow_ratio"), F.col("flags"), F.col("chars_per_1000pt2")))
    rows = rows.withColumn("apply_strategy", fit.native_strategy(F.col("status"), F.col("fit_risk"), F.col("flags"))).withColumn("page_apply_policy", fit.page_policy(F.col("page_status")))
    return rows.withColumn("render_decision", fit.render_decision(F.col("page_apply_policy"), F.col("status"), F.col("apply_strategy"), F.col("fit_risk")))


# segments of both kinds


def fusion_preview(segments: DataFrame, translate: Column) -> DataFrame:
    """Adds status, translated_text, translation_chunk_count, translation_method and translation_attempt_count to segments (source_kind, text, translate).

    Recognised text is translated in chunks of paragraphs, native text as a whole; a chunk by its structural rule or by ``translate``, an
    expression over the column ``chunk``, around masked values. One row for each chunk, brought together again by segment.
    """
    key = [*KEY, "segment_id"]
    text = F.coalesce("text", F.lit(""))
    wanted = F.coalesce("translate", F.lit(True))
    parts = F.when(~wanted, F.array().cast("array<string>")).when(F.col("source_kind") == "ocr", chunks.paragraphs(text)).otherwise(F.array(text))
    rows = segments.select(*key, F.posexplode(parts).alias("i", "source")).withColumn("p", T.protected(F.col("source"))).withColumn("chunk", F.col("p.text"))
    rows = rows.withColumn("_rule", structural.structural(F.col("source"))).withColumn("out", F.coalesce("_rule", T.restored(translate, F.col("p.items"))))
    method = F.when(F.col("_rule").isNull(), "model").otherwise("structural_fallback")
    done = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("i", "out"))).alias("outs"), F.collect_set(method).alias("methods"), F.count("*").cast("int").alias("translation_chunk_count"), F.count_if(F.col("_rule").isNull()).alias("translation_attempt_count")
    )
    joined = segments.join(done, key, "left").fillna(0, ["translation_chunk_count", "translation_attempt_count"])
    some = F.col("translation_chunk_count") > 0
    whole = F.array_join(F.transform("outs", lambda x: x["out"]), "\n\n")
    return (
        joined.withColumn("status", F.when(some, "translated").otherwise("skipped"))
        .withColumn("translated_text", F.when(some, whole).otherwise(text))
        .withColumn("translation_method", F.when(~some, "skipped").when(F.size("methods") == 1, F.element_at("methods", 1)).otherwise("mixed"))
        .drop("outs", "methods")
    )


def fusion_replacements(previewed: DataFrame) -> DataFrame:
    """A row for each segment, numbered on its page, with fit risk and strategy, and for recognised ones recommendation, readiness and their reasons.

    previewed: as fusion_preview gives it, with bbox, and edge_clipping_line_count if lines were found to be cut off.
    """
    page = Window.partitionBy(*KEY).orderBy("source_kind", "segment_id")
    rows = previewed.withColumn("replacement_index", F.row_number().over(page))
    if "edge_clipping_line_count" not in rows.columns:
        rows = rows.withColumn("edge_clipping_line_count", F.lit(0))
    rows, size = fit.measured(rows, F.coalesce("text", F.lit("")), F.col("translated_text"), F.col("bbox"))
    ocr, clipped = F.col("source_kind") == "ocr", F.coalesce(F.col("edge_clipping_line_count") > 0, F.lit(False))
    flags = fit.flags_of(size, native=False)
    flags = F.when(ocr & clipped, F.array_sort(F.array_append(flags, F.lit("edge_clipping_detected")))).otherwise(flags)
    rows = rows.withColumn("overflow_ratio", fit.over(size)).withColumn("chars_per_1000pt2", F.round(fit.dense(size), 2)).withColumn("flags", flags).withColumn("fit_risk", fit.fusion_risk_of(size, F.col("source_kind")))
    rows = rows.withColumn("apply_strategy", F.when(ocr, fit.ocr_strategy_of(size, F.col("fit_risk"), F.col("flags"))).otherwise("native_overlay_candidate"))
    advice = fit.ocr_advice(size, F.col("status"), F.col("fit_risk"), F.round("overflow_ratio", 2), F.col("flags"), F.col("edge_clipping_line_count"))
    rows = rows.withColumn("_a", F.when(ocr, advice)).withColumn("ocr_recommendation", F.col("_a.recommendation")).withColumn("ocr_recommendation_reasons", F.col("_a.reasons")).drop("_a")
    blocking = fit.ocr_blocking(size, F.col("status"), F.col("flags"))
    status = F.when(F.size(blocking) > 0, "blocked").when(F.col("ocr_recommendation") == "image_overlay_candidate", "ready_for_image_overlay").when(F.col("ocr_recommendation") == "side_annotation_recommended", "side_annotation_review").otherwise("manual_review")
    reasons = F.when(F.size(blocking) > 0, blocking).otherwise(F.concat(F.array(F.concat(F.lit("recommendation="), "ocr_recommendation")), "ocr_recommendation_reasons"))
    return rows.withColumn("ocr_readiness_status", F.when(ocr, status)).withColumn("ocr_readiness_reasons", F.when(ocr, reasons))


def ocr_strategies(replacements: DataFrame) -> DataFrame:
    """The decisions on recognised segments."""
    columns = [*KEY, "segment_id", "status", "fit_risk", "overflow_ratio", "flags", "ocr_recommendation", "ocr_recommendation_reasons", "ocr_readiness_status", "ocr_readiness_reasons"]
    return replacements.filter("source_kind = 'ocr'").select(*columns, T.preview(F.col("translated_text"), 220).alias("translated_preview"))


def page_previews(previewed: DataFrame, strategies: DataFrame) -> DataFrame:
    """A row for each page: segments of both kinds and, of recognised ones with a decision, counts by readiness."""
    known = strategies.select(*KEY, "segment_id", "ocr_readiness_status")
    rows = previewed.join(known, [*KEY, "segment_id"], "left")
    count = lambda status: F.count_if(F.col("ocr_readiness_status") == status)
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("segment_count"), F.count_if(F.col("source_kind") != "ocr").alias("native_segment_count"), F.count_if(F.col("source_kind") == "ocr").alias("ocr_segment_count"),
        count("ready_for_image_overlay").alias("ready"), count("side_annotation_review").alias("side_review"), count("manual_review").alias("manual_review"), count("blocked").alias("blocked"),
    )


def fusion_decisions(replacements: DataFrame, risks: tuple[str, ...] = ("low", "medium")) -> DataFrame:
    """Adds render_decision, in the order in which a renderer asks: box, status, native risk, and what is recommended for recognised text."""
    box = F.col("bbox")
    empty = F.coalesce((box["x1"] <= box["x0"]) | (box["y1"] <= box["y0"]), F.lit(True))
    ocr, native = F.col("source_kind") == "ocr", F.col("apply_strategy") == "native_overlay_candidate"
    allowed = F.col("fit_risk").isin(*risks) | F.coalesce(F.col("role") == "table_header_cell", F.lit(False))
    decision = (
        F.when(empty, "skipped_missing_bbox")
        .when(~ocr & ~F.coalesce(F.col("status") == "translated", F.lit(False)), "skipped_status")
        .when(native & allowed, "applied_native_overlay")
        .when(native, "skipped_native_fit_risk")
        .when(~ocr, "skipped_apply_strategy")
        .when(F.col("ocr_recommendation") == "image_overlay_candidate", "applied_ocr_overlay")
        .when(F.col("ocr_recommendation") == "manual_review", "annotated_ocr_review")
        .otherwise("annotated_ocr_side")
    )
    return replacements.withColumn("render_decision", decision)
