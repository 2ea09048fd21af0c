"""Titles, previews and plans on hand-made regions, with results worked out from the rules."""

import pytest
from pyspark.sql import functions as F

from quire.functions import chunks, glossary
from quire.functions import geometry as G
from quire.operators import extract, preview

REGION = f"doc_id string, page_number int, region_pos int, role string, source_text string, translate boolean, bbox {G.BOX}"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def regions(spark, *rows):
    return spark.createDataFrame([("d", 1, i, role, text, wanted, (0.0, 0.0, 400.0, 100.0)) for i, (role, text, wanted) in enumerate(rows)], REGION)


def lit_list(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize(
    ("text", "expected"),
    [("LES JONCTIONS", "THE JUNCTIONS"), (" CHAPITRE 2 :  LA DIODE ", "CHAPTER 2 : THE DIODE"), ("CELLULE EN DYNAMIQUE", "CELL UNDER DYNAMIC CONDITIONS"), ("L’EQUILIBRE", "L’EQUILIBRIUM"), ("autre", "autre"), ("", "")],
)
def test_titles(spark, text, expected):
    assert value(spark, glossary.title(F.lit(text))) == expected


def test_lists_hold_whole_texts_only(spark):
    assert value(spark, glossary.label(F.lit(" Contact ohmique\n"))) == "Ohmic contact"
    assert value(spark, glossary.label(F.lit("un contact ohmique"))) is None
    assert value(spark, glossary.outline(F.lit("1 - La Conductance de la jonction"))) == "1 - Junction conductance"


def test_words_shared_out_to_source_lines(spark):
    split = lambda text, *units: value(spark, chunks.to_source_lines(F.lit(text), lit_list(*units)))
    assert split("a b c d e f", 10, 20) == ["a b", "c d e f"]
    assert split("a b c", 100, 1, 1) == ["a", "b", "c"]
    assert split("a b c d e", 1, 1) == ["a b", "c d e"]  # 2.5 goes to the even number
    assert split("a b", 1, 1, 1) is None
    assert split("a b", 5) is None


def test_lines_cut_by_colours(spark):
    spans = lambda *xs: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(c).alias("color")) for t, c in xs])
    cut = lambda text, *xs: value(spark, chunks.by_colors(F.lit(text), spans(*xs)))
    assert [tuple(r) for r in cut("abcdefgh", ("xx", 1), (" ", 9), ("yyyyyy", 2))] == [("ab", 1), ("cdefgh", 2)]
    assert cut("abcdefgh", ("xx", 1), ("yy", 1)) is None
    assert cut(" ", ("xx", 1), ("yy", 2)) is None
    assert "".join(r.text for r in cut("abc", ("x", 1), ("y", 2), ("z", 3), ("w", 4))) == "abc"


def test_lines_by_budgets(spark):
    to = lambda text, *b: value(spark, chunks.to_budgets(F.lit(text), lit_list(*b) if b else F.array().cast("array<int>")))
    assert to("aa bb cc dd", 1, 1) == ["aa bb", "cc dd"]
    assert to("aa bb cc dd", 1, 3) == ["aa", "bb cc dd"]
    assert to("aa", 1, 1, 1) == ["aa", "", ""]
    assert to(" ", 2, 2) == ["", ""]
    assert to("aa") == []


def test_controls_go_unless_alone(spark):
    assert value(spark, chunks.without_controls(F.lit("o yes\nplain text\n[ ] no"))) == "plain text"
    assert value(spark, chunks.without_controls(F.lit("o yes"))) == "o yes"
    assert [tuple(r) for r in value(spark, chunks.for_drawing(F.lit("one two three\n\nab"), 7))] == [("one two", "ocr_text_chunk"), ("three", "ocr_text_chunk"), ("ab", "ocr_line")]


def test_cascade(spark):
    df = regions(spark, ("slide_title", "LA DIODE", True), ("diagram_label", "isotype", True), ("diagram_label", "Contact ohmique", True), ("diagram_label", "xyz", True), ("content", "Pour 4 personnes\nÉtape 2", True), ("content", " un texte [[X_1]]", True), ("content", "un texte", False))
    got = preview.translated(df, F.concat(F.lit("[[NEW_1]] "), "source_text")).orderBy("region_pos").collect()
    assert [(r.translated_text, r.status, r.translation_method, r.translation_attempt_count) for r in got] == [
        ("THE DIODE", "translated", "glossary", 0), ("isotype", "skipped", "glossary", 0), ("Ohmic contact", "translated", "glossary", 0), ("xyz", "skipped", "skipped", 0),
        ("For 4 people\nstep 2", "translated", "structural_fallback", 0), ("un texte [[X_1]]", "translated", "model", 1), ("un texte", "skipped", "skipped", 0),
    ]


def _slow(text):
    if len(text) > 8:
        raise TimeoutError
    return text.upper()


def test_fallbacks_after_a_timeout(spark):
    df = regions(spark, ("content", "un deux : trois ; sept", True), ("content", "Pour 2 personnes\nun deux", True), ("content", "un texte trop long", True), ("content", "un\nune ligne trop longue", True), ("content", "court", True))
    got = preview.translated(df, _slow).orderBy("region_pos").collect()
    assert [(r.translated_text, r.status, r.translation_method, r.translation_attempt_count) for r in got] == [
        ("UN DEUX : TROIS ; SEPT", "translated", "model", 4), ("For 2 people\nUN DEUX", "translated", "model", 2), ("[TIMEOUT] un texte trop long", "timeout", "timeout", 1),
        ("[TIMEOUT] un | une ligne trop longue", "timeout", "timeout", 3), ("COURT", "translated", "model", 1),
    ]


def test_plan_under_page_policies(spark):
    df = regions(spark, ("content", "un texte", True), ("content", "", False)).withColumn("translated_text", F.upper("source_text")).withColumn("status", F.when(F.col("translate"), "translated").otherwise("skipped"))
    pages = spark.createDataFrame([("d", 1, "hard_review")], "doc_id string, page_number int, status string")
    free = preview.replacement_plan(df).orderBy("replacement_index").collect()
    assert [(r.fit_risk, r.apply_strategy, r.render_decision) for r in free] == [("low", "native_overlay_candidate", "applied"), ("low", "native_skipped", "skipped_status")]
    held = preview.replacement_plan(df, pages).collect()
    assert {(r.page_apply_policy, r.render_decision) for r in held} == {("skip_overlay_hard_review", "skipped_page_policy")}


def test_fusion_from_segments_to_decisions(spark):
    box = (0.0, 0.0, 300.0, 100.0)
    rows = [("d", 1, "P1N0", "native", "content", "un texte", True, box), ("d", 1, "P1O0S1", "ocr", "ocr_region", "un texte lu", True, box), ("d", 1, "P1O1S1", "ocr", "ocr_region", "mal lu", False, box), ("d", 1, "P1O2S1", "ocr", "ocr_region", "coupe ici", True, box), ("d", 1, "P1O3S1", "ocr", "ocr_region", " ".join(["mot"] * 200), True, box), ("d", 1, "P1O4S1", "ocr", "ocr_region", None, True, box)]
    segments = spark.createDataFrame(rows, f"doc_id string, page_number int, segment_id string, source_kind string, role string, text string, translate boolean, bbox {G.BOX}")
    previewed = preview.fusion_preview(segments, F.upper("chunk")).withColumn("edge_clipping_line_count", F.when(F.col("segment_id") == "P1O2S1", 2).otherwise(0)).persist()
    assert {r.segment_id: (r.status, r.translation_chunk_count) for r in previewed.collect()} == {"P1N0": ("translated", 1), "P1O0S1": ("translated", 1), "P1O1S1": ("skipped", 0), "P1O2S1": ("translated", 1), "P1O3S1": ("translated", 2), "P1O4S1": ("skipped", 0)}
    plan = preview.fusion_decisions(preview.fusion_replacements(previewed))
    got = {r.segment_id: (r.render_decision, r.ocr_readiness_status, r.ocr_readiness_reasons) for r in plan.collect()}
    assert got == {
        "P1N0": ("applied_native_overlay", None, None),
        "P1O0S1": ("applied_ocr_overlay", "ready_for_image_overlay", ["recommendation=image_overlay_candidate", "translation_size_close_to_source", "low_fit_risk"]),
        "P1O1S1": ("annotated_ocr_review", "blocked", ["status=skipped"]),
        "P1O2S1": ("annotated_ocr_review", "blocked", ["edge_clipping_detected"]),
        "P1O3S1": ("annotated_ocr_side", "side_annotation_review", ["recommendation=side_annotation_recommended", "dense_text_for_region", "long_translation", "side_note_preserves_scanned_image"]),
        "P1O4S1": ("annotated_ocr_review", "blocked", ["status=skipped", "empty_translation"]),
    }
    page = preview.page_previews(previewed, preview.ocr_strategies(preview.fusion_replacements(previewed))).first()
    assert (page.segment_count, page.native_segment_count, page.ocr_segment_count, page.ready, page.side_review, page.manual_review, page.blocked) == (6, 1, 5, 1, 1, 0, 3)


def test_extraction_drops_blanks_and_numbers_anew(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    span = lambda *ts: (box, [(t,) for t in ts])
    rows = [("d", 1, 0, 0, box, [span(" a", " ", "b "), span("  ")], 595.0, 842.0), ("d", 1, 1, 0, box, [span(" ")], 595.0, 842.0), ("d", 1, 2, 1, (0.0, 0.0, 200.0, 200.0), [], 595.0, 842.0), ("d", 1, 3, 0, box, [span("c"), span("d")], 595.0, 842.0), ("d", 1, 4, 1, box, [], 595.0, 842.0)]
    raw = spark.createDataFrame(rows, f"doc_id string, page_number int, pos int, type int, bbox {G.BOX}, lines array<struct<bbox:{G.BOX},spans:array<struct<text:string>>>>, page_width double, page_height double")
    assert [(r.block_index, r.text) for r in extract.text_blocks(raw).orderBy("block_index").collect()] == [(0, "ab"), (1, "c\nd")]
    assert [(r.image_index, r.reason) for r in extract.images(raw).orderBy("image_index").collect()] == [(0, None), (1, "image_too_small_for_ocr")]
