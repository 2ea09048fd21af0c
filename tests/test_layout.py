"""The layout engine on hand-made pages, with results worked out from the rules."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import chunks, colors, pages
from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import fit, fusion, layout, pixels, roles, routing, translate
from quire.plans import queries, reports

LINES = "array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,spans:array<struct<text:string,font:string,size:double,flags:int,color:int>>>>"
BLOCKS = f"doc_id string, page_number int, width double, height double, block_index int, bbox {G.BOX}, text string, lines {LINES}"


def block(i, text, y0, y1, x0=0.0, x1=400.0, page=1, size=None, flags=0, cells=None, height=800.0, width=600.0):
    box = (float(x0), float(y0), float(x1), float(y1))
    lines = [(c, (x, float(y0), x + 40.0, float(y1)), []) for c, x in cells] if cells else [(text, box, [(text, "f", float(size), flags, 0)])] if size else []
    return ("d", page, width, height, i, box, text, lines)


def one(spark, column, **values):
    names = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def role_list(spark, rows):
    return [r.role for r in roles.roles(spark.createDataFrame(rows, BLOCKS)).orderBy("page_number", "block_index").collect()]


def test_repeats_on_many_pages(spark):
    rows = []
    for p in range(1, 26):
        rows += [block(0, f"ANNUAL REVIEW OF ALL THINGS {p}", 20, 40, page=p), block(1, f"some text that stands on page {p}", 300, 360, page=p), block(2, str(p), 760, 780, page=p)]
    got = role_list(spark, rows)
    assert got == ["slide_title", "repeated_chrome", "page_number"] * 25


def test_roles_of_an_invoice(spark):
    rows = [block(0, "vos coordonnées\nMme Exemple", 300, 330), block(1, "nous contacter au guichet", 340, 350), block(2, "Exemple SA au capital de 10 euros", 760, 780), block(3, "1 234,50 €", 400, 410), block(4, "un texte ordinaire qui suit", 420, 430), block(5, "12/03/2020", 440, 450), block(6, "Figure 3: a graph", 460, 470), block(7, "www.example.fr", 480, 490), block(8, "—", 500, 505), block(9, "AB", 510, 515), block(10, " arrow", 516, 520)]
    assert role_list(spark, rows) == ["sensitive_metadata", "support_metadata", "legal_footer", "numeric_value", "content", "billing_metadata", "caption", "support_metadata", "ornament", "diagram_token", "diagram_label"]


def test_roles_by_type(spark):
    rows = [block(0, "A readable heading", 100, 130, size=24), block(1, "Étape 1", 200, 220, size=18), block(2, "Ingrédients", 240, 250, size=12, flags=16), block(3, "200 g de farine", 260, 270, size=10), block(4, "1. mélanger le tout", 280, 290, size=10), block(5, "laisser reposer un moment.", 300, 310, size=10)]
    assert role_list(spark, rows) == ["title", "section_step", "short_label", "list_item", "list_item", "content"]


def test_table_runs(spark):
    rows = [block(0, "name of it\nprice of it\nnumber", 100, 110, cells=[("name of it", 0.0), ("price of it", 100.0), ("number", 200.0)]), block(1, "apples red\nthree euro\nmany", 120, 130, cells=[("apples red", 0.0), ("three euro", 100.0), ("many", 200.0)]), block(2, "a paragraph of text follows.", 140, 150)]
    assert role_list(spark, rows) == ["table_header", "table_cell", "content"]


def test_top_repeats_ties_by_place(spark):
    rows = [("d", p, i, t) for p in range(6) for i, t in enumerate(["b 1", "a", "b 2"])]
    got = roles.top_repeats(spark.createDataFrame(rows, "doc_id string, page_number int, block_index int, text string"), top=2).collect()
    assert [(r.norm_text, r.repeat_count) for r in got] == [("b {N}", 12), ("a", 6)]


def test_zones_and_readiness(spark):
    rows = [("d", 1, 200.0, 200.0, 0, (80.0, 80.0, 120.0, 120.0), "some content", "content"), ("d", 2, 200.0, 200.0, 0, (80.0, 2.0, 120.0, 12.0), "up here", "content"), ("d", 3, 200.0, 200.0, 0, (80.0, 100.0, 120.0, 110.0), "3", "page_number")]
    df = spark.createDataFrame(rows, f"doc_id string, page_number int, width double, height double, block_index int, bbox {G.BOX}, text string, role string")
    split = layout.split_blocks(df)
    flags = split.select("doc_id", "page_number", F.explode(layout.zone_flags(F.col("role"), F.col("vertical"), F.col("horizontal"), F.col("exclusion_reason"), F.lit(None).cast("string"))).alias("reason"), F.lit(None).cast("string").alias("group_type"))
    per = split.groupBy("doc_id", "page_number").agg(F.count_if("is_candidate").alias("candidates"))
    got = {r.page_number: (r.status, r.soft_review_items, r.hard_review_items) for r in layout.readiness(per, flags).collect()}
    assert got == {1: ("ready", 0, 0), 2: ("hard_review", 0, 1), 3: ("blocked", 0, 1)}
    assert one(spark, layout.severity(F.lit("review_candidate_order_moves_up_page"), F.lit("step_group")), a=1) == "soft_review"


def test_layout_groups():
    def c(role, y, x=20.0, text="text", lines=1, vertical="body_zone"):
        return {"role": role, "y0": y, "y1": y + 10, "x0": x, "x1": x + 100, "text": text, "line_count": lines, "vertical": vertical}

    page = [c("title", 20, vertical="header_zone"), c("content", 30, vertical="header_zone"), c("section_step", 100), c("short_label", 110), c("content", 120), c("list_item", 300, 260, "200 g flour"), c("list_item", 310, 260, "2 eggs"), c("short_label", 290, 260, "Ingrédients"), c("list_item", 320, 20, "1. mix it"), c("content", 340), c("table_header", 500), c("table_cell", 510), c("caption", 560, 300)]
    got = layout.group_page(page, 400.0, 600.0)
    assert got == [("table_group", [10, 11]), ("step_group", [2, 3, 4]), ("ingredient_list_group", [7, 5, 6]), ("instruction_group", [8, 9]), ("heading_group", [0, 1]), ("caption_group", [12])]


def test_blocks_at_one_place_keep_their_order():
    page = [{"role": "content" if i else "title", "y0": 40.0 + 7 * (i % 114), "y1": 46.0 + 7 * (i % 114), "x0": 40.0, "x1": 400.0, "text": "text", "line_count": 1, "vertical": "header_zone" if i % 114 < 12 else "body_zone"} for i in range(240)]
    kind, members = layout.group_page(page, 595.0, 842.0)[0]
    assert (kind, members) == ("heading_group", [i + n for i in range(12) for n in (0, 114, 228)])


def test_layout_groups_of_a_long_page_as_in_sql(spark, tmp_path):
    text = "\n".join(["A heading of the page", *(f"ordinary words of line {'abcdefghij'[i % 10] * (i // 10 + 1)} here." for i in range(239))])
    spark.createDataFrame([(1, text, "en", "src0", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["layout_groups"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries.ORACLES["layout_groups"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.filter("group_type = 'heading_group'").count() == 36


def test_titles_take_what_belongs_to_them(spark):
    rows = [("d", 1, 0, (0.0, 0.0, 100.0, 10.0), "A GREAT BIG TITLE", "slide_title", True), ("d", 1, 1, (105.0, 0.0, 115.0, 10.0), "12", "page_number", False), ("d", 1, 2, (0.0, 50.0, 100.0, 60.0), "text", "content", True), ("d", 1, 3, (105.0, 0.0, 115.0, 10.0), "13", "page_number", False)]
    got = layout.merge_titles(spark.createDataFrame(rows, f"doc_id string, page_number int, block_index int, bbox {G.BOX}, text string, role string, is_candidate boolean")).orderBy("block_index").collect()
    assert [(r.block_index, r.text) for r in got] == [(0, "A GREAT BIG TITLE 12"), (2, "text"), (3, "13")]


def test_reading_flow_flags(spark):
    rows = [("d", 1, i, 800.0, (x, y, x + 100.0, y + 10.0), r) for i, (x, y, r) in enumerate([(0.0, 100.0, "content"), (0.0, 400.0, "content"), (300.0, 100.0, "content"), (300.0, 120.0, "caption")])]
    got = layout.reading_flow(spark.createDataFrame(rows, f"doc_id string, page_number int, block_index int, height double, bbox {G.BOX}, role string")).orderBy("reading_order").collect()
    assert [r.flow for r in got] == ["single_column_flow", "single_column_flow", "multi_column_candidate", "floating_label_or_caption"]
    assert [r.flow_flags for r in got] == [[], ["review_large_vertical_gap_between_candidates"], ["review_candidate_order_moves_up_page"], []]


@pytest.mark.parametrize("w,h,page,reason,kind", [(100.0, 100.0, 200.0, None, None), (8.0, 8.0, 200.0, "image_too_small_for_ocr", "decorative"), (35.0, 25.0, 300.0, "image_area_below_ocr_threshold", "illustration_or_figure"), (300.0, 30.0, 300.0, "image_aspect_ratio_too_extreme", "decorative"), (30.0, 100.0, 200.0, "image_too_small_for_ocr", "too_small_for_ocr")])
def test_image_rules(spark, w, h, page, reason, kind):
    a = F.lit(w * h / (page * page))
    r = routing.ignored_reason(F.lit(w), F.lit(h), a)
    assert one(spark, r, a=1) == reason and one(spark, routing.ignored_class(F.lit(w), F.lit(h), a, r), a=1) == kind


def test_routes_and_kinds(spark):
    routes = [one(spark, routing.route(*map(F.lit, x)), a=1) for x in [(0, 0, 2, 1), (1, 1, 1, 1), (1, 1, 0, 0), (0, 0, 1, 0), (1, 0, 1, 1), (1, 0, 0, 0), (0, 0, 0, 0)]]
    assert routes == ["native_only", "native_plus_ocr_candidates", "ocr_only", "native_non_content_only", "native_with_decorative_images", "image_only_no_ocr_candidates", "empty"]
    df = spark.createDataFrame([("a", True, False), ("b", False, True), ("c", True, True), ("d", False, False)], "doc_id string, has_text boolean, has_image boolean")
    assert {r.doc_id: r.pdf_kind for r in routing.document_kind(df).collect()} == {"a": "born_digital", "b": "scanned", "c": "hybrid", "d": "hybrid"}


def test_masks(spark):
    text = "mail a@b.fr and a@b.fr, see https://x.y/z and 1.2.3 but 1.2 at 2020-01-02T03:04:05Z " + "ab" * 16
    p = one(spark, T.protected(F.col("t")), t=text)
    assert [i["kind"] for i in p["items"]] == ["email", "url", "commit", "iso_date", "version"]
    assert p["text"].startswith("mail [[EMAIL_1]] and a@b.fr, see [[URL_2]]") and " 1.2 at" in p["text"]
    df = spark.createDataFrame([(text,)], "t string").withColumn("p", T.protected(F.col("t")))
    row = df.select(T.restored(F.col("p.text"), F.col("p.items")).alias("back"), T.placeholders_kept(F.col("p.text"), F.col("p.items")).alias("kept"), T.placeholders_kept(F.lit("[[NEW_1]]"), F.slice("p.items", 1, 0)).alias("none")).first()
    assert row.back == text and row.kept and not row.none


def test_groups_and_batches(spark):
    lines = [("d", 1, 0, 0, "this sentence goes on"), ("d", 1, 0, 1, "until it ends here."), ("d", 1, 0, 2, "1. numbered line"), ("d", 1, 1, 0, "ab"), ("d", 1, 2, 0, "another long line of text")]
    segs = translate.segments(spark.createDataFrame(lines, "doc_id string, page_number int, block_pos int, line_pos int, text string"))
    out = translate.batches(translate.groups(segs), max_groups=2).orderBy("page_number", "block_pos", "group_no").collect()
    assert [(r.group_id, [m.segment_id for m in r.members], r.batch_no) for r in out] == [("P1B0G0", ["P1B0L0", "P1B0L1"], 0), ("P1B0G1", ["P1B0L2"], 0), ("P1B2G0", ["P1B2L0"], 1)]
    done = translate.apply_translations(segs, spark.createDataFrame([("d", "P1B0L2", "1. NUMBERED")], "doc_id string, segment_id string, translated_text string"))
    assert {r.segment_id: r.restored_text for r in done.collect()}["P1B0L2"] == "1. NUMBERED"

    def flaky(t):
        if "ends" in t:
            raise TimeoutError
        return t.upper()

    got = {r.segment_id: (r.translated_text, r.status) for r in translate.call_translator(segs, flaky).collect()}
    assert got["P1B0L0"] == ("THIS SENTENCE GOES ON", "translated") and got["P1B0L1"] == ("[TIMEOUT] until it ends here.", "timeout")


def test_answers(spark):
    x = one(spark, translate.parsed(F.col("t")), t="Translation:\n<GROUP 1>\n[P1B0L0] one\n[P1B0L1] two\n[P1B0L0] again\n</GROUP>\nstray")
    assert x["answers"] == {"P1B0L0": "again", "P1B0L1": "two"} and x["errors"] == ["stray"]


def test_fit(spark):
    box = lambda w, h: G.box(F.lit(0), F.lit(0), F.lit(w), F.lit(h))

    def plan(source, translated, b, status="translated", role="content"):
        s, t = F.lit(source), F.lit(translated)
        f = fit.flags(s, t, b)
        risk = fit.native_risk(F.lit(role), F.lit(status), fit.ratio(s, t), f, fit.density(t, b))
        strategy = fit.native_strategy(F.lit(status), risk, f)
        return one(spark, F.struct(risk, strategy, fit.render_decision(fit.page_policy(F.lit("ready")), F.lit(status), strategy, risk)), a=1)

    assert tuple(plan("bonjour le monde", "hello world", box(300, 40))) == ("low", "native_overlay_candidate", "applied")
    assert tuple(plan("bonjour", "[TIMEOUT] bonjour", box(2, 2), "timeout")) == ("high", "native_review_required", "skipped_status")
    assert tuple(plan("a text", "a text", box(0, 0))) == ("high", "native_review_required", "skipped_apply_strategy")
    clipped = fit.ocr_strategy(F.lit("abc"), F.lit("abc"), box(100, 100), F.lit("low"), F.array(F.lit("edge_clipping_detected")))
    assert one(spark, clipped, a=1) == "ocr_review_required"
    assert one(spark, fit.ocr_recommendation(F.lit("abc"), box(100, 100), F.lit("translated"), F.lit("low"), F.lit(1.0), F.lit(True)), a=1) == "manual_review"


def test_tsv(spark):
    tsv = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n1\t1\t0\t0\t0\t0\t0\t0\t200\t100\t-1\n5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t90\tHello\n5\t1\t1\t1\t1\t2\t50\t22\t148\t10\t80\tworld\n5\t1\t1\t1\t2\t1\t10\t40\t30\t10\t-1\tagain\n5\t1\t1\t1\t2\t2\t10\t40\t30\t10\t5\t \n"
    got = fusion.tsv_lines(fusion.parse_tsv(spark.createDataFrame([("d", tsv), ("e", "")], "doc_id string, tsv string"))).orderBy("line_index").collect()
    assert [(r.text, r.x0, r.y0, r.x1, r.y1, r.confidence, r.touches_right_edge, r.touches_left_edge) for r in got] == [("Hello world", 10, 20, 198, 32, 85.0, True, False), ("again", 10, 40, 40, 50, None, False, False)]


def test_fusion(spark):
    n = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "doc_id string, page_number int")
    o = spark.createDataFrame([("d", 2, "mixed"), ("d", 3, None)], "doc_id string, page_number int, route string")
    got = [(r.page_number, r.route, r.native_region_count, r.ocr_region_count) for r in fusion.fuse(n, o).orderBy("page_number").collect()]
    assert got == [(1, "native_only", 2, 0), (2, "mixed", 1, 1), (3, "ocr_only", 0, 1)]


def test_columns_are_read_one_after_the_other(spark):
    boxes = [(40.0 if i % 2 == 0 else 300.0, 100.0 + 20 * i) for i in range(10)]
    rows = [("d", 1, i, (x, y, x + 150.0, y + 14.0)) for i, (x, y) in enumerate(boxes)] + [("d", 1, 10, (40.0, 20.0, 500.0, 40.0)), ("d", 1, 11, (40.0, 420.0, 200.0, 430.0))] + [("d", 2, i, (0.0, 100.0 - i, 10.0, 120.0)) for i in range(3)]
    got = fusion.reading_order(spark.createDataFrame(rows, f"doc_id string, page_number int, region_pos int, bbox {G.BOX}")).orderBy("page_number", "reading_order").collect()
    assert [r.region_pos for r in got] == [10, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9, 11, 0, 1, 2]


def test_pixels():
    before = np.full((20, 30, 3), 255, np.uint8)
    after = before.copy()
    after[2:4, 2:4] = 0
    m = pixels.change_metrics(before, after, [(0, 0, 10, 10)], [])
    assert m["verdict"] == "clean" and m["changed_in_source_zone"] == 4 and m["changed_outside"] == 0
    assert pixels.change_metrics(before, after, [], [])["verdict"] == "unexpected_outside_changes"
    assert pixels.dominant_color(before) == ((255, 255, 255), 1.0)


def test_small_functions(spark):
    assert one(spark, T.normalized(F.col("t")), t="  page 12 of é12 \n") == "page {N} of é12"
    assert one(spark, chunks.by_words(F.col("t"), 7), t="aa bb cccccccccc dd e") == ["aa bb", "cccccccccc", "dd e"]
    assert one(spark, chunks.paragraphs(F.col("t"), 9), t="ab cd\n\nef\n\nlong words here") == ["ab cd\n\nef", "long", "words", "here"]
    assert one(spark, chunks.to_line_count(F.col("t"), F.lit(2)), t="aa bb cc dd") == ["aa bb", "cc dd"]
    assert one(spark, colors.base_font(F.lit("Times-BoldItalic")), a=1) == "tibo" and one(spark, colors.contrasting(F.lit(0)), a=1) == 0xFFFFFF
    assert one(spark, T.preview(F.col("t"), 8), t="abcdefghij") == "abcde..." and one(spark, T.without_artifacts(F.col("t")), t="  ? item\nwhat?") == "  - item\nwhat?"
    assert one(spark, T.is_heading_like(F.col("t")), t="A Short Heading") and not one(spark, T.is_heading_like(F.col("t")), t="a short Heading")
    assert [one(spark, T.ocr_quality(F.lit(t)), a=1) for t in ("", "one two", "a b c d ®®®", "word " * 20, "some words are here")] == ["empty", "weak", "review", "usable", "review"]
    assert pages.parse_pages("1, 3-5") == [(1, 1), (3, 5)] and pages.parse_pages("ALL") is None
    for bad in ("3-1", "0"):
        with pytest.raises(ValueError):
            pages.parse_pages(bad)
    assert one(spark, fusion.is_list(F.col("t")), t="- a\n- b\nc") and one(spark, fusion.is_table_row(F.col("t")), t="apples\n3")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, i, t, r) for i, (t, r) in enumerate([("one", "content"), ("two", "header"), ("three", "content")])], "doc_id string, page_number int, block_index int, text string, role string")
    audit = reports.page_audit(df).first()
    assert audit.roles == {"content": 2, "header": 1} and audit.content_examples == ["one", "three"] and audit.chars == 11
    assert reports.totals(df, "role").count() == 6
    reports.write_pair(df, str(tmp_path / "r"), "doc_id", "role")
    assert reports.read_report(spark, str(tmp_path / "r"), "doc_id string, role string").count() == 3
    assert [r.value for r in spark.read.text(str(tmp_path / "r/text")).collect()].count("doc_id=d role=content") == 2
    assert reports.violations(df, short="length(text) <= 3").count() == 1


def test_structural_texts(spark):
    from quire.functions import structural as S

    cases = {
        "Étape 3": "step 3", "Pour 4 personnes": "For 4 people", "INGRÉDIENTS": "Ingredients", "200 g de sucre": "200 g sugar", "3 cuillères à soupe d’café fort": "3 tbsp strong coffee", "2 œufs": "2 eggs", "2,5 kg de cacao amer": "2,5 kg unsweetened cocoa",
        "étape 1\n\n 2 oeufs ": "step 1\n2 eggs", "étape 1\nautre": None, "": None, "200 g de riz": None, None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    got = [r.s for r in df.select("i", S.structural(F.col("text")).alias("s")).orderBy("i").collect()]
    assert got == list(cases.values())
    rows = spark.createDataFrame([("a [[URL_1]]", " b [[URL_1]] "), ("a", "[[URL_2]] b   c\n\n [[URL_2]]\nd")], "s string, t string")
    assert [r.x for r in rows.select(S.sanitised(F.col("s"), F.col("t")).alias("x")).collect()] == ["b [[URL_1]]", "b c\nd"]


def test_fusion_plan_gates(spark):
    from quire.operators import fusion

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    native = spark.createDataFrame(
        [(1, 1, 0, "content", "Valider :", None, None), (1, 1, 1, "content", "Riz\n3 kg", None, None), (1, 1, 2, "content", "Quantité\nUnité\nPrix HT", None, [("Quantité", None), (" ", None), ("Prix HT", None)]), (1, 1, 3, None, "Un texte", None, None)],
        f"doc_id int, page_number int, block_index int, role string, text string, bbox {box}, lines array<struct<text:string,bbox:{box}>>",
    )
    ocr = spark.createDataFrame([(1, 1, 0, "ok", "usable", "x", None), (1, 1, 1, "ok", "weak", "y", None), (1, 1, 2, None, None, None, None)], f"doc_id int, page_number int, candidate_index int, ocr_status string, quality string, text string, bbox {box}")
    got = {r.segment_id: (r.role, r.translate, r.text) for r in fusion.plan(native, ocr).collect()}
    assert got == {
        "P1N0": ("ui_control", False, "Valider :"), "P1N1": ("table_row", False, "Riz\n3 kg"), "P1N2L1": ("table_header_cell", True, "Quantité"), "P1N2L3": ("table_header_cell", True, "Prix HT"), "P1N3": ("content", True, "Un texte"),
        "P1O0S1": ("ocr_region", True, "x"), "P1O1S1": ("ocr_region", False, "y"), "P1O2S1": ("ocr_region", False, None),
    }


def test_overlay_ready_counts_groups(spark):
    from quire.operators import layout

    box = lambda x, y, w=200, h=12: (float(x), float(y), float(x + w), float(y + h))
    rows = [(1, 1, 0, "table_header", "A\nB", box(40, 300)), (1, 1, 1, "table_cell", "1\n2", box(40, 320)), (1, 1, 2, "content", "moved", box(40, 100)), (1, 1, 3, "footer", "foot", box(40, 400)), (1, 2, 0, "footer", "x", box(40, 830))]
    blocks = spark.createDataFrame([(*r, 595.0, 842.0) for r in rows], "doc_id int, page_number int, block_index int, role string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, width double, height double")
    got = {r.page_number: r for r in layout.overlay_ready(layout.split_blocks(blocks)).collect()}
    a, b = got[1], got[2]
    assert (a.candidates, a.candidate_lines, a.excluded_blocks, a.layout_group_items, a.zone_items, a.status) == (3, 5, 1, 1, 2, "hard_review")
    # a header footer in the body and the block that moves up the page (header zone, order) are hard; the table group is soft
    assert a.review_items == a.zone_items + a.flow_items + 1 and a.soft_review_items >= 1 and b.status == "blocked"
