"""The layout engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import structural as S
from quire.functions import text as T
from quire.operators import extract, fit, fusion, layout, preview, roles, routing, translate
from quire.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]


def repeat_counts(spark: SparkSession, d: str) -> DataFrame:
    return roles.repeat_counts(A.document_blocks(spark, d)).select("doc_id", "page_number", "block_index", "norm_text", "repeat_count")


def top_repeats(spark: SparkSession, d: str) -> DataFrame:
    return roles.top_repeats(A.document_blocks(spark, d))


def block_roles(spark: SparkSession, d: str) -> DataFrame:
    return roles.roles(A.document_blocks(spark, d)).select("doc_id", "page_number", "block_index", "role", "repeat_count")


def role_summary(spark: SparkSession, d: str) -> DataFrame:
    return roles.role_summary(roles.roles(A.document_blocks(spark, d)))


def table_runs(spark: SparkSession, d: str) -> DataFrame:
    """Binding: a line of a document with a vertical bar is a table row."""
    b = A.document_blocks(spark, d).withColumn("role", F.lit("content"))
    return roles.table_runs(b, F.contains("text", F.lit("|"))).select("doc_id", "page_number", "block_index", "role")


def zone_counts(spark: SparkSession, d: str) -> DataFrame:
    b = layout.split_blocks(A.document_blocks(spark, d).withColumn("role", F.lit("content")))
    return layout.zone_summary(b).groupBy("doc_id", "dimension", "zone").agg(F.sum("blocks").alias("blocks"))


def reading_flow(spark: SparkSession, d: str) -> DataFrame:
    b = A.document_blocks(spark, d).withColumn("role", F.lit("content")).filter(T.is_candidate(F.col("text")))
    out = layout.reading_flow(b)
    return out.select("doc_id", "page_number", "block_index", "reading_order", "flow", F.array_join("flow_flags", ",").alias("flags"))


def layout_groups(spark: SparkSession, d: str) -> DataFrame:
    split = layout.split_blocks(roles.roles(A.document_blocks(spark, d))).filter("is_candidate")
    return layout.layout_groups(split)


def page_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Roles, zones, groups and reading flow together, down to each page's counts and status."""
    return layout.overlay_ready(layout.split_blocks(roles.roles(A.document_blocks(spark, d))))


def structural_lines(spark: SparkSession, d: str) -> DataFrame:
    """Binding: a line of an order as a quantity, a step or a text without rule."""
    li = A.table(spark, d, "lineitem")
    item = F.when(F.col("l_returnflag") == "A", "sucre vanillé").when(F.col("l_returnflag") == "R", "Œufs").otherwise("riz")
    n = F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Étape  "), n)).when(F.col("l_linenumber") % 2 == 0, F.concat(n, F.lit(" g de "), item)).otherwise(F.concat(n, F.lit(" "), item))
    return li.select("l_orderkey", "l_linenumber", S.structural(text).alias("translated"))


def image_rules(spark: SparkSession, d: str) -> DataFrame:
    out = routing.split_images(A.order_images(spark, d))
    return out.select("page_number", "image_index", "reason", "classification", "candidate_index")


def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Binding: a customer is a document, an order a page; urgent ones have text, large ones an image."""
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderpriority") == "1-URGENT").alias("has_text"), (F.col("o_totalprice") > 200_000).alias("has_image"))
    return routing.document_kind(o)


def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """Binding: an order is a page, its lines are blocks by return flag, a customer is an image on the page of its number; urgent pages hold no images."""
    pages = A.table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("page_number"), F.lit("").alias("raw_text"), F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(2).alias("image_count"))
    role = F.when(F.col("l_returnflag") == "A", "content").when(F.col("l_returnflag") == "R", "header").otherwise("footer")
    blocks = A.table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("page_number"), role.alias("role"))
    w, h = F.abs("c_acctbal").cast("double") / 10, (F.col("c_nationkey") * 10 + 10).cast("double")
    images = A.table(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("doc_id"), F.col("c_custkey").alias("page_number"), F.lit(0).alias("image_index"), w.alias("width"), h.alias("height"), (w * h / (595.0 * 842.0)).alias("area_ratio"))
    return routing.routing_report(pages, blocks, routing.split_images(images)).withColumn("reasons", F.array_join("reasons", ","))


def translation_gate(spark: SparkSession, d: str) -> DataFrame:
    b = A.document_blocks(spark, d)
    return b.groupBy("doc_id").agg(F.count_if(T.is_candidate(F.col("text"))).alias("candidates"), F.count_if(T.is_symbolic(F.col("text"))).alias("symbolic"), F.count("*").alias("blocks"))


def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", T.ocr_quality(F.col("text")).alias("quality"))


def masked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts masked and unmasked again; the keys are kept by a mock translation."""
    p = A.table(spark, d, "documents").select("doc_id", "text", T.protected(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p.items").alias("masked"), T.placeholders_kept(translate.mock(F.col("p.text")), F.col("p.items")).alias("kept"), (T.restored(F.col("p.text"), F.col("p.items")) == F.col("text")).alias("same"))


def translation_batches(spark: SparkSession, d: str) -> DataFrame:
    g = translate.groups(translate.segments(A.conversation_lines(spark, d)))
    return translate.batches(g).select("doc_id", "group_id", F.size("members").alias("lines"), "chars", "batch_no")


def replacement_plan(spark: SparkSession, d: str) -> DataFrame:
    """Fit, risk, strategy and decision of each block under a mock translation."""
    b = A.document_blocks(spark, d).withColumn("translated", translate.mock(F.col("text")))
    planned, size = fit.measured(b, F.col("text"), F.col("translated"), F.col("bbox"))
    planned = planned.withColumn("status", F.when(size.source_length == 0, "skipped").otherwise("translated")).withColumn("flags", fit.flags_of(size)).withColumn("overflow", fit.over(size)).withColumn("dense", fit.dense(size))
    planned = planned.withColumn("fit_risk", fit.native_risk(F.lit("content"), F.col("status"), F.col("overflow"), F.col("flags"), F.col("dense")))
    planned = planned.withColumn("strategy", fit.native_strategy(F.col("status"), F.col("fit_risk"), F.col("flags")))
    planned = planned.withColumn("decision", fit.render_decision(fit.page_policy(F.lit("ready")), F.col("status"), F.col("strategy"), F.col("fit_risk")))
    return planned.groupBy("fit_risk", "strategy", "decision").agg(F.count("*").alias("blocks"))


def ocr_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one recognised region of its page."""
    docs = A.table(spark, d, "documents").select("doc_id", "text", translate.mock(F.col("text")).alias("out"), G.box(F.lit(0), F.lit(0), F.lit(300), F.lit(150)).alias("box"))
    rows, size = fit.measured(docs, F.col("text"), F.col("out"), F.col("box"))
    rows = rows.withColumn("status", F.lit("translated")).withColumn("flags", fit.flags_of(size, native=False)).withColumn("fit_risk", fit.fusion_risk_of(size, F.lit("ocr"))).withColumn("over", fit.over(size))
    rows = rows.withColumn("strategy", fit.ocr_strategy_of(size, F.col("fit_risk"), F.col("flags")))
    rows = rows.withColumn("recommendation", fit.ocr_advice(size, F.col("status"), F.col("fit_risk"), F.col("over"), F.col("flags"), F.lit(0))["recommendation"])
    ready = F.when(F.size(fit.ocr_blocking(size, F.col("status"), F.col("flags"))) > 0, "blocked").when(F.col("recommendation") == "image_overlay_candidate", "ready_for_image_overlay").when(F.col("recommendation") == "side_annotation_recommended", "side_annotation_review").otherwise("manual_review")
    return rows.select("doc_id", "fit_risk", "strategy", "recommendation", ready.alias("readiness"))


def translation_preview(spark: SparkSession, d: str) -> DataFrame:
    """Binding: a line of an order as a region; its number says which of the rules, or the mock translator, is to meet it."""
    return preview.translated(_regions(spark, d), translate.mock(F.col("source_text"))).select("doc_id", "page_number", "region_pos", "translated_text", "status", "translation_method", "translation_attempt_count")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    li, n = A.table(spark, d, "lineitem"), F.col("l_quantity").cast("int").cast("string")
    i = F.col("l_linenumber")
    text = (
        F.when(i == 1, F.concat(F.lit("LES DIODES DE LA CELLULE "), n))
        .when(i == 2, "Nous aborderons donc le calcul de :")
        .when(i == 3, " Zone de transition ")
        .when(i == 4, F.concat(F.lit("Étape "), n, F.lit("\nPour "), n, F.lit(" personnes")))
        .when(i == 7, F.concat(F.lit("Diode "), n))
        .otherwise(F.concat(F.lit("texte  "), n, F.lit(" ")))
    )
    role = F.when(i == 1, "slide_title").when(i == 7, "diagram_label").otherwise("content")
    return li.select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("page_number"), i.alias("region_pos"), role.alias("role"), text.alias("source_text"), (i != 6).alias("translate"))


def native_plan(spark: SparkSession, d: str) -> DataFrame:
    """Roles, readiness, preview by rules and a mock translator, and the plan under each page's policy."""
    split = layout.split_blocks(roles.roles(A.document_blocks(spark, d)))
    regions = split.filter("is_candidate").select("doc_id", "page_number", F.col("block_index").alias("region_pos"), "role", F.col("text").alias("source_text"), F.lit(True).alias("translate"), "bbox")
    plan = preview.replacement_plan(preview.translated(regions, translate.mock(F.col("source_text"))), layout.overlay_ready(split))
    return plan.groupBy("page_status", "page_apply_policy", "fit_risk", "apply_strategy", "render_decision").agg(F.count("*").alias("regions"))


def _fusion_plan(spark: SparkSession, d: str) -> DataFrame:
    o, price = A.table(spark, d, "orders"), F.col("o_totalprice")
    box = G.box(F.lit(10), F.lit(10), price % 500 + 10, F.col("o_orderkey") % 7 * 20 + 30)
    text = F.repeat(F.lit("motif "), F.floor(price % 50).cast("int"))
    rows = o.select((F.col("o_custkey") % 100).alias("doc_id"), F.col("o_custkey").alias("page_number"), F.col("o_orderkey").alias("i"), text.alias("text"), box.alias("bbox"), (F.col("o_orderstatus") == "F").alias("native"))
    lines = F.array(F.struct("text", "bbox"))
    native = rows.filter("native").select("doc_id", "page_number", F.col("i").alias("block_index"), F.lit("content").alias("role"), "text", "bbox", lines.alias("lines"))
    ocr = rows.filter("not native").select("doc_id", "page_number", F.col("i").alias("candidate_index"), F.lit("ok").alias("ocr_status"), T.ocr_quality(F.col("text")).alias("quality"), "text", "bbox")
    return fusion.plan(native, ocr)


def _fusion_preview(spark: SparkSession, d: str) -> DataFrame:
    out = preview.fusion_preview(_fusion_plan(spark, d), translate.mock(F.col("chunk")))
    return out.withColumn("edge_clipping_line_count", F.when(F.endswith("segment_id", F.lit("7S1")), 1).otherwise(0))


def fusion_plan(spark: SparkSession, d: str) -> DataFrame:
    """Binding: a customer is a page; an order is a native region if filled, else a recognised one, with words and box by its price; recognised ones whose number ends in seven are cut off."""
    return _fusion_plan(spark, d).select("doc_id", "page_number", "segment_id", "source_kind", "source_ref", "role", "translate")


def fusion_preview(spark: SparkSession, d: str) -> DataFrame:
    return _fusion_preview(spark, d).select("doc_id", "page_number", "segment_id", "status", "translated_text", "translation_chunk_count", "translation_method", "translation_attempt_count")


def fusion_replacements(spark: SparkSession, d: str) -> DataFrame:
    plan = preview.fusion_decisions(preview.fusion_replacements(_fusion_preview(spark, d)))
    return plan.select("doc_id", "page_number", "segment_id", "replacement_index", "fit_risk", "apply_strategy", F.array_join("flags", ",").alias("flags"), "render_decision")


def ocr_strategies(spark: SparkSession, d: str) -> DataFrame:
    found = preview.ocr_strategies(preview.fusion_replacements(_fusion_preview(spark, d)))
    return found.select("doc_id", "page_number", "segment_id", "ocr_recommendation", F.array_join("ocr_recommendation_reasons", ",").alias("reasons"), "ocr_readiness_status", F.array_join("ocr_readiness_reasons", ",").alias("readiness_reasons"), "translated_preview")


def page_previews(spark: SparkSession, d: str) -> DataFrame:
    previewed = _fusion_preview(spark, d)
    return preview.page_previews(previewed, preview.ocr_strategies(preview.fusion_replacements(previewed)))


def extracted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Binding: a turn of a conversation as a raw block whose words are spans."""
    c = A.table(spark, d, "conversations")
    box = G.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    lines = F.transform(F.split("text", "\n"), lambda l: F.struct(box.alias("bbox"), F.transform(F.split(l, " "), lambda w: F.struct(w.alias("text"))).alias("spans")))
    raw = c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), F.col("turn").alias("pos"), F.lit(0).alias("type"), box.alias("bbox"), lines.alias("lines"))
    return extract.text_blocks(raw).select("doc_id", "page_number", "block_index", "text", F.size("lines").alias("line_count"))


def fused_pages(spark: SparkSession, d: str) -> DataFrame:
    """Binding: a page is a customer; filled orders are native regions, all others recognised ones."""
    o = A.table(spark, d, "orders").select(F.lit(0).alias("doc_id"), F.col("o_custkey").alias("page_number"), (F.col("o_orderstatus") == "F").alias("native"), F.when(F.col("o_orderstatus") == "P", "ocr_only").alias("route"))
    return fusion.fuse(o.filter("native"), o.filter("not native"))


def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").select(F.lit(0).alias("doc_id"), F.col("c_custkey").alias("page_number"))
    o = A.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.lit(0).alias("doc_id"), F.col("o_custkey").alias("page_number"))
    return fusion.missing_pages(c, o)


def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    """Binding: an order's lines are words of one recognised line for each return flag."""
    li = A.table(spark, d, "lineitem")
    words = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.lit(5).alias("level"), F.lit(1).alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.ascii("l_returnflag").alias("line_num"),
        (F.col("l_partkey") % 500).cast("int").alias("left"), (F.col("l_suppkey") % 300).cast("int").alias("top"), F.col("l_quantity").cast("int").alias("width"), F.lit(10).alias("height"), (F.col("l_linenumber") * 10.0 - 10.0).alias("conf"), F.col("l_linestatus").alias("text"),
    )
    return fusion.tsv_lines(words).select("doc_id", "line_index", "line_num", "text", "x0", "y0", "x1", "y1", "touches_left_edge", "touches_right_edge", "touches_top_edge", "touches_bottom_edge", "word_count")


def column_order(spark: SparkSession, d: str) -> DataFrame:
    """Binding: an order's lines as regions in two columns."""
    li = A.table(spark, d, "lineitem")
    x, y = F.when(F.col("l_linenumber") % 2 == 0, 300.0).otherwise(40.0), (F.col("l_partkey") % 700).cast("double")
    regions = li.select((F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_orderkey") / 4).cast("long").alias("page_number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("region_pos"), G.box(x, y, x + 200, y + 14).alias("bbox"))
    return fusion.reading_order(regions).select("doc_id", "page_number", "region_pos", "reading_order")


QUERIES: dict[str, Query] = {f.__name__: f for f in (repeat_counts, top_repeats, block_roles, role_summary, table_runs, zone_counts, reading_flow, layout_groups, page_readiness, structural_lines, image_rules, document_kinds, page_routes, translation_gate, ocr_quality, masked_documents, translation_batches, replacement_plan, ocr_plan, translation_preview, native_plan, fusion_plan, fusion_preview, fusion_replacements, ocr_strategies, page_previews, extracted_blocks, fused_pages, missing_pages, recognised_lines, column_order)}


# the same in SQL

_BLOCKS = r"""
lines as (select source as doc_id, doc_id as page_number, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as block_index from documents),
stripped as (select *, regexp_replace(text, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+$', '', 'g') as t from lines),
blocks as (select doc_id, page_number, block_index, text, t, regexp_replace(regexp_replace(regexp_replace(t, '[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+', ' ', 'g'),
    '(^|[^\p{L}\p{M}\p{N}_])\p{Nd}+($|[^\p{L}\p{M}\p{N}_])', '\1{N}\2', 'g'), '(^|[^\p{L}\p{M}\p{N}_])\p{Nd}+($|[^\p{L}\p{M}\p{N}_])', '\1{N}\2', 'g') as norm_text,
    40.0 + 7 * (block_index % 114) as y0, 46.0 + 7 * (block_index % 114) as y1, 40.0 as x0, 40.0 + least(515, 5 * length(text)) as x1 from stripped)"""
# a word's edge, white space and what else the patterns of roles are made of
_W, _S = r"[\p{L}\p{M}\p{N}_]", r"[\s\p{Z}\x{85}\v]"
_B, _E = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"
_UP, _AZ = "[A-ZÀ-ÖØ-Þ]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
_AMOUNT = rf"(?i)^{_S}*\p{{Nd}}+(?:[,.]\p{{Nd}}+)?{_S}*(?:(?:[glva]|kg|mg|ml|cl|ma|ua|µa|k|{_AZ}{{2,}}){_E}|%{_W})"
_ROLES = rf"""{_BLOCKS},
sized as (select *, lower(t) as low, length(t) as n, count(*) over (partition by doc_id, norm_text) as repeat_count, case when block_index = 0 then 16.0 else 10.0 end as size,
    median(case when block_index = 0 then 16.0 else 10.0 end) over (partition by doc_id, page_number) as mid, max(case when block_index = 0 then 16.0 else 10.0 end) over (partition by doc_id, page_number) as top,
    len(regexp_extract_all(t, '{_UP}{{2,}}')) as capitals, replace(replace(t, chr(10), ''), ' ', '') as compact, case when t = '' then 0 else 1 end as ls from blocks),
roles as (select *, case
    when regexp_matches(t, '^\p{{Nd}}+$') or regexp_matches(low, '^page{_S}*:{_S}*\p{{Nd}}+{_S}*/{_S}*\p{{Nd}}+$') then 'page_number'
    when regexp_matches(t, '(?i)^[+\-]?\p{{Nd}}(?:\p{{Nd}}|{_S}|[,.])*(?:€|eur|%)?$') then 'numeric_value'
    when y1 > 842 * 0.92 and regexp_matches(low, 'rcs|sa au capital|siret') then 'legal_footer'
    when regexp_matches(low, 'nous contacter|vos espaces clients|service clients|assistance technique|contact\.orange|orange et moi|orange\.fr|tarifs de vos communications|tarifsetcontrats|paiement facture') then 'support_metadata'
    when regexp_matches(low, '{_B}(?:n[°o]{_S}*(?:de{_S}*)?facture|facture{_S}*n[°o]?|date de facture)') or regexp_matches(t, '^\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}}$') then 'billing_metadata'
    when contains(low, 'vos coordonnées') or regexp_matches(low, '{_B}n[°o]{_S}*(?:de{_S}*)?(?:client|compte(?:{_S}+internet)?|ligne(?:{_S}+livebox)?){_E}|{_B}(?:client|compte(?:{_S}+internet)?|ligne(?:{_S}+livebox)?){_S}*:')
      or regexp_matches(t, '{_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_E}') or regexp_matches(t, '{_B}(?:\p{{Nd}}(?:{_S}|\.)){{3,}}\p{{Nd}}{_E}')
      or regexp_matches(t, '{_B}\p{{Nd}}{{5}}{_S}+{_UP}(?:{_UP}|{_S}|-)+(?:{_UP}{_E}|(?:{_S}|-){_W})') then 'sensitive_metadata'
    when n <= 120 and regexp_matches(t, '{_B}(?:https?://|www\.|[A-Za-z0-9.-]+\.(?:fr|com|net|org){_E})') then 'support_metadata'
    when regexp_matches(t, '(?i)^(?:fig(?:ure)?\.?|tableau|table){_S}*\p{{Nd}}+{_S}*[:.-]') then 'caption'
    when length(compact) <= 3 and regexp_matches(compact, '^[+\-=/|*A-ZΑ-Ωα-ω]+$') then 'diagram_token'
    when y0 < 842 * 0.08 and n >= 24 and capitals >= 3 then 'slide_title'
    when y0 < 842 * 0.18 and repeat_count between 5 and 79 and n >= 20 and capitals >= 3 then 'slide_title'
    when repeat_count >= 20 and y0 < 842 * 0.18 then 'header'
    when repeat_count >= 20 and y1 > 842 * 0.82 then 'footer'
    when t in ('-', '–', '—') then 'ornament'
    when regexp_matches(t, '(?i)^(?:étape|etape|step|phase|partie|section){_S}+\p{{Nd}}+{_E}') then 'section_step'
    when regexp_matches(t, '^(?:[-•*]{_S}+|\p{{Nd}}{{1,2}}[.)]{_S}+)') or (n <= 80 and regexp_matches(t, '{_AMOUNT}') and regexp_matches(t, '{_AZ}')) then 'list_item'
    when mid > 0 and (size >= mid * 1.7 or (y0 < 842 * 0.25 and size >= mid * 1.15 and size >= top * 0.9)) and n >= 8 and y0 < 842 * 0.45 and not contains(t, '@') then 'title'
    when capitals >= 1 and n <= 24 and regexp_matches(t, '^(?:[A-ZÀ-ÖØ-Þ0-9|+_/-]|{_S})+$') then 'diagram_label'
    when contains(t, '|') and n <= 32 and len(list_filter(string_split(t, '|'), lambda x: trim(x) <> '')) > 0 and len(list_filter(string_split(t, '|'), lambda x: length(trim(x)) > 6)) = 0 then 'diagram_label'
    when contains(t, chr(61550)) then 'diagram_label'
    when ls = 1 and n between 3 and 60 and size >= mid * 1.25 and not regexp_matches(t, '[.!?;:]$') and not contains(t, '@') then 'short_label'
    when repeat_count >= 20 and length(norm_text) < 80 then 'repeated_chrome'
    else 'content' end as role from sized)"""
# the layout groups of a page's candidates: what a block joins is its first anchor of the first kind that takes it
_COLUMN = "(least(a.x1 - a.x0, c.x1 - c.x0) > 0 and greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / least(a.x1 - a.x0, c.x1 - c.x0) >= 0.25 or abs((a.x0 + a.x1) / 2 - (c.x0 + c.x1) / 2) <= 595 * 0.18)"
_GROUPS = rf"""{_ROLES},
split as (select *, role in ('content', 'slide_title', 'title', 'section_step', 'short_label', 'list_item', 'caption', 'table_cell', 'table_header') as is_candidate,
    case when (y0 + y1) / 2 <= 842 * 0.15 then 'header_zone' when (y0 + y1) / 2 >= 842 * 0.85 then 'footer_zone' else 'body_zone' end as v, case when (x0 + x1) / 2 <= 595 * 0.2 then 'left_margin' when (x0 + x1) / 2 >= 595 * 0.8 then 'right_margin' else 'center_band' end as h from roles),
cand as (select *, role = 'list_item' and regexp_matches(t, '{_AMOUNT}') as amount, role = 'list_item' and regexp_matches(text, '^{_S}*\p{{Nd}}{{1,2}}[.)]{_S}+') as numbered from split where is_candidate),
step as (select c.doc_id, c.page_number, c.block_index, min(a.block_index) as lead from cand c join cand a using (doc_id, page_number)
    where a.role = 'section_step' and (c.block_index = a.block_index or c.role in ('short_label', 'content') and c.y0 - a.y0 between 0 and 842 * 0.28 and {_COLUMN}) group by all),
f1 as (select c.*, s.lead as step_lead from cand c left join step s using (doc_id, page_number, block_index)),
found as (select distinct c.doc_id, c.page_number, c.block_index, c.y0 from f1 c left join f1 a on a.doc_id = c.doc_id and a.page_number = c.page_number and a.amount where c.amount or (c.step_lead is null and c.role = 'short_label' and contains(c.low, 'ingr') and a.amount and {_COLUMN})),
reach as (select doc_id, page_number, min(y0) as lo, max(y0) as hi from found group by 1, 2),
ingr as (select doc_id, page_number, block_index from found union select c.doc_id, c.page_number, c.block_index from f1 c join reach using (doc_id, page_number) join f1 a on a.doc_id = c.doc_id and a.page_number = c.page_number and a.amount
    where c.step_lead is null and c.role = 'content' and c.y0 between lo - 80 and hi + 140 and {_COLUMN}),
f2 as (select c.*, i.block_index is not null as is_ingr from f1 c left join ingr i using (doc_id, page_number, block_index)),
inst as (select distinct c.doc_id, c.page_number, c.block_index from f2 c join f2 a on a.doc_id = c.doc_id and a.page_number = c.page_number and a.numbered and not a.is_ingr
    where not c.is_ingr and (c.numbered or c.step_lead is null and c.role = 'content' and c.y0 - a.y0 between 0 and 842 * 0.35 and {_COLUMN})),
f3 as (select c.*, i.block_index is not null as is_inst from f2 c left join inst i using (doc_id, page_number, block_index)),
head as (select c.doc_id, c.page_number, c.block_index, min(a.block_index) as lead from f3 c join f3 a using (doc_id, page_number) where a.role in ('title', 'slide_title')
    and (c.block_index = a.block_index or c.role in ('content', 'short_label') and c.step_lead is null and not c.is_ingr and not c.is_inst and c.v = 'header_zone' and abs(c.y0 - a.y0) <= 80) group by all),
named as (select c.*, case when step_lead is not null then 1 when is_ingr then 2 when is_inst then 3 when head.lead is not null then 4 when role = 'caption' then 5 else 6 end as k, coalesce(step_lead, case when is_ingr or is_inst then -1 end, head.lead, block_index) as lead from f3 c left join head using (doc_id, page_number, block_index)),
grouped as (select *, dense_rank() over (partition by doc_id, page_number order by k, lead) - 1 as group_index, ['step_group', 'ingredient_list_group', 'instruction_group', 'heading_group', 'caption_group', 'isolated_group'][k] as group_type,
    row_number() over (partition by doc_id, page_number, k, lead order by y0, x0, block_index) - 1 as position_in_group, count(*) over (partition by doc_id, page_number, k, lead) as candidate_count from named)"""
_READY = rf"""{_GROUPS},
flow as (select *, lag(y0) over p as py0, lag(y1) over p as py1 from grouped window p as (partition by doc_id, page_number order by block_index)),
flagged as (select *, list_filter([case when role in ('content', 'list_item', 'caption', 'table_cell', 'table_header') and v = 'header_zone' then 'review_candidate_content_role_in_header_zone' end, case when role in ('content', 'list_item', 'caption', 'table_cell', 'table_header') and v = 'footer_zone' then 'review_candidate_content_role_in_footer_zone' end,
      case when role in ('content', 'caption') and h <> 'center_band' and group_type <> 'ingredient_list_group' then 'review_candidate_content_role_in_margin' end], lambda x: x is not null) as zf,
    list_filter([case when py0 - y0 > 84.2 then 'review_candidate_order_moves_up_page' end, case when greatest(0, y0 - py1) > 210.5 then 'review_large_vertical_gap_between_candidates' end], lambda x: x is not null) as ff from flow),
odd as (select * from split where not is_candidate and role in ('footer', 'header', 'legal_footer', 'page_number') and v = 'body_zone'),
reasons as (select doc_id, page_number, unnest(zf) as reason, group_type from flagged union all select doc_id, page_number, unnest(ff), group_type from flagged union all select doc_id, page_number, 'review_structural_exclusion_in_body_zone', null from odd
    union all select distinct on (doc_id, page_number, group_index) doc_id, page_number, 'review_layout_group_' || group_type, null from flagged where group_type in ('ingredient_list_group', 'instruction_group', 'step_group')),
rated as (select doc_id, page_number, reason = 'review_structural_exclusion_in_body_zone' or reason in ('review_candidate_content_role_in_footer_zone', 'review_candidate_content_role_in_header_zone', 'review_candidate_order_moves_up_page') and group_type not in ('heading_group', 'ingredient_list_group', 'instruction_group', 'step_group') as hard from reasons),
worst as (select doc_id, page_number, count(*) filter (hard) as hard_n, count(*) filter (not hard) as soft_n from rated group by 1, 2),
held as (select doc_id, page_number, count(*) filter (is_candidate) as candidates, count(*) filter (is_candidate and t <> '') as candidate_lines, count(*) filter (not is_candidate) as excluded_blocks from split group by 1, 2),
kinds as (select doc_id, page_number, count(distinct group_index) filter (group_type <> 'isolated_group') as layout_group_items, count(distinct group_index) filter (group_type in ('ingredient_list_group', 'instruction_group', 'step_group')) as complex_groups,
    count(*) filter (len(zf) > 0) as zone_n, count(*) filter (len(ff) > 0) as flow_items from flagged group by 1, 2),
odds as (select doc_id, page_number, count(*) as odd_n from odd group by 1, 2),
ready as (select doc_id, page_number, candidates, candidate_lines, excluded_blocks, coalesce(layout_group_items, 0) as layout_group_items, coalesce(soft_n, 0) as soft_review_items, coalesce(hard_n, 0) as hard_review_items,
    case when candidates = 0 then 'blocked' when hard_n > 0 then 'hard_review' when soft_n > 0 then 'soft_review' else 'ready' end as status, coalesce(zone_n, 0) + coalesce(odd_n, 0) as zone_items, coalesce(flow_items, 0) as flow_items,
    coalesce(zone_n, 0) + coalesce(odd_n, 0) + coalesce(flow_items, 0) + coalesce(complex_groups, 0) as review_items from held left join worst using (doc_id, page_number) left join kinds using (doc_id, page_number) left join odds using (doc_id, page_number))"""
_LETTERS = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"

# orders as segments of both kinds, previewed and planned
_SEGMENTS = """seg as (select o_custkey % 100 as doc_id, o_custkey as page_number, o_orderstatus = 'F' as native, floor(o_totalprice % 50)::int as q, repeat('motif ', q) as text, (o_totalprice % 500) * (o_orderkey % 7 * 20 + 20) as a,
    case when native then 'P' || o_custkey || 'N' || o_orderkey else 'P' || o_custkey || 'O' || o_orderkey || 'S1' end as segment_id, case when native then 'block:' || o_orderkey else 'ocr:' || o_orderkey end as source_ref, native or q >= 4 as translate, not native and o_orderkey % 10 = 7 as cut from orders),
said as (select *, case when not native and translate then '[EN] ' || trim(text) when translate then '[EN] ' || text else text end as out, greatest(0, 6 * q - 1) as n, length(trim(out)) as m, case when n > 0 then m / n else 1.0 end as over, case when a > 0 then m / a * 1000 else 0 end as dense from seg),
risked as (select *, case when native then case when over > 1.35 then 'high' when over > 1.1 then 'medium' else 'low' end when m = 0 then 'review' when over > 1.6 or m > 260 then 'high' when over > 1.25 or m > 180 then 'medium' else 'low' end as fit_risk,
    list_filter([case when dense > 18 then 'dense_text_for_region' end, case when cut then 'edge_clipping_detected' end, case when m = 0 then 'empty_translation' end, case when n > 0 and over > 1.6 then 'large_translation_expansion' end, case when m > 260 then 'long_translation' end, case when a <= 0 then 'missing_bbox' end], lambda x: x is not null) as fl from said),
planned as (select *, case when native then 'native_overlay_candidate' when m = 0 or a <= 0 or cut then 'ocr_review_required' when a >= 35000 and m <= 1200 and dense <= 18 then 'ocr_overlay_candidate' when m <= 140 and dense <= 16 then 'ocr_overlay_candidate'
      when dense > 22 then 'ocr_side_annotation' when fit_risk in ('low', 'medium') and dense <= 18 then 'ocr_overlay_candidate' else 'ocr_side_annotation' end as apply_strategy,
    case when native then null when not translate or m = 0 or a <= 0 or cut then 'manual_review' when fit_risk = 'low' and round(over, 2) <= 1.25 and m <= 180 then 'image_overlay_candidate' else 'side_annotation_recommended' end as rec,
    case when not translate then ['status=skipped'] when m = 0 then ['empty_translation'] when a <= 0 then ['missing_bbox'] when cut then ['edge_clipping_detected', 'edge_clipping_lines=1'] when rec = 'image_overlay_candidate' then ['translation_size_close_to_source', 'low_fit_risk']
      else list_concat(coalesce(nullif(list_filter([case when dense > 18 then 'dense_text_for_region' end, case when m > 260 then 'long_translation' end, case when round(over, 2) > 1.25 then 'translation_expands_beyond_source_region' end], lambda x: x is not null), []), ['fit_risk=' || fit_risk]), ['side_note_preserves_scanned_image']) end as why,
    list_filter([case when not translate then 'status=skipped' end, case when m = 0 then 'empty_translation' end, case when a <= 0 then 'missing_bbox' end, case when cut then 'edge_clipping_detected' end], lambda x: x is not null) as stop,
    case when native then null when len(stop) > 0 then 'blocked' when rec = 'image_overlay_candidate' then 'ready_for_image_overlay' when rec = 'side_annotation_recommended' then 'side_annotation_review' else 'manual_review' end as ready from risked)"""
ORACLES: dict[str, str] = {
    "block_roles": f"with {_ROLES} select doc_id, page_number, block_index, role, repeat_count from roles",
    "role_summary": f"with {_ROLES} select doc_id, role, count(*) as blocks from roles group by all",
    "layout_groups": f"with {_GROUPS} select doc_id, page_number, block_index, 'P' || page_number || 'G' || group_index as group_id, group_index, group_type, position_in_group, candidate_count from grouped",
    "page_readiness": f"with {_READY} select * from ready",
    "native_plan": f"""with {_READY}, m as (select c.*, status as page_status, '[EN] ' || c.text as said, length(trim('[EN] ' || c.text)) as k, (c.x1 - c.x0) * 6 as a from cand c join ready using (doc_id, page_number)),
        f as (select *, case when n > 0 then k / n else 1.0 end as over, case when a > 0 then k / a * 1000.0 else 0 end as dense, round(dense, 2) as d from m),
        r as (select *, case when a <= 0 then 'high' when x1 - x0 < 24 and over > 1.15 then 'high' when n > 0 and over > 1.6 and d > 18 then 'high' when d > 24 then 'high' when role = 'slide_title' and over <= 1.5 then case when over > 1.1 then 'medium' else 'low' end
          when dense > 18 then 'medium' when over > 1.35 then 'high' when over > 1.1 then 'medium' else 'low' end as fit_risk from f),
        p as (select *, case when fit_risk = 'high' then 'native_review_required' when dense > 18 then 'native_overlay_with_fit_adjustment' else 'native_overlay_candidate' end as apply_strategy,
          case page_status when 'soft_review' then 'apply_overlay_with_soft_review' when 'hard_review' then 'skip_overlay_hard_review' when 'blocked' then 'skip_overlay_blocked' else 'apply_overlay' end as page_apply_policy from r)
        select page_status, page_apply_policy, fit_risk, apply_strategy, case when starts_with(page_apply_policy, 'skip') then 'skipped_page_policy' when apply_strategy = 'native_review_required' then 'skipped_apply_strategy' when fit_risk not in ('low', 'medium') then 'skipped_fit_risk' else 'applied' end as render_decision, count(*) as regions from p group by all""",
    "column_order": """with r as (select l_orderkey % 100 as doc_id, l_orderkey // 4 as page_number, l_orderkey * 10 + l_linenumber as region_pos, case when l_linenumber % 2 = 0 then 300.0 else 40.0 end as x, (l_partkey % 700)::double as y from lineitem),
        c as (select *, case when max(x) over p - min(x) over p >= 80 then (max(x) over p + min(x) over p) / 2 end as cut, count(*) over p as n, min(y) over p as top, greatest(1.0, max(y) over p + 14 - min(y) over p) as h from r window p as (partition by doc_id, page_number)),
        s as (select *, count(*) filter (x < cut) over p >= 4 and count(*) filter (x >= cut) over p >= 4 as two from c window p as (partition by doc_id, page_number)),
        b as (select *, case when n < 8 or not two then 0 when y >= top + h * 0.82 then 3 when x < cut then 1 else 2 end as bucket from s)
        select doc_id, page_number, region_pos, row_number() over (partition by doc_id, page_number order by bucket, case when n < 8 then region_pos else y end, case when n < 8 then 0 else x end, region_pos) - 1 as reading_order from b""",
    "translation_preview": """with t as (select l_orderkey % 1000 as doc_id, l_orderkey as page_number, l_linenumber as region_pos, l_quantity::int::varchar as q from lineitem)
        select doc_id, page_number, region_pos, case region_pos when 1 then 'THE DIODES OF THE CELL ' || q when 2 then 'We will therefore examine the calculation of:' when 3 then 'Depletion region' when 4 then 'step ' || q || chr(10) || 'For ' || q || ' people' when 5 then '[EN] texte  ' || q when 6 then 'texte  ' || q || ' ' else 'Diode ' || q end as translated_text,
          case when region_pos < 6 then 'translated' else 'skipped' end as status, case when region_pos in (1, 3) then 'glossary' when region_pos = 2 then 'outline_fallback' when region_pos = 4 then 'structural_fallback' when region_pos = 5 then 'model' else 'skipped' end as translation_method, case when region_pos = 5 then 1 else 0 end as translation_attempt_count from t""",
    "fusion_plan": f"with {_SEGMENTS} select doc_id, page_number, segment_id, case when native then 'native' else 'ocr' end as source_kind, source_ref, case when native then 'content' else 'ocr_region' end as role, translate from seg",
    "fusion_preview": f"with {_SEGMENTS} select doc_id, page_number, segment_id, case when translate then 'translated' else 'skipped' end as status, out as translated_text, case when translate then 1 else 0 end as translation_chunk_count, case when translate then 'model' else 'skipped' end as translation_method, case when translate then 1 else 0 end as translation_attempt_count from said",
    "fusion_replacements": f"""with {_SEGMENTS} select doc_id, page_number, segment_id, row_number() over (partition by doc_id, page_number order by not native, segment_id) as replacement_index, fit_risk, apply_strategy, array_to_string(fl, ',') as flags,
        case when a <= 0 then 'skipped_missing_bbox' when native and fit_risk in ('low', 'medium') then 'applied_native_overlay' when native then 'skipped_native_fit_risk' when rec = 'image_overlay_candidate' then 'applied_ocr_overlay' when rec = 'manual_review' then 'annotated_ocr_review' else 'annotated_ocr_side' end as render_decision from planned""",
    "ocr_strategies": f"""with {_SEGMENTS} select doc_id, page_number, segment_id, rec as ocr_recommendation, array_to_string(why, ',') as reasons, ready as ocr_readiness_status, array_to_string(case when len(stop) > 0 then stop else list_concat(['recommendation=' || rec], why) end, ',') as readiness_reasons,
        case when length(trim(out)) <= 220 then trim(out) else trim(substr(trim(out), 1, 217)) || '...' end as translated_preview from planned where not native""",
    "page_previews": f"""with {_SEGMENTS} select doc_id, page_number, count(*) as segment_count, count(*) filter (native) as native_segment_count, count(*) filter (not native) as ocr_segment_count, count(*) filter (ready = 'ready_for_image_overlay') as ready, count(*) filter (ready = 'side_annotation_review') as side_review,
        count(*) filter (ready = 'manual_review') as manual_review, count(*) filter (ready = 'blocked') as blocked from planned group by all""",
    "extracted_blocks": r"""with l as (select conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}\x{85}\v]+', '', 'g')), lambda x: x <> '') as ls from conversations)
        select conv_id as doc_id, 1 as page_number, row_number() over (partition by conv_id order by turn) - 1 as block_index, array_to_string(ls, chr(10)) as text, len(ls) as line_count from l where len(ls) > 0""",
    "repeat_counts": f"with {_BLOCKS} select doc_id, page_number, block_index, norm_text, count(*) over (partition by doc_id, norm_text) as repeat_count from blocks",
    "top_repeats": f"""with {_BLOCKS}, counted as (select doc_id, norm_text, count(*) as repeat_count, min((page_number, block_index)) as first from blocks group by all),
        ranked as (select *, row_number() over (partition by doc_id order by repeat_count desc, first) as rank from counted where repeat_count >= 5)
        select doc_id, rank, norm_text, repeat_count from ranked where rank <= 10""",
    "table_runs": f"""with {_BLOCKS}, marked as (select *, contains(text, '|') as r from blocks),
        turned as (select *, row_number() over (partition by doc_id, page_number order by block_index) - row_number() over (partition by doc_id, page_number, r order by block_index) as island from marked),
        sized as (select *, count(*) over (partition by doc_id, page_number, r, island) as n, row_number() over (partition by doc_id, page_number, r, island order by block_index) as i from turned)
        select doc_id, page_number, block_index, case when r and n >= 2 then case when i = 1 then 'table_header' else 'table_cell' end else 'content' end as role from sized""",
    "zone_counts": f"""with {_BLOCKS}, placed as (select doc_id, (y0 + y1) / 2 as yc, x0 + (x1 - x0) / 2 as xc from blocks),
        zoned as (select doc_id, case when yc <= 842 * 0.15 then 'header_zone' when yc >= 842 * 0.85 then 'footer_zone' else 'body_zone' end as v, case when xc <= 595 * 0.2 then 'left_margin' when xc >= 595 * 0.8 then 'right_margin' else 'center_band' end as h from placed)
        select doc_id, case when grouping(v) = 0 then 'vertical' else 'horizontal' end as dimension, coalesce(v, h) as zone, count(*) as blocks from zoned group by grouping sets ((doc_id, v), (doc_id, h))""",
    "reading_flow": f"""with {_BLOCKS}, c as (select * from blocks where {_LETTERS} >= 3),
        w as (select *, row_number() over p - 1 as reading_order, lag(y0) over p as py0, lag(y1) over p as py1, lag(x0) over p as px0, lag(x1) over p as px1, count(*) over (partition by doc_id, page_number) as n from c window p as (partition by doc_id, page_number order by block_index)),
        o as (select *, case when py0 is null then null when least(px1 - px0, x1 - x0) > 0 then greatest(0, least(px1, x1) - greatest(px0, x0)) / least(px1 - px0, x1 - x0) else 0 end as overlap, greatest(0, y0 - py1) as gap from w)
        select doc_id, page_number, block_index, reading_order, case when n = 1 then 'isolated_block' when overlap < 0.5 then 'multi_column_candidate' else 'single_column_flow' end as flow,
          concat_ws(',', case when py0 - y0 > greatest(48, 84.2) then 'review_candidate_order_moves_up_page' end, case when gap > greatest(96, 210.5) then 'review_large_vertical_gap_between_candidates' end) as flags from o""",
    "structural_lines": """with t as (select l_orderkey, l_linenumber, l_quantity::int::varchar as n, case l_returnflag when 'A' then 'vanilla sugar' when 'R' then 'eggs' end as item from lineitem)
        select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'step ' || n when l_linenumber % 2 = 0 then n || ' g ' || item else n || ' ' || item end as translated from t""",
    "image_rules": """with i as (select l_orderkey % 1000 as d, l_orderkey as page_number, l_linenumber as image_index, l_quantity * 8 as w, l_extendedprice / 100 as h from lineitem),
        r as (select *, w * h / (595.0 * 842.0) as a, case when w < 32 or h < 24 then 'image_too_small_for_ocr' when w * h / (595.0 * 842.0) < 0.01 then 'image_area_below_ocr_threshold' when greatest(w / greatest(h, 1), h / greatest(w, 1)) > 8 then 'image_aspect_ratio_too_extreme' end as reason from i)
        select page_number, image_index, reason, case reason when 'image_area_below_ocr_threshold' then 'illustration_or_figure' when 'image_aspect_ratio_too_extreme' then 'decorative' when 'image_too_small_for_ocr' then case when a < 0.002 or greatest(w, h) < 16 then 'decorative' else 'too_small_for_ocr' end end as classification,
          case when reason is null then row_number() over (partition by d, page_number, reason is null order by image_index) - 1 end as candidate_index from r""",
    "document_kinds": """select o_custkey as doc_id, case when bool_or(o_orderpriority = '1-URGENT') and not bool_or(o_totalprice > 200000) then 'born_digital' when bool_or(o_totalprice > 200000) and not bool_or(o_orderpriority = '1-URGENT') then 'scanned' else 'hybrid' end as pdf_kind, count(*) as page_count from orders group by 1""",
    "page_routes": """with i as (select c_custkey as page_number, abs(c_acctbal) / 10 as w, (c_nationkey * 10 + 10)::double as h from customer),
        r as (select page_number, count(*) filter (ok) as cand, count(*) filter (not ok) as ign from (select page_number, not (w < 32 or h < 24) and w * h / (595.0 * 842.0) >= 0.01 and greatest(w / greatest(h, 1), h / greatest(w, 1)) <= 8 as ok from i) group by 1),
        k as (select l_orderkey, count(*) as b, count(*) filter (l_returnflag = 'A') as n from lineitem group by 1),
        p as (select o_orderkey % 1000 as doc_id, o_orderkey as page_number, case when o_orderpriority = '1-URGENT' then 0 else 2 end as image_count, coalesce(cand, 0) as c, coalesce(ign, 0) as g, coalesce(b, 0) as b, coalesce(n, 0) as n from orders left join r on page_number = o_orderkey left join k on l_orderkey = o_orderkey)
        select doc_id, page_number, case when n > 0 and c > 0 then 'native_plus_ocr_candidates' when n > 0 and image_count > 0 then 'native_with_decorative_images' when n > 0 then 'native_only' when c > 0 then 'ocr_only' when image_count > 0 then 'image_only_no_ocr_candidates' when b > 0 then 'native_non_content_only' else 'empty' end as route,
          concat_ws(',', case when n > 0 then 'has_native_content_blocks' end, case when image_count > 0 then 'contains_raster_images' end, case when image_count > 0 and c = 0 then 'no_ocr_sized_image_regions' end, case when c > 0 then 'has_ocr_candidate_regions' end, case when b > 0 and n = 0 then 'native_text_classified_as_non_content_only' end) as reasons,
          0 as native_text_chars, image_count, b as block_count, n as content_blocks, b - n as excluded_blocks, c as ocr_candidate_count, g + greatest(0, image_count - c - g) as ignored_ocr_image_count, greatest(0, image_count - c - g) as untracked_images from p""",
    "translation_gate": f"with {_BLOCKS} select doc_id, count(*) filter ({_LETTERS} >= 3) as candidates, count(*) filter (t = '' or (contains(t, '|') and length(t) <= 40) or ({_LETTERS} <= 4 and length(t) <= 24)) as symbolic, count(*) as blocks from blocks group by 1",
    "ocr_quality": r"""with s as (select doc_id, regexp_replace(text, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+$', '', 'g') as a from documents),
        n as (select doc_id, regexp_replace(a, '[ \t\p{Z}]+(\n|$)', '\1', 'g') as t from s),
        w as (select *, len(list_filter(regexp_split_to_array(t, '[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+'), lambda x: x <> '')) as words, length(t) - length(translate(t, '®©™�', '')) as odd from n)
        select doc_id, case when t = '' then 'empty' when words < 4 then 'weak' when odd >= 3 then 'review' when length(t) >= 80 and words >= 12 then 'usable' else 'review' end as quality from w""",
    "replacement_plan": f"""with {_BLOCKS}, m as (select *, length(t) as n, length(trim('[EN] ' || text)) as k, case when t = '' then 0 else 1 end as ls from blocks),
        f as (select *, (x1 - x0) * 6 as a, case when n = 0 then 'skipped' else 'translated' end as status, case when n > 0 then k / n else 1.0 end as over, case when (x1 - x0) * 6 > 0 then k / ((x1 - x0) * 6) * 1000.0 else 0 end as dense from m),
        r as (select *, case when status <> 'translated' then 'low' when a <= 0 then 'high' when (x1 - x0 < 24) and over > 1.15 then 'high' when over > 1.6 and dense > 18 then 'high' when dense > 24 then 'high' when dense > 18 then 'medium' when over > 1.35 then 'high' when over > 1.1 then 'medium' else 'low' end as fit_risk from f),
        s as (select *, case when status <> 'translated' then 'native_skipped' when fit_risk = 'high' then 'native_review_required' when dense > 18 then 'native_overlay_with_fit_adjustment' else 'native_overlay_candidate' end as strategy from r)
        select fit_risk, strategy, case when status <> 'translated' then 'skipped_status' when strategy in ('native_review_required', 'native_skipped') then 'skipped_apply_strategy' when fit_risk not in ('low', 'medium') then 'skipped_fit_risk' else 'applied' end as decision, count(*) as blocks from s group by all""",
    "ocr_plan": r"""with s as (select doc_id, length(regexp_replace(text, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+$', '', 'g')) as n, length(regexp_replace('[EN] ' || text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+$', '', 'g')) as m from documents),
        r as (select *, case when n > 0 then m / n else 1.0 end as over, m / 45000.0 * 1000 as d from s),
        k as (select *, case when over > 1.6 or m > 260 then 'high' when over > 1.25 or m > 180 then 'medium' else 'low' end as fit_risk from r),
        c as (select *, case when m <= 1200 and d <= 18 then 'ocr_overlay_candidate' when d > 22 then 'ocr_side_annotation' when fit_risk in ('low', 'medium') and d <= 18 then 'ocr_overlay_candidate' else 'ocr_side_annotation' end as strategy,
          case when fit_risk = 'low' and over <= 1.25 and m <= 180 then 'image_overlay_candidate' else 'side_annotation_recommended' end as recommendation from k)
        select doc_id, fit_risk, strategy, recommendation, case recommendation when 'image_overlay_candidate' then 'ready_for_image_overlay' else 'side_annotation_review' end as readiness from c""",
    "fused_pages": """select 0 as doc_id, o_custkey as page_number, coalesce(max(case when o_orderstatus = 'P' then 'ocr_only' end), case when bool_or(o_orderstatus = 'F') then 'native_only' else 'ocr_only' end) as route,
        count(*) filter (o_orderstatus = 'F') as native_region_count, count(*) filter (o_orderstatus <> 'F') as ocr_region_count from orders group by o_custkey""",
    "missing_pages": "select 0 as doc_id, c_custkey as page_number from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "recognised_lines": """with w as (select l_orderkey as doc_id, l_linenumber * 1000000 + l_partkey as pos, ascii(l_returnflag) as line_num, (l_partkey % 500)::int as l, (l_suppkey % 300)::int as t, l_quantity::int as w, l_linestatus as s from lineitem),
        e as (select doc_id, max(l + w) as iw, max(t + 10) as ih from w group by 1),
        g as (select doc_id, line_num, string_agg(s, ' ' order by pos, s) as text, min(l) as x0, min(t) as y0, max(l + w) as x1, max(t + 10) as y1, count(*) as word_count, min(pos) as first from w group by 1, 2)
        select doc_id, row_number() over (partition by doc_id order by first, line_num) as line_index, line_num, text, x0, y0, x1, y1, x0 <= 3 as touches_left_edge, iw > 0 and x1 >= iw - 3 as touches_right_edge, y0 <= 3 as touches_top_edge, ih > 0 and y1 >= ih - 3 as touches_bottom_edge, word_count from g join e using (doc_id)""",
}
