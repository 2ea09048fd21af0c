"""Which blocks are drawn over, in what order they read, what belongs together, and whether a page is ready."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.roles import CANDIDATE_ROLES, QUANTITY

KEY = ["doc_id", "page_number"]
# Why a role is taken or left.
SELECTED = {
    "content": "selected_as_content", "slide_title": "selected_as_title", "title": "selected_as_title", "section_step": "selected_as_section_step", "short_label": "selected_as_short_label", "list_item": "selected_as_list_item",
    "caption": "selected_as_caption", "table_header": "selected_as_table_header", "table_cell": "selected_as_table_cell", "diagram_label": "selected_as_glossary_backed_diagram_label",
}
EXCLUDED = {
    "billing_metadata": "excluded_as_billing_metadata", "diagram_label": "excluded_as_untranslated_diagram_label", "diagram_token": "excluded_as_diagram_token", "footer": "excluded_as_footer", "header": "excluded_as_header",
    "legal_footer": "excluded_as_legal_footer", "numeric_value": "excluded_as_numeric_value", "ornament": "excluded_as_ornament", "page_number": "excluded_as_page_number", "repeated_chrome": "excluded_as_repeated_chrome",
    "sensitive_metadata": "excluded_as_sensitive_metadata", "support_metadata": "excluded_as_support_metadata",
}
# Reasons that are hard, groups that soften them, and groups that are looked at themselves.
HARD = ["review_candidate_content_role_in_footer_zone", "review_candidate_content_role_in_header_zone", "review_candidate_order_moves_up_page", "review_structural_exclusion_in_body_zone"]
STRUCTURED = ["heading_group", "ingredient_list_group", "instruction_group", "step_group", "table_group"]
COMPLEX = ["ingredient_list_group", "instruction_group", "step_group", "table_group"]


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def split_blocks(blocks: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Adds is_candidate, selection_reason, exclusion_reason and the page zones. A diagram label counts only if its text is in the glossary (term)."""
    if glossary is None:
        known = blocks.withColumn("_known", F.lit(False))
    else:
        terms = glossary.select(F.col("term").alias("_term")).distinct()
        known = blocks.join(terms, T.strip(blocks["text"]) == F.col("_term"), "left").withColumn("_known", F.col("_term").isNotNull()).drop("_term")
    chosen = F.coalesce(F.col("role").isin(CANDIDATE_ROLES) & ((F.col("role") != "diagram_label") | F.col("_known")), F.lit(False))
    return (
        known.withColumn("is_candidate", chosen)
        .withColumn("selection_reason", F.when(F.col("is_candidate"), _lookup(SELECTED, F.col("role"), "selected_as_translatable_role")))
        .withColumn("exclusion_reason", F.when(~F.col("is_candidate"), _lookup(EXCLUDED, F.coalesce("role", F.lit("")), "excluded_as_non_translatable_role")))
        .withColumn("vertical", G.vertical_zone(F.col("bbox"), F.coalesce("height", F.lit(0.0))))
        .withColumn("horizontal", G.horizontal_zone(F.col("bbox"), F.coalesce("width", F.lit(0.0))))
        .drop("_known")
    )


def merge_titles(split: DataFrame) -> DataFrame:
    """Digits and dashes right after a slide title on its line belong to it: their text is added to the title's, their rows go."""
    page = Window.partitionBy(*KEY).orderBy("block_index")
    title = F.col("is_candidate") & (F.col("role") == "slide_title")
    lead = split.withColumn("_title", F.last(F.when(title, F.struct("block_index", "bbox")), True).over(page))
    b, t = F.col("bbox"), F.col("_title.bbox")
    fits = (
        ~title & F.col("_title").isNotNull() & F.col("role").isin("header", "page_number", "diagram_token") & F.rlike(T.strip(F.col("text")), F.lit(r"(?U)^[\d\-–—]+$"))
        & (F.greatest(F.lit(0.0), b["x0"] - t["x1"]) <= 16) & (G.vertical_overlap(b, t) >= 0.9)
    )
    near = lead.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    # only an unbroken run after the title: nothing in between that doesn't fit
    broken = near.withColumn("_broken", F.sum(F.when(~F.col("_fits"), 1).otherwise(0)).over(page))
    at_title = broken.withColumn("_at", F.last(F.when(title, F.col("_broken")), True).over(page))
    joined = at_title.withColumn("_join", F.col("_fits") & (F.col("_broken") == F.col("_at")))
    run = Window.partitionBy(*KEY, "_title.block_index")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_join"), F.struct("block_index", T.strip(F.col("text")).alias("t")))).over(run)), lambda x: x["t"]), " ")
    out = joined.withColumn("_parts", parts).withColumn("text", F.when(title & (F.col("_parts") != ""), F.concat_ws(" ", T.strip(F.col("text")), "_parts")).otherwise(F.col("text")))
    return out.filter(~F.col("_join")).drop("_title", "_fits", "_broken", "_at", "_join", "_parts")


def reading_flow(candidates: DataFrame, order: str = "block_index", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds reading_order, x_overlap and vertical_gap to the one before, the same to the one after (next_), flow and flow_flags; within ``by`` of a page."""
    page = Window.partitionBy(*KEY, *by).orderBy(order)
    out = candidates.withColumn("reading_order", F.row_number().over(page) - 1).withColumn("_prev", F.lag("bbox").over(page)).withColumn("_n", F.count("*").over(Window.partitionBy(*KEY, *by)))
    first = F.col("_prev").isNull()
    out = out.withColumn("x_overlap", F.when(~first, G.horizontal_overlap(F.col("_prev"), F.col("bbox")))).withColumn("vertical_gap", F.when(~first, G.vertical_gap(F.col("_prev"), F.col("bbox"))))
    out = out.withColumn("_next", F.lead("bbox").over(page))
    last = F.col("_next").isNull()
    out = out.withColumn("next_x_overlap", F.when(~last, G.horizontal_overlap(F.col("bbox"), F.col("_next")))).withColumn("next_vertical_gap", F.when(~last, G.vertical_gap(F.col("bbox"), F.col("_next"))))
    flow = (
        F.when(F.col("_n") == 1, "isolated_block")
        .when(F.col("role").isin("table_header", "table_cell"), "table_like_flow")
        .when(F.col("role").isin("caption", "diagram_label"), "floating_label_or_caption")
        .when(F.col("x_overlap") < 0.5, "multi_column_candidate")
        .otherwise("single_column_flow")
    )
    up = F.col("_prev.y0") - F.col("bbox.y0") > F.greatest(F.lit(48.0), F.col("height") * 0.10)
    gap = F.col("vertical_gap") > F.greatest(F.lit(96.0), F.col("height") * 0.25)
    flags = F.array_compact(F.array(F.when(up, "review_candidate_order_moves_up_page"), F.when(gap, "review_large_vertical_gap_between_candidates")))
    return out.withColumn("flow", flow).withColumn("flow_flags", flags).drop("_prev", "_next", "_n")


def zone_flags(role: Column, vertical: Column, horizontal: Column, exclusion_reason: Column, group_type: Column) -> Column:
    """Of a candidate, whose exclusion reason is null, or of an excluded block."""
    named = role.isin("content", "list_item", "caption", "table_cell", "table_header", "diagram_label")
    margin = role.isin("content", "caption", "diagram_label") & horizontal.isin("left_margin", "right_margin") & ~group_type.eqNullSafe("ingredient_list_group")
    taken = F.array_compact(
        F.array(
            F.when(named & (vertical == "header_zone"), "review_candidate_content_role_in_header_zone"),
            F.when(named & (vertical == "footer_zone"), "review_candidate_content_role_in_footer_zone"),
            F.when(margin, "review_candidate_content_role_in_margin"),
        )
    )
    structural = exclusion_reason.isin("excluded_as_footer", "excluded_as_header", "excluded_as_legal_footer", "excluded_as_page_number") & (vertical == "body_zone")
    left = F.array_compact(F.array(F.when(structural, "review_structural_exclusion_in_body_zone")))
    return F.when(exclusion_reason.isNull(), taken).otherwise(left)


def zone_summary(split: DataFrame) -> DataFrame:
    """Blocks by page and vertical zone, and by page and horizontal zone, with the role: two grouping sets in one pass."""
    rows = split.select(*KEY, "role", F.explode(F.array(F.struct(F.lit("vertical").alias("dimension"), F.col("vertical").alias("zone")), F.struct(F.lit("horizontal").alias("dimension"), F.col("horizontal").alias("zone")))).alias("z"))
    return rows.groupBy(*KEY, "z.dimension", "z.zone", "role").agg(F.count("*").alias("blocks"))


# layout groups: each step takes from what the steps before it left, so a page is one sequential pass over its few blocks


def _same_column(a: dict, b: dict, page_width: float) -> bool:
    wa, wb = max(0.0, a["x1"] - a["x0"]), max(0.0, b["x1"] - b["x0"])
    shared = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    if min(wa, wb) > 0 and shared / min(wa, wb) >= 0.25:
        return True
    return abs(a["x0"] + wa / 2 - b["x0"] - wb / 2) <= max(48.0, page_width * 0.18)


_QUANTITY = re.compile(QUANTITY, re.IGNORECASE)
_NUMBERED = re.compile(r"^\s*\d{1,2}[.)]\s+")


def group_page(rows: list[dict], width: float, height: float) -> list[tuple[str, list[int]]]:
    """The groups of one page's candidates, as (type, positions in reading order): tables, steps, ingredients, instructions, headings, captions, the rest."""
    free = set(range(len(rows)))
    groups: list[tuple[str, list[int]]] = []
    of = lambda *roles: [i for i in sorted(free) if rows[i]["role"] in roles]
    below = lambda i, j, reach: 0 <= rows[j]["y0"] - rows[i]["y0"] <= reach
    column = lambda i, j: _same_column(rows[i], rows[j], width)

    def take(kind: str, members: Iterable[int]) -> None:
        members = sorted(set(members), key=lambda i: (rows[i]["y0"], rows[i]["x0"], i))  # a set has no order of its own for ties
        if members:
            groups.append((kind, members))
            free.difference_update(members)

    take("table_group", of("table_header", "table_cell"))
    for i in of("section_step"):
        take("step_group", [i, *(j for j in of("short_label", "content") if below(i, j, max(180.0, height * 0.28)) and column(i, j))])
    anchors = [i for i in of("list_item") if _QUANTITY.match(rows[i]["text"].strip())]
    if anchors:
        near = lambda j: any(column(i, j) for i in anchors)
        found = anchors + [j for j in of("short_label") if "ingr" in rows[j]["text"].casefold() and near(j)]
        ys = [rows[i]["y0"] for i in found]
        take("ingredient_list_group", found + [j for j in of("content") if rows[j]["line_count"] <= 2 and min(ys) - 80 <= rows[j]["y0"] <= max(ys) + 140 and near(j)])
    anchors = [i for i in of("list_item") if _NUMBERED.match(rows[i]["text"])]
    take("instruction_group", anchors + [j for j in of("content") if any(below(i, j, max(220.0, height * 0.35)) and column(i, j) for i in anchors)])
    for i in of("title", "slide_title"):
        if i in free:
            take("heading_group", [i, *(j for j in of("content", "short_label") if rows[j]["vertical"] == "header_zone" and abs(rows[j]["y0"] - rows[i]["y0"]) <= max(80.0, height * 0.08))])
    for i in of("caption", "diagram_label"):
        take("caption_group", [i])
    for i in sorted(free):
        take("isolated_group", [i])
    return groups


def layout_groups(candidates: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_index, group_id, group_type, position_in_group, candidate_count); a page's candidates are one small group."""
    kind = dict(candidates.select("doc_id", "page_number").dtypes)
    schema = f"doc_id {kind['doc_id']}, page_number {kind['page_number']}, block_index int, group_id string, group_index int, group_type string, position_in_group int, candidate_count int"
    flat = candidates.select(*KEY, F.col("block_index").cast("int"), "role", F.coalesce("text", F.lit("")).alias("text"), "vertical", T.line_count(F.coalesce("text", F.lit(""))).alias("line_count"), F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("height", F.lit(0.0)).alias("height"), *[F.coalesce(F.col(f"bbox.{e}"), F.lit(0.0)).alias(e) for e in ("x0", "y0", "x1", "y1")])

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("block_index")
        rows = page.to_dict("records")
        out = []
        for g, (kind_, members) in enumerate(group_page(rows, rows[0]["width"], rows[0]["height"])):
            out += [(rows[i]["doc_id"], rows[i]["page_number"], rows[i]["block_index"], f"P{rows[i]['page_number'] or 0}G{g}", g, kind_, k, len(members)) for k, i in enumerate(members)]
        return pd.DataFrame(out, columns=["doc_id", "page_number", "block_index", "group_id", "group_index", "group_type", "position_in_group", "candidate_count"])

    return flat.groupBy(*KEY).applyInPandas(run, schema)


def severity(reason: Column, group_type: Column) -> Column:
    softened = reason.isin(HARD[:3]) & F.coalesce(group_type.isin(STRUCTURED), F.lit(False))
    return F.when(reason == "blocked_no_overlay_candidates", "blocked").when(reason.isin(HARD) & ~softened, "hard_review").otherwise("soft_review")


def readiness(pages: DataFrame, reasons: DataFrame) -> DataFrame:
    """pages: doc_id, page_number, candidates (count); reasons: doc_id, page_number, reason, group_type -> status and counts of each page."""
    rank = F.create_map(F.lit("soft_review"), F.lit(1), F.lit("hard_review"), F.lit(2), F.lit("blocked"), F.lit(3))
    none = pages.filter("candidates = 0").select(*KEY, F.lit("blocked_no_overlay_candidates").alias("reason"), F.lit(None).cast("string").alias("group_type"))
    rated = reasons.select(*KEY, "reason", "group_type").unionByName(none).withColumn("severity", severity(F.col("reason"), F.col("group_type")))
    worst = rated.groupBy(*KEY).agg(F.max(F.element_at(rank, F.col("severity"))).alias("r"), F.count_if(F.col("severity") == "soft_review").alias("soft_review_items"), F.count_if(F.col("severity") == "hard_review").alias("hard_review_items"))
    status = F.when(F.col("r") == 3, "blocked").when(F.col("r") == 2, "hard_review").when(F.col("r") == 1, "soft_review").otherwise("ready")
    return pages.join(worst, KEY, "left").withColumn("status", status).drop("r").fillna(0, ["soft_review_items", "hard_review_items"])


def with_groups(split: DataFrame) -> DataFrame:
    """Adds group_id and group_type of candidates; null for other blocks."""
    found = layout_groups(split.filter("is_candidate")).select(*KEY, "block_index", "group_id", "group_type")
    return split.join(found, [*KEY, "block_index"], "left")


def reasons(grouped: DataFrame) -> DataFrame:
    """(doc_id, page_number, reason, group_type) of what is to be reviewed: zone flags, reading flow, and groups of complex kinds, once each.

    grouped: blocks with their zones and groups. A group as such softens nothing, so its own reason has no group type.
    """
    zones = grouped.select(*KEY, F.explode(zone_flags(F.col("role"), F.col("vertical"), F.col("horizontal"), F.col("exclusion_reason"), F.col("group_type"))).alias("reason"), "group_type")
    moves = reading_flow(grouped.filter("is_candidate")).select(*KEY, F.explode("flow_flags").alias("reason"), "group_type")
    kinds = grouped.filter(F.col("group_type").isin(COMPLEX)).select(*KEY, "group_id", "group_type").distinct()
    return zones.unionByName(moves).unionByName(kinds.select(*KEY, F.concat(F.lit("review_layout_group_"), "group_type").alias("reason"), F.lit(None).cast("string").alias("group_type")))


def _shown(text: Column) -> Column:
    return F.substring(T.strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" | "))), 1, 120)


def review_items(grouped: DataFrame) -> DataFrame:
    """A row for each block with zone or flow flags: kind (zone, flow), item_type (candidate, excluded), flags, reason of choice, preview, and its group unless isolated."""
    group = lambda c: F.when(F.col("group_type") != "isolated_group", F.col(c)).alias(c)
    common = [*KEY, "block_index", "role", F.coalesce("selection_reason", "exclusion_reason").alias("chosen_by"), T.line_count(F.coalesce("text", F.lit(""))).alias("line_count"), _shown(F.col("text")).alias("text_preview"), group("group_id"), group("group_type")]
    kind = F.when(F.col("is_candidate"), "candidate").otherwise("excluded").alias("item_type")
    flags = zone_flags(F.col("role"), F.col("vertical"), F.col("horizontal"), F.col("exclusion_reason"), F.col("group_type"))
    zones = grouped.withColumn("flags", flags).filter(F.size("flags") > 0).select(F.lit("zone").alias("kind"), kind, "flags", *common)
    moves = reading_flow(grouped.filter("is_candidate")).filter(F.size("flow_flags") > 0).select(F.lit("flow").alias("kind"), kind, F.col("flow_flags").alias("flags"), *common)
    return zones.unionByName(moves)


def group_review_items(grouped: DataFrame) -> DataFrame:
    """A row for each layout group that isn't a lone block: its blocks and roles from the top."""
    rows = grouped.filter("group_type <> 'isolated_group'").groupBy(*KEY, "group_id", "group_type").agg(F.array_sort(F.collect_list(F.struct(F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), "block_index", "role"))).alias("m"))
    return rows.select(*KEY, "group_id", "group_type", F.size("m").alias("candidate_count"), F.col("m.block_index").alias("block_indices"), F.col("m.role").alias("roles"))


def overlay_ready(split: DataFrame) -> DataFrame:
    """The counts of a page's overlay report: candidates and their lines, excluded blocks, items to review by kind, and the status with its severities.

    What reasons, review_items and readiness say row by row is counted here in one pass over a page's blocks.
    """
    grouped = reading_flow(with_groups(split), by=("is_candidate",))
    zones = zone_flags(F.col("role"), F.col("vertical"), F.col("horizontal"), F.col("exclusion_reason"), F.col("group_type"))
    rows = grouped.withColumn("_zones", zones).withColumn("_moves", F.when(F.col("is_candidate"), F.col("flow_flags")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_hard", F.size(F.filter(F.concat("_zones", "_moves"), lambda r: severity(r, F.col("group_type")) == "hard_review")))
    lines = T.line_count(F.coalesce("text", F.lit("")))
    pages = rows.groupBy(*KEY).agg(
        F.count_if("is_candidate").alias("candidates"), F.sum(F.when(F.col("is_candidate"), lines).otherwise(0)).alias("candidate_lines"), F.count_if(~F.col("is_candidate")).alias("excluded_blocks"),
        F.count_distinct(F.when(F.col("group_type") != "isolated_group", F.col("group_id"))).alias("layout_group_items"), F.count_distinct(F.when(F.col("group_type").isin(COMPLEX), F.col("group_id"))).alias("_complex"),
        F.sum("_hard").alias("hard_review_items"), F.sum(F.size("_zones") + F.size("_moves") - F.col("_hard")).alias("_soft"), F.count_if(F.size("_zones") > 0).alias("zone_items"), F.count_if(F.size("_moves") > 0).alias("flow_items"),
    )
    pages = pages.withColumn("soft_review_items", F.col("_soft") + F.col("_complex")).withColumn("review_items", F.col("zone_items") + F.col("flow_items") + F.col("_complex"))
    status = F.when(F.col("candidates") == 0, "blocked").when(F.col("hard_review_items") > 0, "hard_review").when(F.col("soft_review_items") > 0, "soft_review").otherwise("ready")
    return pages.withColumn("status", status).drop("_complex", "_soft")
