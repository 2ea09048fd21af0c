"""Segments, groups and batches of lines, prompts and answers, and the stage that calls a translator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

_PART = "array<struct<segment_id:string,source_text:string,protected_text:string,g:int>>"


def segments(lines: DataFrame) -> DataFrame:
    """lines: doc_id, page_number, block_pos, line_pos, text -> the lines worth translating, with their ids and masked texts."""
    kept = lines.filter(T.is_candidate(F.col("text"))).withColumn("p", T.protected(F.col("text")))
    ident = F.format_string("P%sB%sL%s", F.col("page_number").cast("string"), F.col("block_pos").cast("string"), F.col("line_pos").cast("string"))
    return kept.select("doc_id", "page_number", "block_pos", "line_pos", ident.alias("segment_id"), F.col("text").alias("source_text"), F.col("p.text").alias("protected_text"), F.col("p.items").alias("placeholders"))


def groups(segs: DataFrame, max_lines: int = 3, max_chars: int = 280) -> DataFrame:
    """Lines of a block that are translated together: a fold over the block's lines that numbers the groups.

    A heading or list item begins a group, and so does what follows a list item; a group ends after a heading, a list item or a sentence.
    """
    rows = F.array_sort(F.collect_list(F.struct("line_pos", "segment_id", "source_text", "protected_text")))
    blocks = segs.groupBy("doc_id", "page_number", "block_pos").agg(rows.alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(T.strip(x["protected_text"]))
        single = T.is_heading_like(x["source_text"]) | T.is_list_like(x["source_text"])
        new = (acc["n"] > 0) & (single | acc["after_list"] | (acc["n"] >= max_lines) | (acc["chars"] + n > max_chars))
        g = acc["g"] + F.when(new, 1).otherwise(0)
        ends = single | T.ends_sentence(x["source_text"])
        out = F.concat(acc["out"], F.array(F.struct(x["segment_id"].alias("segment_id"), x["source_text"].alias("source_text"), x["protected_text"].alias("protected_text"), g.cast("int").alias("g"))))
        return F.struct(
            (g + F.when(ends, 1).otherwise(0)).cast("int").alias("g"),
            F.when(ends, 0).otherwise(F.when(new, 1).otherwise(acc["n"] + 1)).cast("int").alias("n"),
            F.when(ends, 0).otherwise(F.when(new, n).otherwise(acc["chars"] + n)).cast("int").alias("chars"),
            T.is_list_like(x["source_text"]).alias("after_list"),
            out.alias("out"),
        )

    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(False).alias("after_list"), F.array().cast(_PART).alias("out"))
    numbered = blocks.select("doc_id", "page_number", "block_pos", F.posexplode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("pos", "x"))
    member = F.array_sort(F.collect_list(F.struct("pos", F.col("x.segment_id").alias("segment_id"), F.col("x.protected_text").alias("protected_text"))))
    out = numbered.groupBy("doc_id", "page_number", "block_pos", F.col("x.g").alias("group_no")).agg(member.alias("members"))
    ident = F.format_string("P%sB%sG%s", F.col("page_number").cast("string"), F.col("block_pos").cast("string"), F.col("group_no").cast("string"))
    return out.withColumn("group_id", ident)


def group_text(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: F.concat(F.lit("["), m["segment_id"], F.lit("] "), m["protected_text"])), "\n")


def batches(grouped: DataFrame, max_groups: int = 8, max_chars: int = 2500) -> DataFrame:
    """Adds batch_no: groups of a document, in order, packed greedily; one that is too long stands alone.

    The packing is sequential, so it is a fold over a document's group lengths; texts don't take part.
    """
    sized = grouped.withColumn("chars", F.length(group_text(F.col("members"))))
    order = F.array_sort(F.collect_list(F.struct("page_number", "block_pos", "group_no", "chars")))

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["n"] >= max_groups) | ((acc["n"] > 0) & (acc["chars"] + x["chars"] > max_chars))
        b = acc["b"] + F.when(flush, 1).otherwise(0)
        out = F.concat(acc["out"], F.array(b.cast("int")))
        return F.struct(b.cast("int").alias("b"), F.when(flush, 1).otherwise(acc["n"] + 1).cast("int").alias("n"), F.when(flush, x["chars"]).otherwise(acc["chars"] + x["chars"]).cast("int").alias("chars"), out.alias("out"))

    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))
    folded = sized.groupBy("doc_id").agg(order.alias("o")).withColumn("b", F.aggregate("o", start, step, lambda a: a["out"]))
    numbers = folded.select("doc_id", F.explode(F.arrays_zip("o", "b")).alias("z")).select("doc_id", "z.o.page_number", "z.o.block_pos", "z.o.group_no", F.col("z.b").alias("batch_no"))
    return sized.join(numbers, ["doc_id", "page_number", "block_pos", "group_no"])


#: An answer's line, an id in brackets and text, and lines that say nothing.
_ANSWER = r"^\[(P\d+B\d+L\d+)\]\s?(.*)$"
NOISE = ["### Response:", "Response:", "Translation:", "Translated segments:", "Output:", "```", "</GROUP>"]


def parsed(response: Column) -> Column:
    """struct(answers: map of id to text, the last of each; errors: lines that are neither answers nor noise nor group tags)."""
    ls = F.filter(T.lines(response), lambda x: ~x.isin(NOISE) & ~F.startswith(x, F.lit("<GROUP ")))
    answers = F.filter(ls, lambda x: F.rlike(x, F.lit(_ANSWER)))
    pairs = F.transform(answers, lambda x: F.struct(F.regexp_extract(x, _ANSWER, 1).alias("key"), T.strip(F.regexp_extract(x, _ANSWER, 2)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.struct(F.map_from_entries(last).alias("answers"), F.filter(ls, lambda x: ~F.rlike(x, F.lit(_ANSWER))).alias("errors"))


def complete(expected: Column, answers: Column) -> Column:
    """Whether exactly the expected ids were answered."""
    got = F.map_keys(answers)
    return (F.size(F.array_except(expected, got)) == 0) & (F.size(F.array_except(got, expected)) == 0)


def apply_translations(segs: DataFrame, translated: DataFrame) -> DataFrame:
    """translated: doc_id, segment_id, translated_text; what has none keeps its masked text; all are unmasked."""
    joined = segs.join(translated, ["doc_id", "segment_id"], "left").withColumn("translated_text", F.coalesce("translated_text", "protected_text"))
    return joined.withColumn("restored_text", T.restored(F.col("translated_text"), F.col("placeholders")))


def mock(c: Column) -> Column:
    return F.concat(F.lit("[EN] "), c)


def call_translator(rows: DataFrame, translate: Callable[[str], str], text: str = "protected_text") -> DataFrame:
    """Adds translated_text and status by a function that runs on the executors; a failure is a status and keeps the text.

    Rows that rules can translate should be split off before, since each row here is a call.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", translated_text string, status string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, status = [], []
            for t in frame[text]:
                try:
                    out.append(translate(t))
                    status.append("translated")
                except TimeoutError:
                    out.append(f"[TIMEOUT] {t}")
                    status.append("timeout")
                except Exception as e:  # noqa: BLE001 - the row says what happened
                    out.append(t)
                    status.append(f"error: {type(e).__name__}")
            yield frame.assign(translated_text=out, status=status)

    return rows.mapInPandas(run, schema)


def prompt(members: Column, source: str = "French", target: str = "English") -> Column:
    """What a group's lines are asked with; the ids must come back."""
    return F.concat(F.lit(f"Translate from {source} to {target}. Keep each id and every [[KEY]] as it is.\n"), group_text(members))


def by_rules(rows: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose whole text is in the glossary (term, translation), translated; and those left for a translator. The glossary is small."""
    terms = glossary.select(F.lower(T.collapsed(F.col("term"))).alias("_term"), F.col("translation").alias("translated_text")).dropDuplicates(["_term"])
    joined = rows.join(terms, F.lower(T.collapsed(rows["source_text"])) == F.col("_term"), "left").drop("_term")
    return joined.filter("translated_text is not null").withColumn("method", F.lit("glossary")), joined.filter("translated_text is null").drop("translated_text")
