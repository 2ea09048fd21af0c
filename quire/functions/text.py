"""Text rules as column expressions. Patterns carry (?U), since the rules mean Unicode's classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space, as a list to trim by; a pattern would be tried at every run of it.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACE))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), 0)


def collapsed(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def normalized(c: Column) -> Column:
    """One form for blocks that differ only in white space and numbers that stand alone."""
    return F.regexp_replace(collapsed(c), r"(?U)\b\d+\b", "{N}")


def lines(c: Column) -> Column:
    """The lines with something in them, stripped."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n"), strip), lambda x: x != "")


def line_count(c: Column) -> Column:
    return F.size(lines(c))


def text_length(c: Column) -> Column:
    return F.length(strip(F.replace(c, F.lit("\n"), F.lit(" "))))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def is_candidate(c: Column) -> Column:
    """Worth translating: three letters at least."""
    return F.coalesce(letters(c) >= 3, F.lit(False))


def is_symbolic(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return (t == "") | (F.contains(t, F.lit("|")) & (F.length(t) <= 40)) | ((letters(t) <= 4) & (F.length(t) <= 24))


def is_list_like(c: Column) -> Column:
    t = strip(c)
    return F.startswith(t, F.lit("- ")) | F.rlike(t, F.lit(r"(?U)^\d+\.\s"))


def is_heading_like(c: Column) -> Column:
    """Short, no list, in title case: each run of letters has a capital first and none after."""
    t = strip(c)
    cased = F.rlike(t, F.lit(r"\p{Lu}|\p{Lt}"))
    titled = ~F.rlike(t, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]|(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}"))
    return (t != "") & (F.length(t) <= 60) & ~is_list_like(c) & cased & titled


def ends_sentence(c: Column) -> Column:
    return F.rlike(strip(c), F.lit(r"[.?!:]$"))


def preview(c: Column, limit: int = 220) -> Column:
    t = collapsed(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 3), r"(?U)\s+$", ""), F.lit("...")))


def without_artifacts(c: Column) -> Column:
    """A line that begins with its only question mark and a space had a bullet there."""
    return F.regexp_replace(c, r"(?m)^([^\S\n]*)\? ([^?\n]*)$", "$1- $2")


#: What is masked before translation, in this order.
PLACEHOLDERS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("url", r"\bhttps?://[^\s]+"),
    ("commit", r"\b[a-f0-9]{32,64}\b"),
    ("iso_date", r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\b"),
    ("version", r"\b\d+(?:\.\d+){2,5}\b"),
]
MASKED = "struct<text:string,items:array<struct<key:string,value:string,kind:string>>>"


def protected(c: Column) -> Column:
    """struct(text, items): values masked by numbered keys. A value is masked once, at its first place; kinds see what those before left."""
    def mask(kind: Column):
        def one(acc: Column, value: Column) -> Column:
            key = F.concat(F.lit("[["), kind, F.lit("_"), (F.size(acc["items"]) + 1).cast("string"), F.lit("]]"))
            at = F.instr(acc["text"], value)
            text = F.concat(F.substr(acc["text"], F.lit(1), at - 1), key, F.substr(acc["text"], at + F.length(value)))
            item = F.struct(key.alias("key"), value.alias("value"), F.lower(kind).alias("kind"))
            known = F.exists(acc["items"], lambda i: i["value"] == value) | (at == 0)
            return F.when(known, acc).otherwise(F.struct(text.alias("text"), F.concat(acc["items"], F.array(item)).alias("items")))

        return one

    start = F.struct(c.alias("text"), F.array().cast("array<struct<key:string,value:string,kind:string>>").alias("items"))
    kinds = F.array(*[F.struct(F.lit(k.upper()).alias("kind"), F.lit("(?U)" + p).alias("pattern")) for k, p in PLACEHOLDERS])
    # kinds are folded too, so that each sees what those before it left, and no state is computed twice
    return F.aggregate(kinds, start, lambda acc, k: F.aggregate(F.array_distinct(F.regexp_extract_all(acc["text"], k["pattern"], F.lit(0))), acc, mask(k["kind"])))


def restored(text: Column, items: Column) -> Column:
    return F.aggregate(items, text, lambda t, i: F.replace(t, i["key"], i["value"]))


def placeholders_kept(text: Column, items: Column) -> Column:
    """Whether exactly the expected keys are in the text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[[A-Z_0-9]+\]\]"), F.lit(0)))
    keys = F.transform(items, lambda i: i["key"])
    return (F.size(F.array_except(found, keys)) == 0) & (F.size(F.array_except(keys, found)) == 0)


def packed(parts: Column, limit: int, joiner: str = " ") -> Column:
    """Greedy packing of strings, in order, into strings of at most ``limit`` characters; a longer one stands alone."""
    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        room = F.length(last) + len(joiner) + F.length(x) <= limit
        return F.when(F.size(acc) == 0, F.array(x)).when(room, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(joiner), x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def ocr_normalized(c: Column) -> Column:
    """Line ends without white space, nothing around the whole."""
    return strip(F.regexp_replace(strip(c), r"(?Um)[^\S\n]+$", ""))


def suspicious(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "®©™�", ""))


def ocr_quality(c: Column) -> Column:
    t = ocr_normalized(F.coalesce(c, F.lit("")))
    n = F.size(words(t))
    return F.when(t == "", "empty").when(n < 4, "weak").when(suspicious(t) >= 3, "review").when((F.length(t) >= 80) & (n >= 12), "usable").otherwise("review")
