"""Greedy chunks of text for translation and drawing, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T


def by_words(c: Column, limit: int) -> Column:
    """Words packed into chunks of at most ``limit`` characters; a longer word stands alone."""
    return T.packed(T.words(c), limit)


def paragraphs(c: Column, limit: int = 520) -> Column:
    """Paragraphs, long ones cut by words, packed again with blank lines between."""
    parts = F.filter(F.transform(F.split(T.ocr_normalized(c), "\n\n"), T.collapsed), lambda p: p != "")
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(by_words(p, limit))))
    return T.packed(cut, limit, "\n\n")


def preview_segments(lines: Column, role: Column, text: Column, max_lines: int = 2, max_chars: int = 220) -> Column:
    """Chunks of a region's lines; a symbolic text or slide title stays whole."""
    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        room = (F.size(last) < max_lines) & (F.aggregate(last, F.lit(0), lambda n, l: n + F.length(l)) + F.length(x) <= max_chars)
        return F.when(F.size(acc) == 0, F.array(F.array(x))).when(room, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(acc, F.array(F.array(x))))

    folded = F.aggregate(lines, F.array().cast("array<array<string>>"), add)
    return F.when(T.is_symbolic(text) | (role == "slide_title"), F.array(lines)).otherwise(folded)


def to_line_count(c: Column, n: Column) -> Column:
    """Words spread over ``n`` lines of about equal length; lines that are left over stay empty."""
    w = T.words(c)
    total, target = F.size(w), F.greatest(F.lit(1.0), F.length(T.collapsed(c)) / n)

    def add(acc: Column, x: Column) -> Column:
        longer = F.concat_ws(" ", F.nullif(acc["line"], F.lit("")), x)
        full = (acc["line"] != "") & (F.size(acc["lines"]) < n - 1) & (F.length(longer) > target) & (total - acc["i"] >= n - F.size(acc["lines"]))
        return F.struct((acc["i"] + 1).alias("i"), F.when(full, x).otherwise(longer).alias("line"), F.when(full, F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"]).alias("lines"))

    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("line"), F.array().cast("array<string>").alias("lines"))
    found = F.aggregate(w, start, add, lambda acc: F.concat(acc["lines"], F.array(acc["line"])))
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.concat(found, F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(found)).cast("int"))))


def to_source_lines(c: Column, units: Column) -> Column:
    """Words shared out to lines by the lines' ``units``, at least one each; null with one line or none, or fewer words than lines."""
    w, n = T.words(c), F.size(units)
    total = F.aggregate(units, F.lit(0), lambda a, u: a + u)

    def add(ends: Column, u: Column) -> Column:
        taken = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))
        share = F.greatest(F.lit(1), F.rint(F.size(w) * (u / total)).cast("int"))
        return F.concat(ends, F.array(F.when(F.size(ends) == n - 1, F.size(w)).otherwise(taken + F.least(share, F.size(w) - taken - (n - F.size(ends) - 1)))))

    ends = F.aggregate(units, F.array().cast("array<int>"), add)
    start = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    cut = F.transform(ends, lambda e, i: F.array_join(F.slice(w, start(i) + 1, e - start(i)), " "))
    return F.when((n > 1) & (F.size(w) >= n), cut)


def by_colors(c: Column, spans: Column) -> Column:
    """A line's translation cut by the lengths of its source spans (text, color), as (text, color); null unless two colours meet."""
    held = F.filter(spans, lambda s: T.strip(s["text"]) != "")
    length, m = F.length(c), F.size(held)
    units = F.transform(held, lambda s: F.greatest(F.lit(1), F.length(T.strip(s["text"]))))
    total = F.aggregate(units, F.lit(0), lambda a, u: a + u)

    def add(acc: Column, u: Column) -> Column:
        done, k = acc["done"] + u, F.size(acc["ends"])
        begin = F.coalesce(F.get(acc["ends"], k - 1), F.lit(0))
        end = F.greatest(begin + 1, F.least(F.rint(length * (done / total)).cast("int"), length - (m - k - 1)))
        return F.struct(done.cast("int").alias("done"), F.concat(acc["ends"], F.array(F.when(k == m - 1, length).otherwise(end))).alias("ends"))

    ends = F.aggregate(units, F.struct(F.lit(0).alias("done"), F.array().cast("array<int>").alias("ends")), add, lambda a: a["ends"])
    start = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    cut = F.transform(ends, lambda e, i: F.struct(F.substr(c, start(i) + 1, F.greatest(F.lit(0), e - start(i))).alias("text"), F.get(held, i)["color"].alias("color")))
    colors = F.array_distinct(F.transform(held, lambda s: s["color"]))
    return F.when((T.strip(c) != "") & (m > 1) & (F.size(colors) > 1) & (length > 1), F.filter(cut, lambda x: x["text"] != ""))


def for_drawing(c: Column, limit: int = 180) -> Column:
    """Recognised lines as (text, segment_role): whole ones, and chunks by words of those over ``limit``."""
    part = lambda xs, role: F.transform(xs, lambda t: F.struct(t.alias("text"), F.lit(role).alias("segment_role")))
    return F.flatten(F.transform(T.lines(T.ocr_normalized(c)), lambda x: F.when(F.length(x) <= limit, part(F.array(x), "ocr_line")).otherwise(part(by_words(x, limit), "ocr_text_chunk"))))


#: How lines of controls begin, and whole lines that are controls.
CONTROL_STARTS = ["o ", "0 ", "® ", "☐ ", "☑ ", "[ ] ", "[x] ", "[ x ] "]
CONTROL_LINES = ["generate lorem ipsum", "générer du lorem ipsum", "generer du lorem ipsum"]


def is_control_line(c: Column) -> Column:
    """A line of a form rather than of prose."""
    t = F.lower(T.collapsed(c))
    begins = F.exists(F.array(*map(F.lit, CONTROL_STARTS)), lambda p: F.startswith(t, p))
    return (begins & (F.length(t) <= 140)) | t.isin(CONTROL_LINES)


def without_controls(c: Column) -> Column:
    """Without lines of controls, unless nothing else is there."""
    kept = T.strip(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_control_line(x)), "\n"))
    return F.when(kept != "", kept).otherwise(T.strip(c))


def to_budgets(c: Column, budgets: Column) -> Column:
    """Words over lines in proportion to the lines' budgets; a line ends once the next word would pass its share and enough words are left."""
    w, n = T.words(c), F.size(budgets)
    size, total = F.length(T.collapsed(c)), F.aggregate(budgets, F.lit(0), lambda a, b: a + F.greatest(F.lit(1), b))

    def add(acc: Column, x: Column) -> Column:
        line = F.size(acc["lines"])
        share = F.greatest(F.lit(1.0), size * F.greatest(F.lit(1), F.coalesce(F.get(budgets, line), F.lit(1))) / total)
        longer = F.concat_ws(" ", F.nullif(acc["line"], F.lit("")), x)
        full = (acc["line"] != "") & (line < n - 1) & (F.length(longer) > share) & (F.size(w) - acc["i"] - 1 >= n - line - 1)
        return F.struct((acc["i"] + 1).alias("i"), F.when(full, x).otherwise(longer).alias("line"), F.when(full, F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"]).alias("lines"))

    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("line"), F.array().cast("array<string>").alias("lines"))
    found = F.aggregate(w, start, add, lambda a: F.concat(a["lines"], F.array(a["line"])))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.concat(found, F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(found)).cast("int"))))
