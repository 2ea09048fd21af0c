"""Colours and fonts of spans, for drawing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(c: Column) -> Column:
    """0xRRGGBB as shares of one."""
    part = lambda n: F.shiftright(c, n).bitwiseAND(255) / 255.0
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def luminance(c: Column) -> Column:
    x = rgb(c)
    return 0.2126 * x["r"] + 0.7152 * x["g"] + 0.0722 * x["b"]


def contrasting(c: Column) -> Column:
    """White text on dark, black on light."""
    return F.when(luminance(c) < 0.48, 0xFFFFFF).otherwise(0)


def mode(values: Column) -> Column:
    """The most frequent value; of equally frequent ones the first."""
    distinct = F.array_distinct(F.array_compact(values))
    counted = F.transform(distinct, lambda v: F.struct(-F.size(F.filter(values, lambda x: x == v)).alias("n"), F.array_position(values, v).alias("at"), v.alias("v")))
    return F.get(F.array_sort(counted), 0)["v"]


def color_mode(values: Column) -> Column:
    n = F.size(F.array_distinct(F.array_compact(values)))
    return F.when(n == 0, "unknown").when(n == 1, "uniform").otherwise("mixed")


def base_font(font: Column) -> Column:
    """A font name as one of the base fonts; slanted Times stays upright."""
    f = F.lower(F.coalesce(font, F.lit("")))
    has = lambda w: F.contains(f, F.lit(w))
    of = lambda times, courier, other: F.when(has("times"), times).when(has("courier"), courier).otherwise(other)
    return F.when(has("bold"), of("tibo", "cobo", "hebo")).when(has("italic") | has("oblique"), of("tiro", "coit", "heit")).otherwise(of("tiro", "cour", "helv"))
