"""Boxes as structs of x0, y0, x1, y1, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])


def _edge(b: Column, name: str) -> Column:
    return F.coalesce(b[name], F.lit(0.0))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), _edge(b, "x1") - _edge(b, "x0"))


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), _edge(b, "y1") - _edge(b, "y0"))


def area(b: Column) -> Column:
    return width(b) * height(b)


def area_ratio(b: Column, page_width: Column, page_height: Column) -> Column:
    return area(b) / F.greatest(F.lit(1.0), page_width * page_height)


def x_center(b: Column) -> Column:
    return _edge(b, "x0") + width(b) / 2


def y_center(b: Column) -> Column:
    return _edge(b, "y0") + height(b) / 2


def vertical_zone(b: Column, page_height: Column) -> Column:
    y = y_center(b)
    return F.when(page_height <= 0, "unknown_vertical_zone").when(y <= page_height * 0.15, "header_zone").when(y >= page_height * 0.85, "footer_zone").otherwise("body_zone")


def horizontal_zone(b: Column, page_width: Column) -> Column:
    x = x_center(b)
    return F.when(page_width <= 0, "unknown_horizontal_zone").when(x <= page_width * 0.20, "left_margin").when(x >= page_width * 0.80, "right_margin").otherwise("center_band")


def _overlap(a: Column, b: Column, low: str, high: str) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(_edge(a, high), _edge(b, high)) - F.greatest(_edge(a, low), _edge(b, low)))
    least = F.least(F.greatest(F.lit(0.0), _edge(a, high) - _edge(a, low)), F.greatest(F.lit(0.0), _edge(b, high) - _edge(b, low)))
    return F.when(least > 0, shared / least).otherwise(0.0)


def horizontal_overlap(a: Column, b: Column) -> Column:
    return _overlap(a, b, "x0", "x1")


def vertical_overlap(a: Column, b: Column) -> Column:
    return _overlap(a, b, "y0", "y1")


def vertical_gap(above: Column, below: Column) -> Column:
    return F.greatest(F.lit(0.0), _edge(below, "y0") - _edge(above, "y1"))


def padded_crop(b: Column, page_width: Column, page_height: Column, pad: float = 8.0) -> Column:
    """The box grown by ``pad`` within the page, and which edges the page held back."""
    out = box(F.greatest(F.lit(0.0), b["x0"] - pad), F.greatest(F.lit(0.0), b["y0"] - pad), F.least(page_width, b["x1"] + pad), F.least(page_height, b["y1"] + pad))
    held = F.array_compact(F.array(F.when(b["x0"] - pad < 0, "left"), F.when(b["y0"] - pad < 0, "top"), F.when(b["x1"] + pad > page_width, "right"), F.when(b["y1"] + pad > page_height, "bottom")))
    return F.struct(out.alias("crop"), held.alias("constrained"))


def union(boxes: Column) -> Column:
    return box(*[f(F.transform(boxes, lambda b, n=n: b[n])) for f, n in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))])
