"""Page lists: "1,3-5" or "all"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_pages(pages: str) -> list[tuple[int, int]] | None:
    """Ranges in the order given; None for all. ValueError for a descending range or a page below one."""
    if pages.strip().lower() == "all":
        return None
    ranges = []
    for part in filter(None, map(str.strip, pages.split(","))):
        first, dash, last = part.partition("-")
        low, high = int(first), int(last) if dash else int(first)
        if low > high or low < 1:
            raise ValueError(f"no page range: {part}")
        ranges.append((low, high))
    return ranges


def select_pages(df: DataFrame, pages: str) -> DataFrame:
    """The rows of the pages named. Ranges become one predicate, so nothing is listed or joined.

    Apply after what looks at whole documents, such as repeat counts.
    """
    ranges = parse_pages(pages)
    if ranges is None:
        return df
    keep = F.lit(False)
    for low, high in ranges:
        keep = keep | F.col("page_number").between(low, high)
    return df.filter(keep)
