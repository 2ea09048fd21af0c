"""What drawing changed on a page, pixel by pixel: an edge stage over images, one row a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Rects = list[tuple[int, int, int, int]]


def covered(height: int, width: int, rects: Rects) -> np.ndarray:
    out = np.zeros((height, width), bool)
    for x0, y0, x1, y1 in rects:
        out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = True
    return out


def change_metrics(before: np.ndarray, after: np.ndarray, source: Rects, notes: Rects, threshold: int = 12) -> dict:
    """before and after: height x width x channels. Counts of changed pixels in zones and outside, and a verdict."""
    h, w = min(before.shape[0], after.shape[0]), min(before.shape[1], after.shape[1])
    c = min(3, before.shape[2], after.shape[2])
    changed = (np.abs(before[:h, :w, :c].astype(np.int16) - after[:h, :w, :c].astype(np.int16)) > threshold).any(axis=2)
    s, n = covered(h, w, source), covered(h, w, notes)
    allowed = s | n
    outside = int((changed & ~allowed).sum())
    share = lambda a, b: round(a / b, 6) if b > 0 else 0.0
    ratio = share(outside, int((~allowed).sum()))
    verdict = "unexpected_outside_changes" if outside and ratio > 0.001 else "expected_annotation_changes" if (changed & n).any() else "clean"
    return {
        "dimension_mismatch": before.shape[:2] != after.shape[:2], "total_pixels": h * w, "source_zone_pixels": int(s.sum()), "annotation_zone_pixels": int(n.sum()), "changed_pixels": int(changed.sum()), "changed_in_source_zone": int((changed & s).sum()),
        "changed_in_annotation_zone": int((changed & n).sum()), "changed_outside": outside, "changed_outside_ratio": ratio, "verdict": verdict,
    }


def dominant_color(image: np.ndarray, steps: int = 8, most: int = 4096) -> tuple[tuple[int, int, int], float]:
    """The mean colour of the fullest cell of a coarse RGB histogram, and its share; sampled by stride."""
    flat = image.reshape(-1, image.shape[-1])[:, :3]
    flat = flat[:: max(1, len(flat) // most)].astype(np.int64)
    if not len(flat):
        return (255, 255, 255), 0.0
    cells = (flat // (256 // steps)) @ np.array([steps * steps, steps, 1])
    counts = np.bincount(cells)
    best = int(counts.argmax())
    return tuple(int(x) for x in flat[cells == best].mean(axis=0)), float(counts[best] / len(flat))


SCHEMA = "doc_id string, page_number int, dimension_mismatch boolean, total_pixels long, source_zone_pixels long, annotation_zone_pixels long, changed_pixels long, changed_in_source_zone long, changed_in_annotation_zone long, changed_outside long, changed_outside_ratio double, verdict string"


def compare_pages(pages: DataFrame) -> DataFrame:
    """pages: doc_id string, page_number int, width int, height int, before and after binary RGB, source and notes array<array<int>>."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                image = lambda b, r=r: np.frombuffer(b, np.uint8).reshape(r.height, r.width, 3)
                rects = lambda x: [tuple(map(int, q)) for q in x]
                rows.append({"doc_id": r.doc_id, "page_number": r.page_number} | change_metrics(image(r.before), image(r.after), rects(r.source), rects(r.notes)))
            yield pd.DataFrame(rows)

    return pages.mapInPandas(run, SCHEMA)
