"""Boxes as structs (l, t, r, b) in page coordinates 0 to 1, and the scores built on them.

Every formula is a column expression, so it runs inside whole-stage code; the assignment of pairs uses the same formulas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and limits of pair scores.
MIN_SCORE, MAX_DISTANCE, CONTAINMENT = 0.42, 0.5, 0.5
PAIR_WEIGHTS = {"layout": 0.35, "distance": 0.30, "overlap": 0.20, "confidence": 0.15}


def box(l: Column, t: Column, r: Column, b: Column) -> Column:
    return F.struct(l.cast("double").alias("l"), t.cast("double").alias("t"), r.cast("double").alias("r"), b.cast("double").alias("b"))


def valid(x: Column) -> Column:
    return F.coalesce((x["l"] >= 0) & (x["t"] >= 0) & (x["r"] <= 1) & (x["b"] <= 1) & (x["l"] < x["r"]) & (x["t"] < x["b"]), F.lit(False))


def _size(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a)


def area(x: Column) -> Column:
    return _size(x["r"] - x["l"]) * _size(x["b"] - x["t"])


def intersection(x: Column, y: Column) -> Column:
    return _size(F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"])) * _size(F.least(x["b"], y["b"]) - F.greatest(x["t"], y["t"]))


def iou(x: Column, y: Column) -> Column:
    """Intersection over union; 0 for boxes without area."""
    inter = intersection(x, y)
    union = area(x) + area(y) - inter
    return F.coalesce(F.try_divide(inter, union), F.lit(0.0))


def containment(child: Column, parent: Column) -> Column:
    """Share of the child's area inside the parent."""
    return F.coalesce(F.try_divide(intersection(child, parent), area(child)), F.lit(0.0))


def over_smaller(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(intersection(x, y), F.least(area(x), area(y))), F.lit(0.0))


def axis_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals over the shorter."""
    return F.coalesce(F.try_divide(_size(F.least(a2, b2) - F.greatest(a1, b1)), F.least(a2 - a1, b2 - b1)), F.lit(0.0))


def center(x: Column) -> tuple[Column, Column]:
    return (x["l"] + x["r"]) / 2, (x["t"] + x["b"]) / 2


def confidence(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.5))))


def distance(x: Column, y: Column) -> Column:
    (ax, ay), (bx, by) = center(x), center(y)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def pair_score(s: Column, t: Column, s_conf: Column, t_conf: Column, label: Column, weights: dict | None = None, reach: float = MAX_DISTANCE) -> Column:
    """Source-target score. ``label`` is true for numbers and captions, which belong below what they name."""
    w = weights or PAIR_WEIGHTS
    (sx, sy), (tx, ty) = center(s), center(t)
    d = distance(s, t)
    near = _size(1 - d / reach)
    aligned = _size(1 - F.abs(sx - tx) / reach)
    below = F.when(sy >= ty, 1.0).otherwise(_size(1 + (sy - ty) / reach))
    layout = F.when(label, 0.6 * below + 0.4 * aligned).otherwise(0.5 * near + 0.5 * aligned)
    overlap = F.greatest(axis_overlap(s["l"], s["r"], t["l"], t["r"]), axis_overlap(s["t"], s["b"], t["t"], t["b"]))
    sure = (confidence(s_conf) + confidence(t_conf)) / 2
    total = sum(w.values())
    score = (layout * w["layout"] + near * w["distance"] + overlap * w["overlap"] + sure * w["confidence"]) / total if total > 0 else F.lit(0.0)
    return F.when(d > reach, 0.0).otherwise(score)


def number_score(n: Column, a: Column, n_conf: Column, a_conf: Column) -> Column:
    """A sequence label and the drawing above it, with hard gates on its side, its column and its distance from the foot."""
    (nx, ny), (ax, ay) = center(n), center(a)
    width, height = a["r"] - a["l"], a["b"] - a["t"]
    dx, dy = F.abs(nx - ax), F.abs(ny - a["b"])
    lx, ly = F.greatest(F.lit(0.055), width * 1.1), F.greatest(F.lit(0.055), height * 0.9)
    out = (ny < ay - F.greatest(F.lit(0.015), height * 0.15)) | (dx > lx) | (dy > ly)
    sure = (confidence(n_conf) + confidence(a_conf)) / 2
    return F.when(out, 0.0).otherwise(0.35 * _size(1 - dx / lx) + 0.35 * _size(1 - dy / ly) + 0.15 * axis_overlap(n["l"], n["r"], a["l"], a["r"]) + 0.15 * sure)


def caption_score(c: Column, x: Column, c_conf: Column, x_conf: Column) -> Column:
    """A caption and a region in its scope: above it (0.04 below at most) and within 0.12 of its width."""
    (cx, _), (rx, ry) = center(c), center(x)
    gap = F.greatest(c["l"] - rx, rx - c["r"], F.lit(0.0))
    aligned = _size(1 - F.abs(rx - cx) / (F.greatest(F.lit(0.08), c["r"] - c["l"]) * 0.9))
    above = _size(1 - _size(c["t"] - x["b"]) / 0.35)
    sure = (confidence(c_conf) + confidence(x_conf)) / 2
    return F.when((ry > c["b"] + 0.04) | (gap > 0.12), 0.0).otherwise(0.45 * _size(1 - gap / 0.12) + 0.30 * aligned + 0.15 * above + 0.10 * sure)


def caption_with_text(layout: Column, agrees: Column) -> Column:
    """Layout score and whether the texts agree (1, 0, null for unknown)."""
    return F.when((layout <= 0) | agrees.isNull(), layout).when(agrees == 0, layout * 0.2).otherwise(F.least(F.lit(1.0), 0.55 * agrees + 0.45 * layout))


def evidence_score(x: Column, y: Column) -> Column:
    """Evidence box and region: 0.6 nearness within 0.6, 0.4 intersection over the smaller."""
    return 0.6 * _size(1 - distance(x, y) / 0.6) + 0.4 * over_smaller(x, y)


def nearest_score(d: Column, page_gap: Column, above: Column, id_match: Column, window: int = 3) -> Column:
    return F.least(F.lit(1.0), 0.78 * _size(1 - d / 1.1) + 0.22 * _size(1 - page_gap / (window + 1)) + F.when(above, 0.12).otherwise(0.0) + F.when(id_match, 0.2).otherwise(0.0))


def crop(x: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """Pixels of a box on a page image: outward rounding, clamped."""
    px, py = (x["r"] - x["l"]) * padding, (x["b"] - x["t"]) * padding
    return F.struct(F.greatest(F.lit(0), F.floor((x["l"] - px) * width)).cast("int").alias("x0"), F.greatest(F.lit(0), F.floor((x["t"] - py) * height)).cast("int").alias("y0"), F.least(width, F.ceil((x["r"] + px) * width)).cast("int").alias("x1"), F.least(height, F.ceil((x["b"] + py) * height)).cast("int").alias("y1"))


def covers(block: Column, region: Column, kind: Column) -> Column:
    """Whether a text block belongs to a region: labels by their centre, others by coverage."""
    bx, by = center(block)
    inside = (bx >= region["l"]) & (bx <= region["r"]) & (by >= region["t"]) & (by <= region["b"])
    return F.when(kind.isin("number", "caption"), inside | (containment(block, region) >= 0.35)).otherwise(inside & (containment(block, region) >= 0.5))
