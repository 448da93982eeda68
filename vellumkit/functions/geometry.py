"""Boxes and polygons. Axis-aligned forms are column expressions; general polygons go through Arrow UDFs on NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from .text import let


def box_iou(a: Column, b: Column) -> Column:
    """IoU of two xyxy boxes; an overlap of one pixel or less along either axis counts as none (G1). Null if both are empty."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.when((w > 1) & (h > 1), w * h).otherwise(F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.try_divide(inter, union)


def box_giou(a: Column, b: Column) -> Column:
    """GIoU of two axis-aligned xyxy boxes over their convex hull; 0 where either has no area.

    The hull is the bounding box without the triangles at those of its corners whose two sides belong to different boxes.
    """
    zero = F.lit(0.0)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero)
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    inter = w * h
    union = area(a) + area(b) - inter
    d = [a[k] - b[k] for k in range(4)]
    cut = (F.greatest(-d[0] * d[1], zero) + F.greatest(-d[2] * d[3], zero) + F.greatest(d[2] * d[1], zero) + F.greatest(d[0] * d[3], zero)) / 2
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1])) - cut
    return F.when((area(a) > 0) & (area(b) > 0), inter / union - (hull - union) / hull).otherwise(zero)


def rescale_box(box: Column, w_from: Column, h_from: Column, w_to: Column, h_to: Column) -> Column:
    """xyxy of one image size in another."""
    return F.transform(box, lambda v, i: v / F.when(i % 2 == 0, w_from).otherwise(h_from) * F.when(i % 2 == 0, w_to).otherwise(h_to))


def resize_coords(coords: Column, ow: Column, oh: Column, rw: Column, rh: Column) -> Column:
    """Coordinates scaled and cut to whole numbers."""
    return F.transform(coords, lambda v, i: (v * F.when(i % 2 == 0, rw).otherwise(rh) / F.when(i % 2 == 0, ow).otherwise(oh)).cast("int"))


def xywh_to_xyxy(b: Column) -> Column:
    """COCO box; only the far corner is cut to whole numbers."""
    return F.array(b[0], b[1], (b[0] + b[2]).cast("int").cast("double"), (b[1] + b[3]).cast("int").cast("double"))


def polygon_area(p: Column) -> Column:
    """Shoelace area of x1, y1, x2, y2, ...."""

    def area(p: Column) -> Column:
        n = F.size(p)
        cross = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda k: p[(2 * k).cast("int")] * p[((2 * k + 3) % n).cast("int")] - p[((2 * k + 2) % n).cast("int")] * p[(2 * k + 1).cast("int")])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2

    return let(p, area)


def normalize_polygon(p: Column, clockwise: bool = True) -> Column:
    """Corners of a quadrilateral by angle around their mean (rising angle: clockwise in an image), from the topmost, then
    leftmost, one (G6). Each step is computed once a row."""
    mean = lambda pts, axis: (F.lit(0.0) + pts[0][axis] + pts[1][axis] + pts[2][axis] + pts[3][axis]) / 4

    def by_angle(pts: Column, c: Column) -> Column:
        angle = lambda q: F.atan2(q["y"] - c["y"], q["x"] - c["x"])
        return F.array_sort(F.transform(pts, lambda q, i: F.struct((angle(q) if clockwise else -angle(q)).alias("a"), i.alias("i"), q["x"].alias("x"), q["y"].alias("y"))))

    def turned(ring: Column) -> Column:
        first = F.array_min(F.transform(ring, lambda q, i: F.struct(q["y"].alias("y"), q["x"].alias("x"), i.alias("i"))))["i"]
        return let(first, lambda k: F.flatten(F.transform(F.concat(F.slice(ring, k + 1, 4), F.slice(ring, F.lit(1), k)), lambda q: F.array(q["x"], q["y"]))))

    points = lambda p: F.array(*[F.struct(p[2 * k].alias("x"), p[2 * k + 1].alias("y")) for k in range(4)])
    centred = lambda pts: let(F.struct(mean(pts, "x").alias("x"), mean(pts, "y").alias("y")), lambda c: let(by_angle(pts, c), turned))
    return let(p, lambda p: let(points(p), centred))


def smart_resize(h: Column, w: Column, factor: int = 28, min_pixels: int = 56 * 56, max_pixels: int = 14 * 14 * 4 * 1280) -> Column:
    """Struct (h, w): multiples of ``factor`` with an area between the limits, aspect about kept; rounds half to even."""
    f = float(factor)
    near = lambda v: F.greatest(F.lit(f), F.bround(v / f) * f)
    h0, w0 = near(h), near(w)
    down, up = F.sqrt(h * w / F.lit(float(max_pixels))), F.sqrt(F.lit(float(min_pixels)) / (h * w))
    over, under = h0 * w0 > max_pixels, h0 * w0 < min_pixels
    side = lambda v, v0: F.when(over, F.greatest(F.lit(f), F.floor(v / down / f) * f)).when(under, F.ceil(v * up / f) * f).otherwise(v0).cast("int")
    return F.struct(side(h, h0).alias("h"), side(w, w0).alias("w"))


def image_tokens(h: Column, w: Column, patch: int = 14, merge: int = 2) -> Column:
    """Tokens of an image of that resized size."""
    return (F.floor(h / patch) * F.floor(w / patch) / (merge * merge)).cast("int")


def rbox_to_qbox(b: Column) -> Column:
    """Corners of (cx, cy, w, h, angle in radians)."""
    c, s = F.cos(b[4]), F.sin(b[4])
    return F.flatten(F.array(*[F.array(b[0] + dx * b[2] / 2 * c - dy * b[3] / 2 * s, b[1] + dx * b[2] / 2 * s + dy * b[3] / 2 * c) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]))


def rle_rows(mask: Column) -> Column:
    """Run lengths of each row of a mask: "0*1,1*2;0*3;" (W7)."""

    def row(r: Column) -> Column:
        n = F.size(r)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(r, i) != F.get(r, i - 1)))
        runs = F.transform(starts, lambda s, k: F.concat_ws("*", F.get(r, s).cast("string"), (F.coalesce(F.get(starts, k + 1), n) - s).cast("string")))
        return F.concat(F.when(n > 0, F.array_join(runs, ",")).otherwise(F.lit("")), F.lit(";"))

    return F.array_join(F.transform(mask, row), "")


# --- general polygons, NumPy -------------------------------------------------------------------------------------


# A polygon has few corners: lists of floats take a fraction of the time of arrays.

Points = list[tuple[float, float]]


def _pairs(p: list[float]) -> Points:
    v = np.asarray(p, float).tolist()
    return list(zip(v[::2], v[1::2], strict=True))


def _corners(p: list[float]) -> Points:
    if len(p) == 4:
        (x1, y1), (x2, y2) = _pairs(p)
        return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    q = _pairs(p)
    cx, cy = (math.fsum(v) / len(q) for v in zip(*q))
    return sorted(q, key=lambda v: -math.atan2(v[1] - cy, v[0] - cx))


def _area(q: Points) -> float:
    forth = back = 0.0
    for (x, y), (u, v) in zip(q, q[1:] + q[:1]):
        forth += x * v
        back += y * u
    return 0.5 * (forth - back)


def _hull(q: Points) -> Points:
    """Convex hull, counter-clockwise."""
    pts = sorted(q)

    def half(points: Points) -> Points:
        out: Points = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1]) if len(set(pts)) > 2 else pts


def _clip(subject: Points, clip: Points) -> Points:
    """Part of a polygon inside a convex, counter-clockwise one."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        given, out = out, []
        sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in given]
        for p, q, sp, sq in zip(given[-1:] + given[:-1], given, sides[-1:] + sides[:-1], sides):
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if sq >= 0:
                out.append(q)
    return out


def _apart(p: Points, q: Points) -> bool:
    """The bounding boxes have no area in common."""
    (px, py), (qx, qy) = zip(*p), zip(*q)
    return min(px) >= max(qx) or min(qx) >= max(px) or min(py) >= max(qy) or min(qy) >= max(py)


def _overlap(a: list[float], b: list[float]) -> tuple[float, float, Points]:
    """(area of both, area of either, all corners) of two convex polygons; areas are 0 if one has none."""
    p, q = _corners(a), _corners(b)
    p, q = (x[::-1] if _area(x) < 0 else x for x in (p, q))
    ap, aq, every = _area(p), _area(q), p + q
    if not (ap > 0 and aq > 0):
        return 0.0, 0.0, every
    both = [] if _apart(p, q) else _clip(p, q)
    inter = abs(_area(both)) if len(both) > 2 else 0.0
    return inter, ap + aq - inter, every


def polygon_giou_np(a: list[float], b: list[float]) -> float:
    """GIoU of two convex polygons given as 4 or 2n numbers; 0 for one without area."""
    inter, union, every = _overlap(a, b)
    if not union:
        return 0.0
    hull = _area(_hull(every))
    return inter / union - (hull - union) / hull


def polygon_iou_np(a: list[float], b: list[float]) -> float:
    """IoU of two convex polygons given as 4 or 2n numbers; 0 for one without area."""
    inter, union, _ = _overlap(a, b)
    return inter / union if union else 0.0


@F.pandas_udf(DoubleType())
def polygon_giou(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else polygon_giou_np(x, y) for x, y in zip(a, b)], dtype="float64")


def min_area_rect_np(p: list[float]) -> list[int]:
    """Least-area rectangle around points, as whole (cx, cy, w, h, angle in degrees), w >= h, -90 <= angle < 90."""
    hull = _hull(_pairs(np.array(p).astype(int)))
    if len(hull) == 1:
        return [int(hull[0][0]), int(hull[0][1]), 0, 0, 0]
    best = None
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):
        t = math.atan2(by - ay, bx - ax)
        c, s = math.cos(t), math.sin(t)
        u, v = [x * c + y * s for x, y in hull], [y * c - x * s for x, y in hull]
        (u0, u1), (v0, v1) = (min(u), max(u)), (min(v), max(v))
        w, h = u1 - u0, v1 - v0
        if best is None or w * h < best[0] - 1e-9:
            mu, mv = (u1 + u0) / 2, (v1 + v0) / 2
            best = (w * h, c * mu - s * mv, s * mu + c * mv, w, h, math.degrees(t))
    _, x, y, w, h, angle = best
    if w < h - 1e-9:
        w, h, angle = h, w, angle + 90
    angle = (angle + 90) % 180 - 90
    return [int(round(v, 6)) for v in (x, y, w, h, angle)]


@F.pandas_udf(ArrayType(IntegerType()))
def min_area_rect(p: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else min_area_rect_np(x) for x in p])


def _bounds(q: np.ndarray, height: int, width: int) -> tuple[int, int, int, int]:
    """First row, first column, last row and last column that a polygon may touch within the image."""
    (x0, y0), (x1, y1) = (int(v) for v in np.maximum(np.floor(q.min(axis=0)), 0)), (int(v) for v in np.minimum(np.ceil(q.max(axis=0)), (width - 1, height - 1)))
    return y0, x0, y1, x1


def raster_np(polygons: list[list[float]], height: int, width: int, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Mask of polygons, outline included: pixels within half a pixel of the polygon's interior or edges (G9); only the rows and
    columns of a window (as of ``_bounds``) if it is given, which must hold all polygons."""
    top, left, bottom, right = window or (0, 0, height - 1, width - 1)
    out = np.zeros((bottom - top + 1, right - left + 1), np.uint8)
    for p in polygons:
        q = np.array(p, float).reshape(-1, 2)
        y0, x0, y1, x1 = _bounds(q, height, width)
        if x1 < x0 or y1 < y0:
            continue
        yy, xx = np.mgrid[y0 : y1 + 1, x0 : x1 + 1].astype(float)  # no other pixel is within half a pixel
        inside = np.zeros(yy.shape, bool)
        near = np.zeros(yy.shape, bool)
        for (ax, ay), (bx, by) in zip(q, np.roll(q, -1, axis=0)):
            crosses = (ay > yy) != (by > yy)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= crosses & (xx < (bx - ax) * (yy - ay) / (by - ay) + ax)
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(((xx - ax) * (bx - ax) + (yy - ay) * (by - ay)) / n, 0, 1) if n else np.zeros_like(xx)
            near |= np.maximum(abs(xx - ax - t * (bx - ax)), abs(yy - ay - t * (by - ay))) <= 0.5
        out[y0 - top : y1 + 1 - top, x0 - left : x1 + 1 - left] |= (inside | near).astype(np.uint8)
    return out


def mask_runs_np(mask: np.ndarray) -> list[int]:
    """Run lengths of a mask, column by column, zeros first (G13): the uncompressed form of COCO."""
    flat = np.asarray(mask, bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate(([0], edges, [flat.size]))).tolist()
    return [0, *runs] if flat.size and flat[0] else runs


def runs_mask_np(runs: list[int], height: int, width: int) -> np.ndarray:
    """The mask of run lengths."""
    values = np.arange(len(runs)) % 2
    return np.repeat(values, runs).astype(np.uint8).reshape((height, width), order="F")


def polygon_runs(polygons: Column, height: int, width: int) -> Column:
    """Struct (runs, area): polygons as run lengths and their pixels."""

    @F.pandas_udf("runs array<int>, area bigint")
    def runs(rows: pd.Series) -> pd.DataFrame:
        masks = [raster_np([] if p is None else list(p), height, width) for p in rows]
        return pd.DataFrame([(mask_runs_np(m), int(m.sum())) for m in masks], columns=["runs", "area"])

    return runs(polygons)


def box_pixels(box: Column, height: int, width: int) -> Column:
    """Pixels of an axis-aligned box with its outline, clipped to the image: the raster's closed form."""
    lo = lambda v, most: F.greatest(F.ceil(v - 0.5), F.lit(0))
    hi = lambda v, most: F.least(F.floor(v + 0.5), F.lit(most - 1))
    w = hi(box[2], width) - lo(box[0], width) + 1
    h = hi(box[3], height) - lo(box[1], height) + 1
    return (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("bigint")


def mask_counts(pred: Column, truth: Column, height: int = 256, width: int = 256) -> Column:
    """Struct (tn, fp, fn, tp) of two lists of polygons as masks (A12i)."""

    @F.pandas_udf("tn bigint, fp bigint, fn bigint, tp bigint")
    def counts(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(p, t):
            if all(m is None or len(m) == 0 for m in (a, b)):
                rows.append([height * width, 0, 0, 0])
                continue
            a, b = ([] if m is None else list(m) for m in (a, b))
            held = [w for w in (_bounds(np.array(q, float).reshape(-1, 2), height, width) for q in (*a, *b)) if w[0] <= w[2] and w[1] <= w[3]]
            window = (*map(min, zip(*[w[:2] for w in held])), *map(max, zip(*[w[2:] for w in held]))) if held else (0, 0, 0, 0)
            x, y = (raster_np(m, height, width, window) for m in (a, b))
            n, k, both = int(x.sum()), int(y.sum()), int((x & y).sum())
            rows.append([height * width - n - k + both, n - both, k - both, both])
        return pd.DataFrame(rows, columns=["tn", "fp", "fn", "tp"])

    return counts(pred, truth)


def close_mask_np(mask: np.ndarray, size: int = 50, out: int | None = None) -> np.ndarray:
    """Closing by a square of ``size``, then holes filled."""
    m = np.asarray(mask) > 0

    def spread(x: np.ndarray, k: int) -> np.ndarray:  # dilation by a square, from running sums
        for axis in (0, 1):
            c = np.cumsum(np.pad(x.astype(int), [(k, k) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
            c = np.concatenate((np.zeros_like(np.take(c, [0], axis=axis)), c), axis=axis)
            n = x.shape[axis]
            x = (np.take(c, np.arange(n) + 2 * k + 1, axis=axis) - np.take(c, np.arange(n), axis=axis)) > 0
        return x

    k = size // 2
    padded = np.pad(m, k)
    closed = ~spread(~spread(padded, k), k)
    closed = closed[k : closed.shape[0] - k, k : closed.shape[1] - k]
    outside = np.zeros(tuple(s + 2 for s in closed.shape), bool)
    free = np.pad(~closed, 1, constant_values=True)
    outside[0, :] = outside[-1, :] = outside[:, 0] = outside[:, -1] = True
    while True:  # flood from the border
        grown = outside.copy()
        grown[1:] |= outside[:-1]
        grown[:-1] |= outside[1:]
        grown[:, 1:] |= outside[:, :-1]
        grown[:, :-1] |= outside[:, 1:]
        grown &= free
        if (grown == outside).all():
            return (~outside[1:-1, 1:-1]).astype(np.uint8)
        outside = grown


def max_pool_np(mask: np.ndarray, cell: int = 28) -> np.ndarray:
    """Maximum of each cell; the last cells may be short."""
    h, w = mask.shape
    m = np.pad(mask, ((0, -h % cell), (0, -w % cell)))
    return m.reshape(m.shape[0] // cell, cell, m.shape[1] // cell, cell).max(axis=(1, 3))
