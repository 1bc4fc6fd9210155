"""Outlines of masks: boundary, hull, simplification and page detection. One image's detection grid is one task's work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pixelloom.session import ship

DIRECTIONS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
LEAST_SHARE, COMPONENT_SHARE, FRAME_SHARE = 1 / 25, 1 / 20, 0.85


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the least point, without those on straight sides."""
    pts = sorted(set(map(tuple, np.asarray(points).tolist())))
    if len(pts) < 3:
        return np.array(pts, dtype=float).reshape(-1, 2)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for ordered in (pts, pts[::-1]):
        half: list = []
        for p in ordered:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return np.array(halves[0] + halves[1], dtype=float)


def _far(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    length = np.hypot(*d)
    off = points - a
    return np.hypot(*off.T) if length < 1e-9 else np.abs(off[:, 0] * d[1] - off[:, 1] * d[0]) / length


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """An open chain without points that are within ``tolerance`` of what stays."""
    points = np.asarray(points, dtype=float)
    keep, work = np.zeros(len(points), dtype=bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while work:
        i, j = work.pop()
        if j - i < 2:
            continue
        d = _far(points[i + 1 : j], points[i], points[j])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[i + 1 + k] = True
            work += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def simplify_closed(loop: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed loop, split where it is farthest from its first point."""
    loop = np.asarray(loop, dtype=float)
    if len(loop) < 4:
        return loop
    k = int(np.hypot(*(loop - loop[0]).T).argmax())
    if k == 0:
        return loop[:1]
    return np.concatenate([simplify(loop[: k + 1], tolerance)[:-1], simplify(np.concatenate([loop[k:], loop[:1]]), tolerance)[:-1]])


def trace_boundary(mask: np.ndarray) -> np.ndarray:
    """The outer boundary of the component of the first set pixel, as (x, y) in walking order, by eight neighbours."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.empty((0, 2))
    h, w = mask.shape
    start = (int(xs[0]), int(ys[0]))
    at, heading, out = start, 0, [start]
    for _ in range(4 * mask.size):
        for turn in range(8):
            d = (heading + 6 + turn) % 8
            x, y = at[0] + DIRECTIONS[d][0], at[1] + DIRECTIONS[d][1]
            if 0 <= x < w and 0 <= y < h and mask[y, x]:
                at, heading = (x, y), d
                break
        else:
            break
        if at == start:
            break
        out.append(at)
    return np.array(out, dtype=float)


def polygon_area(p: np.ndarray) -> float:
    x, y = np.asarray(p, dtype=float).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest component by four neighbours, the first of equals: labels move along rows and columns until they rest."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        before = labels
        for axis in (0, 1):
            for flip in (False, True):
                a = np.flip(labels, axis) if flip else labels
                a = np.where(a == 0, big, a)
                rest = np.moveaxis(a, axis, 0).copy()
                for i in range(1, len(rest)):
                    joined = (rest[i] < big) & (rest[i - 1] < big)
                    rest[i] = np.where(joined, np.minimum(rest[i], rest[i - 1]), rest[i])
                a = np.moveaxis(rest, 0, axis)
                a = np.where(a == big, 0, a)
                labels = np.flip(a, axis) if flip else a
        if (labels == before).all():
            break
    counts = np.bincount(labels.ravel(), minlength=2)
    counts[0] = 0
    return labels == int(counts.argmax()) if counts.max() else np.zeros_like(mask, dtype=bool)


def otsu_threshold(values: np.ndarray) -> int:
    counts = np.bincount(values.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, 0.0)
    return int(between.argmax())


def _extreme(mask: np.ndarray, radius: int, dilate: bool) -> np.ndarray:
    for axis in (0, 1):
        moved = np.moveaxis(mask, axis, 0)
        out = moved.copy()
        for k in range(1, radius + 1):
            if dilate:
                out[k:] |= moved[:-k]
                out[:-k] |= moved[k:]
            else:
                out[k:] &= moved[:-k]
                out[:-k] &= moved[k:]
        mask = np.moveaxis(out, 0, axis)
    return mask


def fit_quad(hull: np.ndarray) -> np.ndarray:
    """Four corners of a hull: corners that cost the least area go first."""
    pts = [tuple(p) for p in hull]
    while len(pts) > 4:
        cost = [polygon_area(np.array([pts[i - 1], pts[i], pts[(i + 1) % len(pts)]])) for i in range(len(pts))]
        pts.pop(int(np.argmin(cost)))
    return np.array(pts)


def order_corners(p: np.ndarray) -> np.ndarray:
    s, d = p.sum(axis=1), p[:, 1] - p[:, 0]
    return np.array([p[s.argmin()], p[d.argmin()], p[s.argmax()], p[d.argmax()]])


def detect_page(grey: np.ndarray) -> tuple[str, np.ndarray]:
    """(shape, corners) of the bright page in a grey raster: none, frame, Triangle, Quad, Fold or Curve."""
    h, w = grey.shape
    frame = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], dtype=float)
    lo, hi = np.sort(grey.ravel())[[int(0.02 * (grey.size - 1)), int(0.98 * (grey.size - 1))]]
    if hi - lo < 0.04:
        return ("frame", frame) if grey.mean() >= 0.5 else ("none", np.empty((0, 2)))
    bytes_ = np.clip((grey - lo) / (hi - lo) * 255, 0, 255).astype(np.uint8)
    mask = bytes_ > otsu_threshold(bytes_)
    share = mask.mean()
    if share < LEAST_SHARE:
        return "none", np.empty((0, 2))
    if share > FRAME_SHARE and mask[0].any() and mask[-1].any() and mask[:, 0].any() and mask[:, -1].any():
        return "frame", frame
    radius = max(2, min(h, w) // 80)
    mask = largest_component(_extreme(_extreme(mask, radius, True), radius, False))
    if mask.mean() < COMPONENT_SHARE:
        return "none", np.empty((0, 2))
    boundary = trace_boundary(mask)
    outline = simplify_closed(boundary, max(2.5, 0.02 * max(h, w)))
    hull = convex_hull(boundary)
    quad = order_corners(fit_quad(hull)) if len(hull) >= 4 else hull
    if len(outline) == 3:
        return "Triangle", outline
    filled = mask.sum() / max(1.0, polygon_area(quad))
    if len(quad) == 4 and filled >= 0.9:
        return "Quad", quad
    if polygon_area(hull) > 1.03 * polygon_area(outline) and len(outline) <= 6:
        return "Fold", outline
    return ("Curve", outline) if len(outline) > 4 else ("Quad", quad)


def _grid(rows: pd.DataFrame, value: str) -> np.ndarray:
    out = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1))
    out[rows["y"], rows["x"]] = rows[value]
    return out


def page_outlines(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, shape, x, y) of the page of each image; df is a detection grid, a few hundred cells each way."""
    kind = df.schema[by].dataType.simpleString()
    ship(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shape, points = detect_page(_grid(rows, value))
        return pd.DataFrame({by: [rows[by].iloc[0]], "shape": [shape], "px": [points[:, 0].tolist()], "py": [points[:, 1].tolist()]})

    return df.select(by, "y", "x", value).groupBy(by).applyInPandas(run, f"{by} {kind}, shape string, px array<double>, py array<double>")


def hulls(points: DataFrame, by: str) -> DataFrame:
    """(by, px, py): the convex hull of each group's points (x, y)."""
    kind = points.schema[by].dataType.simpleString()
    ship(points.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(rows[["x", "y"]].to_numpy())
        return pd.DataFrame({by: [rows[by].iloc[0]], "px": [hull[:, 0].tolist()], "py": [hull[:, 1].tolist()]})

    return points.select(by, "x", "y").groupBy(by).applyInPandas(run, f"{by} {kind}, px array<double>, py array<double>")


def simplified(chains: DataFrame, by: str, tolerance: float) -> DataFrame:
    """Open chains (by, px, py) without points within ``tolerance``; batch by batch."""
    ship(chains.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [simplify(np.stack([x, y], axis=1), tolerance) for x, y in zip(batch["px"], batch["py"])]
            yield pd.DataFrame({by: batch[by], "px": [k[:, 0].tolist() for k in kept], "py": [k[:, 1].tolist() for k in kept]})

    return chains.select(by, "px", "py").mapInPandas(run, f"{by} {chains.schema[by].dataType.simpleString()}, px array<double>, py array<double>")
