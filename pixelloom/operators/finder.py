"""Page quads by line voting: edge maps, lines of both families, quads of two pairs, scores of their sides, the best of them.

An image is first brought to a detection grid of a bounded long edge by partial aggregation, so the grouped NumPy search
holds one bounded grid whatever the size of the image. One shuffle a pass; one for both if the image is its own grid.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.operators.windows import GAUSS7
from pixelloom.session import cut, ship

# Long edges of both passes, least side, limits of the magnitude's cutoff, its fractions and peak.
COARSE, FINE, LEAST_SIDE = 480, 640, 16
CUTOFF_LOW, CUTOFF_HIGH, CUTOFF_FRACTION, PEAK_FRACTION, PEAK_HIGH = 8 / 255, 30 / 255, 0.90, 0.995, 0.80
# Fixed values of lines: half window of text, votes, support, gap and merging as shares of the long edge, reach, inliers.
TEXT_HALF, VOTE_SHARE, SUPPORT_SHARE, GAP_SHARE, MERGE_SHARE, REACH, INLIERS, MOST_LINES = 8, 0.025, 0.08, 0.04, 0.02, 1.4, 12, 12
# Fixed values of scores: probe distances, steps in luminance and chroma, ink and shadow against the centre, weights.
PROBES = (3.0, 6.0, 10.0, 14.0, 20.0, 28.0)
STEP_LUMA, STEP_CHROMA, INK, SHADOW, LEAST_SAMPLES = 0.012, 0.04, 0.18, 0.30, 8
W_POLARITY, W_AREA, W_ANGLE, W_EXTEND = 1.5, 0.3, 0.01, 0.8
# Fixed values of refinement: margin of the crop, its least side and largest share of the frame, largest shift.
MARGIN, LEAST_CROP, LARGEST_CROP, LARGEST_SHIFT = 0.15, 32, 0.9, 0.04

HORIZONTAL, VERTICAL = [range(45, 136)], [range(0, 46), range(135, 180)]
_CHUNK, _FEW = 256, 16
# Pixels a task of images that are their own grids; images whose sizes or crops may be broadcast.
_TASK_PIXELS, _FEW_IMAGES = 2_000_000, 10_000


@dataclass
class Maps:
    planes: np.ndarray  # luminance, chroma sources r, g, b and magnitude, (h, w, 5)
    horizontal: np.ndarray
    vertical: np.ndarray
    reference: float


def _ranked(values: np.ndarray, fraction: float) -> float:
    i = int(fraction * (values.size - 1))
    return float(np.partition(values, i, axis=None).ravel()[i])


def _blurred(grid: np.ndarray) -> np.ndarray:
    for axis in (1, 0):
        wide = np.pad(grid, [(3, 3) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = grid.shape[axis]
        grid = sum(w * np.take(wide, range(k, k + n), axis=axis) for k, w in enumerate(GAUSS7))
    return grid


def _busy(grid: np.ndarray, half: int) -> np.ndarray:
    """Means of rows and columns -half .. half - 1, fewer at borders."""
    for axis in (0, 1):
        n = grid.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(grid, [0], axis=axis)), np.cumsum(grid, axis=axis)], axis=axis)
        lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half, n)
        span = (hi - lo).reshape([-1 if a == axis else 1 for a in (0, 1)])
        grid = (np.take(total, hi, axis=axis) - np.take(total, lo, axis=axis)) / span
    return grid


def edge_maps(rgb: np.ndarray) -> Maps:
    """Sobel maps of the blurred luminance; each pixel belongs to one family at most, print to none."""
    tone = rgb @ np.array(C.LUMA_709)
    soft = _blurred(tone)
    gx, gy = np.zeros_like(soft), np.zeros_like(soft)
    across, down = soft[:, 2:] - soft[:, :-2], soft[2:] - soft[:-2]
    gx[1:-1, 1:-1] = across[:-2] + 2.0 * across[1:-1] + across[2:]
    gy[1:-1, 1:-1] = down[:, :-2] + 2.0 * down[:, 1:-1] + down[:, 2:]
    magnitude, ax, ay = np.hypot(gx, gy), np.abs(gx), np.abs(gy)
    cutoff = min(max(_ranked(magnitude, CUTOFF_FRACTION), CUTOFF_LOW), CUTOFF_HIGH)
    reference = max(4.0 * cutoff, min(_ranked(magnitude, PEAK_FRACTION), PEAK_HIGH))
    text = (_busy(ax, TEXT_HALF) > cutoff) & (_busy(ay, TEXT_HALF) > cutoff)
    return Maps(np.dstack([tone, rgb, magnitude]), ~text & (ay > ax) & (ay > cutoff), ~text & (ax >= ay) & (ax > cutoff), reference)


def longest_support(steps: np.ndarray, gap: int) -> int:
    """Hits of the longest run of sorted steps that misses at most ``gap`` in a row."""
    if not len(steps):
        return 0
    ends = np.flatnonzero(steps[1:] - steps[:-1] - 1 > gap)
    if not len(ends):
        return len(steps)
    return int(max(ends[0] + 1, len(steps) - 1 - ends[-1], (ends[1:] - ends[:-1]).max(initial=0)))


def _inliers(xs: np.ndarray, ys: np.ndarray, c: float, s: float, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one edge pixel for each step along a line, and the steps."""
    near = np.flatnonzero(np.abs(xs * c + ys * s - rho) <= REACH)
    step, other, k, m = (xs[near], ys[near], c, s) if abs(s) >= abs(c) else (ys[near], xs[near], s, c)
    off = other - np.floor((rho - step * k) / m)
    close = np.abs(off) <= 1
    near, step, off = near[close], step[close], off[close]
    order = np.lexsort((off, step))
    step = step[order]
    first = np.ones(len(step), dtype=bool)
    first[1:] = step[1:] != step[:-1]
    return near[order[first]], step[first]


def family(mask: np.ndarray, thetas: range) -> list[tuple[int, int, int, float]]:
    """Lines of edge pixels as (-support, -votes, theta in degrees, rho), longest first, at most ``MOST_LINES``."""
    ys, xs = np.nonzero(mask)
    long_edge = max(mask.shape)
    radians = np.radians(np.array(thetas))
    cos, sin = np.cos(radians), np.sin(radians)
    edge = int(np.ceil(np.hypot(*mask.shape))) + 4
    cells = np.floor(np.outer(cos, xs) + np.outer(sin, ys) + 0.5).astype(np.int64) + edge
    votes = np.stack([np.bincount(row, minlength=2 * edge) for row in cells])
    around = np.pad(votes, ((1, 1), (2, 2)))
    most = np.max([around[1 + a : 1 + a + votes.shape[0], 2 + b : 2 + b + votes.shape[1]] for a in (-1, 0, 1) for b in (-2, -1, 0, 1, 2)], axis=0)
    at, r = np.nonzero((votes == most) & (votes >= max(8, round(VOTE_SHARE * long_edge))))
    found: list[tuple[int, int, int, float]] = []
    all_theta, all_rho, merged = np.array(thetas)[at], (r - edge).astype(float), np.zeros(len(at), dtype=bool)
    for i in np.lexsort((r, at, -votes[at, r])):
        if merged[i]:
            continue
        theta, rho, c, s = thetas[at[i]], float(r[i] - edge), cos[at[i]], sin[at[i]]
        inliers, steps = _inliers(xs, ys, c, s, rho)
        support = longest_support(steps, max(4, round(GAP_SHARE * long_edge)))
        if support < max(8, round(SUPPORT_SHARE * long_edge)):
            continue
        if len(inliers) >= INLIERS:
            rho = float(c * xs[inliers].mean() + s * ys[inliers].mean())
        found.append((-support, -int(votes[at[i], r[i]]), theta, rho))
        merged |= (np.abs(all_theta - theta) <= 5) & (np.abs(all_rho - rho) <= max(6.0, MERGE_SHARE * long_edge))
    return sorted(found)[:MOST_LINES]


def _ordered(q: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2) as top left, top right, bottom right, bottom left; the first of equals."""
    total, lean = q.sum(axis=2), q[:, :, 1] - q[:, :, 0]
    pick = np.stack([total.argmin(1), lean.argmin(1), total.argmax(1), lean.argmax(1)], axis=1)
    return np.take_along_axis(q, pick[:, :, None], axis=1)


def _areas(q: np.ndarray) -> np.ndarray:
    n = np.roll(q, -1, axis=1)
    return np.abs((q[..., 0] * n[..., 1] - n[..., 0] * q[..., 1]).sum(axis=1)) / 2.0


def geometry(q: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Which quads are plausible pages, and how far their angles are from right ones in all."""
    apart = np.min([np.hypot(*(q[:, i] - q[:, j]).T) for i, j in combinations(range(4), 2)], axis=0) >= 4.0
    after, before = np.roll(q, -1, axis=1) - q, np.roll(q, 1, axis=1) - q
    beyond = np.roll(after, -1, axis=1)
    turns = after[..., 0] * beyond[..., 1] - after[..., 1] * beyond[..., 0]
    convex = (turns.min(axis=1) >= 1.0) | (turns.max(axis=1) <= -1.0)
    lengths = np.maximum(np.hypot(after[..., 0], after[..., 1]) * np.hypot(before[..., 0], before[..., 1]), 1e-6)
    angles = np.degrees(np.arccos(np.clip((after * before).sum(axis=2) / lengths, -1.0, 1.0)))
    frame = np.array([width, height])
    within = ((q >= -0.10 * frame) & (q <= 1.10 * frame)).all(axis=(1, 2))
    good = apart & convex & within & (_areas(q) >= 0.08 * width * height) & ((angles >= 60.0) & (angles <= 120.0)).all(axis=1)
    return good, np.abs(angles - 90.0).sum(axis=1)


def candidates(maps: Maps) -> np.ndarray:
    """Quads of two lines of each family, (n, 4, 2), at most 66 x 66."""
    across = sorted(line for thetas in HORIZONTAL for line in family(maps.horizontal, thetas))[:MOST_LINES]
    along = sorted(line for thetas in VERTICAL for line in family(maps.vertical, thetas))[:MOST_LINES]
    if len(across) < 2 or len(along) < 2:
        return np.empty((0, 4, 2))
    h, v = (np.array([(np.cos(np.radians(t)), np.sin(np.radians(t)), r) for _, _, t, r in lines]) for lines in (across, along))
    height, width = maps.horizontal.shape
    return quads_of(h, v, width, height)[0]


def quads_of(h: np.ndarray, v: np.ndarray, width: float, height: float) -> tuple[np.ndarray, np.ndarray]:
    """Ordered quads (n, 4, 2) of any two lines (cos, sin, rho) of each family that all meet within a tenth of the frame
    around it, and their lines (n, 4): two of h, two of v."""
    det = np.outer(h[:, 0], v[:, 1]) - np.outer(h[:, 1], v[:, 0])
    some = np.where(np.abs(det) >= 0.34, det, np.nan)
    met = np.stack([(np.outer(h[:, 2], v[:, 1]) - np.outer(h[:, 1], v[:, 2])) / some, (np.outer(h[:, 0], v[:, 2]) - np.outer(h[:, 2], v[:, 0])) / some], axis=2)
    (h0, h1), (v0, v1) = (np.array(list(combinations(range(len(x)), 2)), dtype=np.int64).reshape(-1, 2).T for x in (h, v))
    h0, h1, v0, v1 = np.repeat(h0, len(v0)), np.repeat(h1, len(v0)), np.tile(v0, len(h0)), np.tile(v1, len(h0))
    frame = np.array([width, height])
    near = ((met >= -0.10 * frame) & (met <= 1.10 * frame)).all(axis=2)
    whole = np.flatnonzero(near[h0, v0] & near[h0, v1] & near[h1, v0] & near[h1, v1])
    h0, h1, v0, v1 = h0[whole], h1[whole], v0[whole], v1[whole]
    return _ordered(np.stack([met[h0, v0], met[h0, v1], met[h1, v0], met[h1, v1]], axis=1)), np.stack([h0, h1, v0, v1], axis=1)


def sample(planes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values of all planes at (..., 2) points, 0 outside, and what is inside."""
    h, w = planes.shape[:2]
    inside = (at[..., 0] >= 0) & (at[..., 1] >= 0) & (at[..., 0] <= w - 1) & (at[..., 1] <= h - 1)
    x, y = np.where(inside, at[..., 0], 0.0), np.where(inside, at[..., 1], 0.0)
    x0, y0 = x.astype(np.int64), y.astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = (x - x0)[..., None], (y - y0)[..., None]
    flat, y0, y1 = planes.reshape(h * w, -1), y0 * w, y1 * w
    top = flat.take(y0 + x0, axis=0) * (1.0 - tx) + flat.take(y0 + x1, axis=0) * tx
    bottom = flat.take(y1 + x0, axis=0) * (1.0 - tx) + flat.take(y1 + x1, axis=0) * tx
    return (top * (1.0 - ty) + bottom * ty) * inside[..., None], inside


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def _upper_median(values: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Of the values taken in each row, the one at half their number; 0 if there are none."""
    n = taken.sum(axis=1)
    ranked = np.sort(np.where(taken, values, np.inf), axis=1)
    return np.where(n > 0, np.take_along_axis(ranked, np.minimum(n // 2, ranked.shape[1] - 1)[:, None], axis=1)[:, 0], 0.0)


def scores(maps: Maps, quads: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The score of each ordered quad (n, 4, 2); -inf where its sides aren't borders of a page.

    Every side that can be measured must differ from what is beyond it at every distance, and at least one must be
    brighter inside or of another colour."""
    h, w = maps.planes.shape[:2]
    u, v = (g.reshape(1, 25, 1) for g in np.meshgrid(0.3 + 0.1 * np.arange(5), 0.3 + 0.1 * np.arange(5)))
    c = quads[:, :, None, :]
    inner, held = sample(maps.planes[:, :, :1], (1 - u) * ((1 - v) * c[:, 0] + v * c[:, 3]) + u * ((1 - v) * c[:, 1] + v * c[:, 2]))
    known = held.sum(axis=1) >= LEAST_SAMPLES
    centre = np.where(known, _upper_median(inner[..., 0], held), 0.0)[:, None]
    known = known[:, None]

    side = np.roll(quads, -1, axis=1) - quads
    length = np.hypot(side[..., 0], side[..., 1])
    unit = side / np.maximum(length, 1e-9)[..., None]
    normal = np.stack([unit[..., 1], -unit[..., 0]], axis=-1)
    outward = ((quads + side / 2.0 - quads.mean(axis=1, keepdims=True)) * normal).sum(axis=-1) >= 0
    normal = np.where(outward[..., None], normal, -normal)

    t = 0.15 + 0.70 * (np.arange(16) + 0.5) / 16.0
    edge = quads[:, :, None] + side[:, :, None] * t[None, None, :, None]
    on, inside = sample(maps.planes[:, :, 4:], edge)
    support = _mean(on[..., 0].sum(axis=2), inside.sum(axis=2)) / maps.reference

    past = (0.05 + 0.045 * np.arange(1, 11))[None, None, :, None] * length[:, :, None, None] * unit[:, :, None]
    on, inside = sample(maps.planes[:, :, 4:], np.concatenate([quads[:, :, None] - past, (quads + side)[:, :, None] + past], axis=2))
    extend = _mean(on[..., 0].sum(axis=2), inside.sum(axis=2)) / maps.reference

    reach = np.array(PROBES)[:, None] * np.array([-1.0, 1.0])
    seen, inside = sample(maps.planes[:, :, :4], edge[:, :, None, None] + reach[None, None, :, :, None, None] * normal[:, :, None, None, None])
    tone, r, g, b = (seen[..., i] for i in range(4))
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    chroma = np.where(high > 1e-4, (high - low) / np.maximum(high, 1e-4), 0.0)
    n = inside.sum(axis=-1)  # quad, side, probe, inward or outward
    luma, colour = _mean(tone.sum(axis=-1), n), _mean((chroma * inside).sum(axis=-1), n)
    valid = (n >= LEAST_SAMPLES).all(axis=-1)
    brighter, other = luma[..., 0] - luma[..., 1], np.abs(colour[..., 0] - colour[..., 1])
    step = valid & ((np.abs(brighter) > STEP_LUMA) | (other > STEP_CHROMA))
    ink = known[..., None] & (np.abs(luma[..., 0] - centre[..., None]) > INK)
    flat = valid & ~step & ~ink

    close = inside[:, :, :2, 0]
    like = close & (~known[..., None, None] | (np.abs(tone[:, :, :2, 0] - centre[..., None, None]) <= INK))
    sums = lambda taken: ((tone[:, :, :2, 0] * taken).sum(axis=(2, 3)), taken.sum(axis=(2, 3)))
    (near, n_near), (raw, n_raw) = sums(like), sums(close)
    just_inside = np.where(n_near >= LEAST_SAMPLES, _mean(near, n_near), np.where(n_raw > 0, _mean(raw, n_raw), centre))
    page = ~known | (np.abs(just_inside - centre) < SHADOW)

    measured = valid.any(axis=2)
    agreed = measured & page & step.any(axis=2) & ~flat.any(axis=2)
    lit = agreed & ((valid & (brighter > STEP_LUMA)) | (valid & (other > STEP_CHROMA))).any(axis=2)
    best = np.where(step, np.maximum(brighter, 0.0) + other, 0.0).max(axis=2)
    passed = (length.min(axis=1) >= 8.0) & (measured.sum(axis=1) >= 3) & (agreed == measured).all(axis=1) & lit.any(axis=1)
    total = support.mean(axis=1) + W_POLARITY * _upper_median(best, agreed) + W_AREA * np.log(np.maximum(_areas(quads), 1.0) / (w * h))
    return np.where(passed, total - W_ANGLE * angles - W_EXTEND * extend.mean(axis=1), -np.inf)


def _scored(maps: Maps, quads: np.ndarray) -> np.ndarray:
    h, w = maps.planes.shape[:2]
    good, angles = geometry(quads, w, h)
    out = np.full(len(quads), -np.inf)
    at = np.flatnonzero(good)
    for i in range(0, len(at), _CHUNK):
        part = at[i : i + _CHUNK]
        out[part] = scores(maps, quads[part], angles[part])
    return out


def _bounds(maps: Maps, quads: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """No less than the score of each quad: its own magnitudes on and past the sides, each side computed once, with the
    largest step that the grid's luminance and chroma allow."""
    h, w = maps.planes.shape[:2]
    low, high = maps.planes[:, :, 1:4].min(axis=2), maps.planes[:, :, 1:4].max(axis=2)
    tone, chroma = maps.planes[:, :, 0], np.where(high > 0, (high - low) / np.where(high > 0, high, 1.0), 0.0)
    step = tone.max() - tone.min() + chroma.max()
    corners, at = np.unique(quads[..., 0] + 1j * quads[..., 1], return_inverse=True)
    at = at.reshape(-1, 4)
    ends, of = np.unique(at * len(corners) + np.roll(at, -1, axis=1), return_inverse=True)
    start, end = (np.stack([c.real, c.imag], axis=1)[:, None] for c in (corners[ends // len(corners)], corners[ends % len(corners)]))
    side = end - start
    on, past = 0.15 + 0.70 * (np.arange(16) + 0.5) / 16.0, 0.05 + 0.045 * np.arange(1, 11)
    mean = lambda t: (lambda seen, inside: _mean(seen[..., 0].sum(axis=1), inside.sum(axis=1)))(*sample(maps.planes[:, :, 4:], start + side * t[None, :, None]))
    value = (mean(on) - W_EXTEND * mean(np.concatenate([-past, 1.0 + past]))) / maps.reference
    total = value[of.reshape(-1, 4)].mean(axis=1) + W_POLARITY * step + W_AREA * np.log(np.maximum(_areas(quads), 1.0) / (w * h)) - W_ANGLE * angles
    return total + 1e-6


def _best(maps: Maps, quads: np.ndarray) -> tuple[float, int] | None:
    """The highest score and the first quad that has it: quads are scored by falling bounds until no other can have more."""
    h, w = maps.planes.shape[:2]
    good, angles = geometry(quads, w, h)
    at = np.flatnonzero(good)
    if not len(at):
        return None
    # Steps are bounded by the grid's own range for values that aren't negative.
    usual = np.isfinite(maps.planes).all() and maps.planes[:, :, 1:4].min() >= 0
    bounds = _bounds(maps, quads[at], angles[at]) if usual else np.full(len(at), np.inf)
    order = np.argsort(-bounds, kind="stable")
    best, first = -np.inf, -1
    for i in range(0, len(at), _FEW):
        part = order[i : i + _FEW]
        if bounds[part[0]] < best:
            break
        found = scores(maps, quads[at[part]], angles[at[part]])
        if np.isnan(found).any():
            return None
        top = found.max()
        index = int(at[part][found == top].min())
        if top > best or (top == best and index < first):
            best, first = float(top), index
    return (best, first) if np.isfinite(best) else None


def search(rgb: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The best quad of a detection grid (h, w, 3) with its score; the first of equals; None if there is none."""
    maps = edge_maps(rgb)
    quads = candidates(maps)
    found = _best(maps, quads)
    return found and (found[0], quads[found[1]])


_RESULT = "score double, px array<double>, py array<double>"


def _grid(rows: pd.DataFrame) -> np.ndarray:
    grid = np.zeros((int(rows["gh"].iloc[0]), int(rows["gw"].iloc[0]), 3))
    grid[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows[["r", "g", "b"]].to_numpy()
    return grid


def _nothing(rows: pd.DataFrame, by: str) -> pd.DataFrame:
    kinds = {by: rows[by].dtype, "score": float, "px": object, "py": object}
    return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in kinds.items()})


def detection_grid(df: DataFrame, by: str, long_edge: int) -> DataFrame:
    """(by, y, x, r, g, b, gh, gw, w, h): means of the pixels of each cell; df has the image's width and height as w and h.

    Images with a side below 16 pixels have no grid."""
    longest = F.greatest("w", "h")
    scale = longest / F.greatest(F.lit(LEAST_SIDE), F.least(F.lit(long_edge), longest))
    cells = lambda n: F.greatest(F.lit(LEAST_SIDE), F.floor(F.col(n) / scale + 0.5)).cast("long")
    sized = df.where((F.col("w") >= LEAST_SIDE) & (F.col("h") >= LEAST_SIDE)).withColumns({"gw": cells("w"), "gh": cells("h")})
    cell = lambda at, n, m: F.floor(((F.col(at) + 1) * F.col(m) - 1) / F.col(n))
    return sized.groupBy(by, "w", "h", "gw", "gh", cell("y", "h", "gh").alias("y"), cell("x", "w", "gw").alias("x")).agg(*(F.avg(v).alias(v) for v in "rgb"))


def _searched(df: DataFrame, by: str, long_edge: int) -> DataFrame:
    """(by, score, px, py) of images with a quad, in pixels of df."""
    kind = df.schema[by].dataType.simpleString()
    ship(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        found = search(_grid(rows))
        if found is None:
            return _nothing(rows, by)
        score, q = found
        return pd.DataFrame({by: [first[by]], "score": [score], "px": [(q[:, 0] * first["w"] / first["gw"]).tolist()], "py": [(q[:, 1] * first["h"] / first["gh"]).tolist()]}).astype({by: rows[by].dtype})

    return detection_grid(df, by, long_edge).groupBy(by).applyInPandas(run, f"{by} {kind}, {_RESULT}")


def image_sizes(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _crop(w: Column, h: Column) -> dict[str, Column]:
    """The quad's box with a margin, within the frame."""
    lo, hi = {}, {}
    for p, n in (("px", w), ("py", h)):
        least, most = F.array_min(p), F.array_max(p)
        pad = MARGIN * (most - least)
        lo[p] = F.greatest(F.lit(0), F.least(n - 1, F.floor(least - pad)))
        hi[p] = F.least(n, F.greatest(lo[p] + 1, F.ceil(most + pad)))
    return {"x0": lo["px"], "y0": lo["py"], "cw": hi["px"] - lo["px"], "ch": hi["py"] - lo["py"]}


def _crop_of(px: np.ndarray, py: np.ndarray, w: int, h: int) -> tuple[int, int, int, int] | None:
    """``_crop`` as (x0, y0, cw, ch); None if it is too small or almost the whole frame."""
    lo, size = [], []
    for p, n in ((px, w), (py, h)):
        pad = MARGIN * (p.max() - p.min())
        lo.append(int(max(0, min(n - 1, np.floor(p.min() - pad)))))
        size.append(int(min(n, max(lo[-1] + 1, np.ceil(p.max() + pad)))) - lo[-1])
    return (*lo, *size) if min(size) >= LEAST_CROP and size[0] * size[1] <= LARGEST_CROP * w * h else None


def own_grid(y: np.ndarray, x: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """The detection grid of an image whose cells are its pixels: means of the values of each, without those that are missing."""
    grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3))
    n = np.zeros(grid.shape[:2], dtype=np.int64)
    np.add.at(n, (y, x), 1)
    if n.max() <= 1:
        grid[y, x] = rgb
        return grid
    held = np.zeros(grid.shape, dtype=np.int64)
    np.add.at(held, (y, x), ~np.isnan(rgb))
    np.add.at(grid, (y, x), np.nan_to_num(rgb, nan=0.0, posinf=np.inf, neginf=-np.inf))
    return np.where(held > 0, grid / np.maximum(held, 1), np.where(n[..., None] > 0, np.nan, 0.0))


def search_twice(grid: np.ndarray) -> tuple[float, np.ndarray, bool] | None:
    """The best quad of an image that is its own detection grid in both passes, its score, and whether it is the finer pass's."""
    h, w = grid.shape[:2]
    found = search(grid)
    if found is None:
        return None
    score, at = found[0], found[1] * (w, h) / (w, h)
    if (crop := _crop_of(at[:, 0], at[:, 1], w, h)) is None:
        return score, at, False
    x0, y0, cw, ch = crop
    fine = search(grid[y0 : y0 + ch, x0 : x0 + cw])
    if fine is None or fine[0] < score:
        return score, at, False
    moved = fine[1] * (cw, ch) / (cw, ch) + (x0, y0)
    if np.hypot(*(at - moved).T).max() > LARGEST_SHIFT * max(w, h):
        return score, at, False
    return fine[0], moved, True


def _found_in_own(df: DataFrame, by: str, pixels: int) -> DataFrame:
    """(by, score, px, py, refined) of images of at most ``COARSE`` pixels a side, both passes in one group and one shuffle."""
    kind = df.schema[by].dataType.simpleString()
    ship(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        empty = _nothing(rows, by).assign(refined=pd.Series([], dtype=bool))
        grid = own_grid(rows["y"].to_numpy(), rows["x"].to_numpy(), rows[["r", "g", "b"]].to_numpy(dtype=float))
        found = search_twice(grid) if min(grid.shape[:2]) >= LEAST_SIDE else None
        if found is None:
            return empty
        score, q, refined = found
        return pd.DataFrame({by: rows[by].iloc[:1].to_numpy(), "score": [score], "px": [q[:, 0].tolist()], "py": [q[:, 1].tolist()], "refined": [refined]}).astype({by: rows[by].dtype})

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pixels // _TASK_PIXELS))
    return df.select(by, "y", "x", "r", "g", "b").repartition(parts, by).groupBy(by).applyInPandas(run, f"{by} {kind}, {_RESULT}, refined boolean")


def _with_each(df: DataFrame, each: DataFrame, by: str, rows: int) -> DataFrame:
    """Pixels with the columns of a table of so many rows, one an image. Pixels are never the side that is broadcast: Spark's
    estimate of their size is that of what they were exploded from."""
    return df.join(F.broadcast(each) if rows <= _FEW_IMAGES else each.hint("shuffle_hash"), by)


def find_pages(df: DataFrame, by: str) -> DataFrame:
    """(by, score, px, py, refined) of the images (by, y, x, r, g, b) in which a page is found.

    A second, finer pass over the crop about the first quad wins if its score is no less and no corner moves far."""
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count("*").alias("n"))
    sizes = cut(sizes)
    large = F.greatest("w", "h") > COARSE
    many, pixels = sizes.agg(F.count_if(large), F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0))).first()
    own = df.where(F.col(by).isNotNull()) if not many else df.join(sizes.where(~large).select(by), by, "leftsemi")
    found = _found_in_own(own, by, pixels)
    return found.unionByName(_found_in_large(df, sizes.where(large).drop("n"), by, many)) if many else found


def _found_in_large(df: DataFrame, sizes: DataFrame, by: str, rows: int) -> DataFrame:
    """The same of the images in a table (by, w, h) of so many rows, with means of cells in each pass."""
    coarse = cut(_searched(_with_each(df, sizes, by, rows), by, COARSE).join(sizes, by))
    crops = coarse.select(by, *(c.alias(n) for n, c in _crop(F.col("w"), F.col("h")).items()), F.col("w").alias("fw"), F.col("h").alias("fh"))
    small = (F.col("cw") >= LEAST_CROP) & (F.col("ch") >= LEAST_CROP) & (F.col("cw") * F.col("ch") <= LARGEST_CROP * F.col("fw") * F.col("fh"))
    crops = crops.where(small).select(by, "x0", "y0", F.col("cw").alias("w"), F.col("ch").alias("h"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h"))
    cropped = _with_each(df, crops, by, rows).where(inside).withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")})
    fine = _searched(cropped, by, FINE).join(crops.select(by, "x0", "y0"), by)
    moved = lambda p, o: F.transform(p, lambda v: v + F.col(o))
    fine = fine.select(by, F.col("score").alias("fs"), moved("px", "x0").alias("fx"), moved("py", "y0").alias("fy"))
    both = coarse.join(fine, by, "left")
    shift = F.array_max(F.transform(F.arrays_zip("px", "py", "fx", "fy"), lambda z: F.hypot(z["px"] - z["fx"], z["py"] - z["fy"])))
    both = both.withColumn("refined", F.coalesce((F.col("fs") >= F.col("score")) & (shift <= LARGEST_SHIFT * F.greatest("w", "h")), F.lit(False)))
    pick = lambda a, b: F.when(F.col("refined"), F.col(a)).otherwise(F.col(b))
    return both.select(by, pick("fs", "score").alias("score"), pick("fx", "px").alias("px"), pick("fy", "py").alias("py"), "refined")


def score_pages(df: DataFrame, quads: DataFrame, by: str) -> DataFrame:
    """(by, score, px, py) of the given quads (by, px, py), one an image, that have a page's borders; corners come back in order."""
    kind = df.schema[by].dataType.simpleString()
    ship(df.sparkSession)

    def run(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        empty = _nothing(rows, by)
        if rows.empty or given.empty:
            return empty
        first, g = rows.iloc[0], given.iloc[0]
        scale = np.array([first["w"] / first["gw"], first["h"] / first["gh"]], dtype=float)
        q = _ordered(np.stack([g["px"], g["py"]], axis=1)[None] / scale)
        found = _scored(edge_maps(_grid(rows)), q)[0]
        if not np.isfinite(found):
            return empty
        return pd.DataFrame({by: [first[by]], "score": [found], "px": [(q[0, :, 0] * scale[0]).tolist()], "py": [(q[0, :, 1] * scale[1]).tolist()]}).astype({by: rows[by].dtype})

    grid = detection_grid(df.join(image_sizes(df, by), by), by, COARSE)
    return grid.groupBy(by).cogroup(quads.groupBy(by)).applyInPandas(run, f"{by} {kind}, {_RESULT}")
