import numpy as np
import pandas as pd
import pytest

from pixelloom.operators import finder as P

QUAD = [(44, 33), (276, 30), (283, 206), (38, 211)]


def scene(quad, paper, table, w=320, h=240):
    y, x = np.mgrid[:h, :w]
    inside = np.ones((h, w), dtype=bool)
    for (ax, ay), (bx, by) in zip(quad, [*quad[1:], quad[0]]):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    return np.dstack([np.where(inside, paper, table)] * 3)


def overlap(a, b, w=320, h=240):
    first, second = (scene(q, 1.0, 0.0, w, h)[..., 0] > 0.5 for q in (a, b))
    return (first & second).sum() / (first | second).sum()


def printed(grid):
    grid = grid.copy()
    for y in range(52, 190, 14):
        grid[y : y + 2, 72:250] = 0.3
    return grid


@pytest.mark.parametrize("grid", [scene(QUAD, 0.88, 0.25), printed(scene(QUAD, 0.88, 0.25)), scene(QUAD, 0.86 + 14 / 255, 0.86)], ids=["plain", "printed", "pale"])
def test_page_is_found(grid):
    score, corners = P.search(grid)
    assert overlap(QUAD, corners) >= 0.95
    assert np.hypot(*(corners - np.array(QUAD)).T).max() < 0.021 * np.hypot(320, 240)


def test_no_page():
    box = [(12, 12), (250, 12), (250, 200), (12, 200)]
    assert P.search(np.full((240, 320, 3), 0.9)) is None
    assert P.search(scene(box, 0.9 + 3 / 255, 0.9)) is None
    # Darker on every side, of the same colour: a shadow. The same quad is a page if it is brighter.
    quad = np.array(box, dtype=float)[None]
    assert P._scored(P.edge_maps(scene(box, 0.12, 0.55)), quad)[0] == -np.inf
    assert np.isfinite(P._scored(P.edge_maps(scene(box, 0.55, 0.12)), quad)[0])


def test_support_bridges_short_gaps():
    assert P.longest_support(np.array([], dtype=int), 2) == 0
    assert P.longest_support(np.array([3, 4, 7, 8, 12]), 2) == 4
    assert P.longest_support(np.array([3, 4, 7, 8, 12]), 3) == 5


def test_samples_and_windows_against_loops():
    rng = np.random.default_rng(2)
    grid = rng.random((19, 23))
    at = rng.uniform(-2, 25, (200, 2))
    got, inside = P.sample(grid[..., None], at)
    for (x, y), value, ok in zip(at, got[:, 0], inside):
        assert ok == (0 <= x <= 22 and 0 <= y <= 18)
        if ok:
            i, j = int(y), int(x)
            k, m = min(i + 1, 18), min(j + 1, 22)
            want = (grid[i, j] * (1 - x + j) + grid[i, m] * (x - j)) * (1 - y + i) + (grid[k, j] * (1 - x + j) + grid[k, m] * (x - j)) * (y - i)
            assert value == pytest.approx(want)
    busy = P._busy(grid, 4)
    for y, x in [(0, 0), (3, 9), (18, 22)]:
        assert busy[y, x] == pytest.approx(grid[max(0, y - 4) : y + 4, max(0, x - 4) : x + 4].mean())


def test_pages_of_a_table(spark):
    images = {1: scene(QUAD, 0.88, 0.25), 2: np.full((60, 80, 3), 0.5), 3: np.full((12, 40, 3), 0.5)}
    frames = []
    for k, g in images.items():
        y, x = np.mgrid[: g.shape[0], : g.shape[1]]
        frames.append(pd.DataFrame({"id": k, "y": y.ravel(), "x": x.ravel(), "r": g[..., 0].ravel(), "g": g[..., 1].ravel(), "b": g[..., 2].ravel()}))
    df = spark.createDataFrame(pd.concat(frames))
    found = P.find_pages(df, "id").collect()
    assert [r["id"] for r in found] == [1]
    assert overlap(QUAD, np.stack([found[0]["px"], found[0]["py"]], axis=1)) >= 0.95
    given = spark.createDataFrame([(1, [283.0, 44.0, 38.0, 276.0], [206.0, 33.0, 211.0, 30.0]), (2, [10.0, 70.0, 70.0, 10.0], [10.0, 10.0, 50.0, 50.0])], "id long, px array<double>, py array<double>")
    scored = P.score_pages(df, given, "id").collect()
    assert [r["id"] for r in scored] == [1] and scored[0]["px"] == [44.0, 276.0, 283.0, 38.0]
    assert P.find_pages(df.where("id > 5"), "id").count() == 0


def test_search_scores_few_quads_and_finds_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:48, :60]
    scored, plausible, real = [], 0, P.scores
    for k in range(10):
        quad = np.array([(8, 6), (52, 6), (52, 42), (8, 42)]) + rng.uniform(-5, 5, (4, 2))
        grid = scene(quad, 0.9, 0.1, 60, 48) * rng.uniform(0.6, 1.0, 3) + rng.normal(0, 0.02 * (k % 3), (48, 60, 3)) - 0.3 * (k == 9)
        maps = P.edge_maps(grid)
        quads = P.candidates(maps)
        every = P._scored(maps, quads)
        plausible += P.geometry(quads, 60, 48)[0].sum() * (k % 3 == 0)
        with monkeypatch.context() as m:
            m.setattr(P, "scores", lambda maps, q, angles: scored.append((k, len(q))) or real(maps, q, angles))
            found = P.search(grid)
        if not np.isfinite(every.max(initial=-np.inf)):
            assert found is None
            continue
        assert found[0] == every.max() and (found[1] == quads[every.argmax()]).all()
    few = sum(n for k, n in scored if k in (0, 3, 6))  # without noise or values below 0
    assert 0 < few < plausible / 4


def _table(spark, images, at):
    """Pixels of grey images, exploded from a stored row each, as far larger than Spark's estimate as in the queries."""
    spark.createDataFrame([(k, g.tolist()) for k, g in images.items()], "id long, v array<array<double>>").write.parquet(str(at))
    rows = spark.read.parquet(str(at)).selectExpr("id", "posexplode(v) AS (y, line)").selectExpr("id", "y", "posexplode(line) AS (x, v)")
    return rows.selectExpr("id", "y", "x", "v AS r", "v AS g", "v AS b")


def _broadcasts(df):
    """The subtrees of the plan that are broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    found = []
    for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        found.append("\n".join(lines[i:end]))
    return found


@pytest.mark.parametrize("few", [10_000, 0], ids=["few", "many"])
def test_pixels_are_not_broadcast(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(P, "_FEW_IMAGES", few, raising=False)
    small = scene([(8, 6), (52, 6), (52, 42), (8, 42)], 0.9, 0.1, 60, 48)[..., 0]
    for images in ({1: small}, {1: small, 2: scene([(60, 40), (420, 44), (416, 280), (64, 276)], 0.9, 0.1, 500, 320)[..., 0]}):
        found = P.find_pages(_table(spark, images, tmp_path / str(len(images))), "id")
        assert not any("Generate" in x for x in _broadcasts(found))
        assert {r["id"] for r in found.collect()} == set(images)


def test_both_passes_in_one_group_as_in_two(spark, tmp_path):
    images = {1: scene(QUAD, 0.88, 0.25)[..., 0], 2: scene([(90, 70), (200, 66), (206, 160), (84, 164)], 0.9, 0.1)[..., 0], 3: np.full((60, 80), 0.5), 4: np.full((12, 40), 0.5)}
    images[5] = images[2] + np.random.default_rng(3).normal(0, 0.03, images[2].shape)
    df = _table(spark, images, tmp_path / "images")
    sizes = P.image_sizes(df, "id")
    want = {r["id"]: r for r in P._found_in_large(df, sizes, "id", 5).collect()}
    got = {r["id"]: r for r in P.find_pages(df, "id").collect()}
    assert got == want and any(r["refined"] for r in got.values()) and not all(r["refined"] for r in got.values())
    assert not {3, 4} & set(got)


def test_own_grid_takes_means_and_skips_missing():
    y, x = np.array([0, 0, 1, 1, 1]), np.array([0, 1, 0, 0, 2])
    v = np.array([0.5, 0.25, 1.0, 3.0, 7.0])
    rgb = np.stack([v, np.where(v == 3.0, np.nan, v), np.where(v == 7.0, np.nan, v)], axis=1)
    want = np.array([[[0.5] * 3, [0.25] * 3, [0.0] * 3], [[2.0, 1.0, 2.0], [0.0] * 3, [7.0, 7.0, np.nan]]])
    np.testing.assert_array_equal(P.own_grid(y, x, rgb), want)
    once = np.arange(5) != 3
    np.testing.assert_array_equal(P.own_grid(y[once], x[once], rgb[once])[1], [[1.0] * 3, [0.0] * 3, [7.0, 7.0, np.nan]])
