import math
from itertools import combinations, product

import numpy as np
import pytest

from pixelloom.operators import lines as L

def in_order(q):
    by = lambda f: min(q, key=f)
    return [by(lambda p: p[0] + p[1]), by(lambda p: p[1] - p[0]), by(lambda p: -(p[0] + p[1])), by(lambda p: p[0] - p[1])]


def plausible(q, w, h):
    area = abs(sum(q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(4))) / 2
    if min(math.dist(*two) for two in combinations(q, 2)) < 4 or area < 0.08 * w * h or any(not (-0.1 * w <= x <= 1.1 * w and -0.1 * h <= y <= 1.1 * h) for x, y in q):
        return False
    turns = []
    for i in range(4):
        (ax, ay), (x, y), (bx, by) = q[i - 1], q[i], q[(i + 1) % 4]
        turns.append((x - ax) * (by - y) - (y - ay) * (bx - x))
        cos = ((ax - x) * (bx - x) + (ay - y) * (by - y)) / (math.dist(q[i - 1], q[i]) * math.dist(q[i], q[(i + 1) % 4]))
        if not 60 <= math.degrees(math.acos(cos)) <= 120:
            return False
    return min(turns) >= 1 or max(turns) <= -1


def test_quads_of_lines_against_each_quad(spark):
    rng = np.random.default_rng(4)
    lines = lambda thetas, counts: [(g, i + 1, int(rng.choice(thetas)), int(rng.integers(-10, 110))) for g, n in counts.items() for i in range(n)]
    # Odd and even angles: none is exactly 60 or 120 degrees from another.
    h, v = lines(range(51, 131, 2), {"a": 9, "b": 12, "c": 1, "d": 3}), lines([*range(0, 40, 2), *range(140, 180, 2)], {"a": 8, "b": 12, "c": 5, "e": 3})
    frames = [spark.createDataFrame(x, "key string, id int, theta int, rho int") for x in (h, v)]
    got = {tuple(r)[:5]: r.q for r in L.line_quads(*frames, ["key"], 100.0, 90.0).collect()}
    want = {}
    for key in "abc":
        own = [[x[1:] for x in lines if x[0] == key] for lines in (h, v)]
        for (a, b), (c, d) in product(combinations(own[0], 2), combinations(own[1], 2)):
            corners = []
            for (_, t, p), (_, u, r) in ((a, c), (a, d), (b, d), (b, c)):
                m = np.array([[math.cos(math.radians(x)), math.sin(math.radians(x))] for x in (t, u)])
                corners += [tuple(np.linalg.solve(m, [p, r]))] if abs(np.linalg.det(m)) >= 0.34 else []
            if len(corners) == 4 and plausible(q := in_order(corners), 100, 90):
                want[key, a[0], b[0], c[0], d[0]] = q
    assert got.keys() == want.keys() and len(want) > 20
    for k, q in want.items():
        assert np.ravel(got[k]) == pytest.approx(np.ravel(q))


def test_no_row_for_each_two_pairs_of_lines(spark):
    lines = spark.createDataFrame([(1, k, t, 30 * k) for t in (0, 90) for k in (1, 2, 3)], "image long, id int, theta int, rho int")
    quads = L.line_quads(lines.where("theta = 90"), lines.where("theta = 0"), ["image"], 100.0, 100.0)
    assert quads.count() == 9
    assert "Generate" not in quads._jdf.queryExecution().optimizedPlan().toString()


def test_peaks_offer_only_what_can_be_one(spark):
    cells = [(1, t, r, 1) for t in range(40) for r in range(40)] + [(1, 50, 50, 3), (1, 51, 52, 2), (1, 20, 60, 2)]
    votes = spark.createDataFrame(cells, "image long, theta int, rho long, votes long")
    peaks = L.peaks(votes, ["image"], 2)
    assert sorted(tuple(r)[1:] for r in peaks.collect()) == [(20, 60, 2), (50, 50, 3)]
    plan = peaks._jdf.queryExecution().optimizedPlan().toString()
    assert "votes" in plan[plan.index("Generate") :].partition("Filter")[2]
