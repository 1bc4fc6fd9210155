import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelloom.llm.mixing import fit_budget, mix_report, mixed, targets


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_fit_is_the_nearest_sum():
    rng = random.Random(2)
    for _ in range(150):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 4))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        got = fit_budget(lengths, counts, budget)
        assert ((got >= 0) & (got <= counts)).all()
        base = counts * budget // int((lengths * counts).sum())
        sums = {sum(a * b for a, b in zip(lengths, c)) for c in itertools.product(*(range(b, n + 1) for b, n in zip(base, counts)))}
        assert abs(int((lengths * got).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_large_budgets_go_through_the_greedy_part():
    lengths, counts = np.arange(1, 400), np.full(399, 7)
    for budget in (0, 1, 200_001, int((lengths * counts).sum()) - 1):
        assert int((lengths * fit_budget(lengths, counts, budget, programme=500)).sum()) == budget


def rows():
    rng = random.Random(4)
    out = [(i, "w " * rng.choice([1, 3, 3, 3, 17, 40]), rng.choice(["a", "a", "a", "b", "é", "Z", None]), i) for i in range(400)]
    return out + [(500, None, "a", 1), (501, "", "only-empty", 1), (None, "x y z", "a", 1), (1, "x y", "b", 1), (1, "x y", "b", 1), (600, "long " * 30_000, "c", 1)]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = mix_report(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
    want = brute_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 or s == "c"
    assert sorted(map(str, got)) == sorted(map(str, mix_report(df.repartition(3)).collect()))
    per_doc = Counter((r.doc_id, r.size) for r in mixed(df).selectExpr("doc_id", "size(array_remove(split(coalesce(text, ''), ' '), '')) size").collect())
    want_rows = Counter()
    for r in got:
        if r.size:
            want_rows[r.doc_id, r.size] += r.taken // r.size
    assert +Counter({k: v for k, v in per_doc.items() if k[1]}) == +want_rows


def test_targets_of_many_sources(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 20, 61):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 100, 1000, 5000]) + i for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_report(df).collect() == [] and mixed(df).collect() == []
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_report(df).collect()] == [(0, 0.0, 0)]


def test_clashing_names(spark):
    names = ["_i", "_t", "_times", "_rows", "_rank", "_copy", "i", "t", "of", "total", "among", "rank", "copy", "text_hash", "own_source"]
    data = [(n, "w " * (n % 5 + 1), "ab"[n % 2], *range(n, n + len(names))) for n in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    got = mixed(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= set(data)


def test_equal_rows_of_two_sources_are_told_apart(spark):
    rows = [(1, "x y z", "a")] + [(1, "x y z", "b")] * 3 + [(i, "w", "b") for i in range(2, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter((r.doc_id, r.source) for r in mixed(df).collect())
    for r in mix_report(df).collect():
        want[r.doc_id, r.source] += r.taken // r.size
    assert got == +want


def test_memory_is_bounded_by_the_programme():
    """All lengths even and the budget odd: no sum hits it, and a length of four million words changes nothing."""
    import tracemalloc

    lengths, counts = np.array([*range(2, 802, 2), 4_000_000]), np.full(401, 5)
    tracemalloc.start()
    taken = fit_budget(lengths, counts, 12_400_001, programme=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(int((lengths * taken).sum()) - 12_400_001) == 1 and peak < 8 << 20
