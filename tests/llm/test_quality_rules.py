import math
import random
import re

from pyspark.sql import functions as F

from pixelloom.llm import quality_rules as qr
from pixelloom.llm.quality_rules import COUNTS, binomial_tail, measured, path_of, quality_report, quality_rules, safe_steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    marked = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))
    return (*base, base[0] < 10 or 100 * base[4] > 20 * base[0])


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t\n ", "a b c d e", "a a a a a a a", "é ñ # | x", "x\ny\nx\n x\nx", "a b c d e\n" * 3000, "🙂 b"]
    for _ in range(200):
        out.append("".join(rng.choice(["a ", "b ", "c ", "d\n", "\t", "é#", " ", "<b>"]) for _ in range(rng.randint(1, 120))))
    return out


def test_counts_match_brute_force(spark):
    rows = [(i, t, "en", 7) for i, t in enumerate(texts())]
    df = measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int"))
    got = {r["doc_id"]: (*(r[c] for c in COUNTS), r["base_failed"]) for r in df.collect()}
    assert got == {i: brute(t) for i, t, *_ in rows}


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 60, 900) for k in {0, 1, n // 3, n - 1, n} if 0 <= k <= n]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.withColumn("p", binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        exact = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.02) + (r.n - i) * math.log(0.98)) for i in range(r.k + 1))
        assert abs(r.p - exact) < 1e-9


def test_cutoffs_are_safe_and_reject_junk(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    rows = [(i, words(30) if i % 4 else words(30).replace(" ", "### "), "en" if i % 3 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(3000)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_report(docs, labels).collect()}
    assert all(kept[i] for i in range(3000) if i % 4) and not any(kept[i] for i in range(0, 3000, 4))
    stage = quality_rules(docs.withColumn("kept", F.lit(1)), labels)
    assert {r.doc_id: r.kept for r in stage.select("doc_id", "kept").collect()} == kept


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", None), (2, "a ### ###", "en"), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    marked = qr._marked(measured(docs), labels, "lang")
    assert path_of(marked) == [] and safe_steps(marked, []).collect() == []
    assert sorted(r.kept for r in quality_rules(docs, labels).collect()) == [False, False, True]
    assert quality_report(docs.limit(0), labels).count() == 0


def exact_tail(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_guarantee_is_for_all_rules_together_in_each_stratum(spark):
    """Against brute force: strata go along the path as far as the union's exact test allows."""
    rng, rows, labels = random.Random(4), [], []
    for i in range(6000):
        good, lang = rng.random() < 0.6, rng.choice(["aa"] * 5 + ["bb"] * 3 + [None] * 2 + ["cc"] * 2 + ["few"] * (i % 20 == 0))
        words = [str(rng.randint(0, 10**6)) for _ in range(20)]
        # Every kind of junk is in good documents too, more often in some strata; each kind alone stays below the limit in "bb".
        kind = rng.randrange(3) if not good or rng.random() < {"aa": 0.004, "bb": 0.036, "cc": 0.0}.get(lang, 0.012) else None
        if kind is not None:
            words = [[w + "###" for w in words], [w + "!!!" for w in words], [w.replace("1", "A").replace("2", "BCDEF") + "XYZ" for w in words]][kind]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    marked = qr._marked(measured(docs), marks, "lang").cache()
    path = path_of(marked)
    assert len({rule for rule, _ in path}) >= 3
    held = [r for r in marked.collect() if r.good and not r.design]
    strata, want = {(r.none, r.s) for r in held}, {}
    for key in strata:
        own = [r for r in held if (r.none, r.s) == key]
        steps = 0
        while steps < len(path) and exact_tail(sum(any(r[rule] > c for rule, c in path[: steps + 1]) for r in own), len(own), qr.ALPHA) <= qr.DELTA / len(strata):
            steps += 1
        want[key] = steps
    assert {(r.none, r.s): r.steps for r in safe_steps(marked, path).collect()} == want
    assert want[False, "cc"] == len(path) and want[False, "few"] == 0 and want[False, "bb"] < len(path)
    kept = {r.doc_id: r.kept for r in quality_report(docs, marks).collect()}
    figures = {r.doc_id: r for r in measured(docs).collect()}
    for i, _, lang in rows:
        steps = want[lang is None, lang or ""]
        assert kept[i] == (not figures[i].base_failed and not any(figures[i][rule] > c for rule, c in path[:steps]))


def test_many_strata_are_joined_like_few(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.random()) for _ in range(20)) + " #" * 60 * (i % 4 == 0), f"s{i % 3}" if i % 3 else None, 1, 2, 3) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _n_lines int, steps int, kept int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(3000)], "doc_id long, quality int")
    few = sorted(quality_rules(docs, labels).collect())
    monkeypatch.setattr(qr, "BROADCAST_STRATA", 0)
    assert sorted(quality_rules(docs, labels).collect()) == few
    assert all(r.kept == (r.doc_id % 4 > 0) and (r["_n_lines"], r["steps"]) == (1, 2) for r in few)
