import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import language_id, quality_classifier, toxicity
from pixelloom.llm.language_id import language_scores
from pixelloom.llm.quality_classifier import quality_scores
from pixelloom.llm.supervised import held_out, labelled_sample, unlabelled_sample
from pixelloom.llm.toxicity import toxicity_scores

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "su"], "bb": ["ström", "vå", "dö", "lag", "ny"]}
INSULTS = ["grumbat", "snivelhog", "dolthead"]


def corpus(n=1200, seed=6):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        quality, toxic = int(rng.random() > 0.25), int(rng.random() < 0.2)
        if not quality:
            words = [w + "###" for w in words] if rng.random() < 0.5 else [w for w in words[:8] for _ in range(6)]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words), lang, "s", 0.0))
        labels.append((i, quality, toxic))
    odd = [(n, None, "aa", None, 1.0), (n + 1, "", "bb", None, 1.0), (n + 2, "123 !!", None, None, None), (None, "kalomi", None, None, None), (n + 3, "lomi " * 40_000, None, "s", 0.0), (0, docs[0][1], docs[0][2], "s", 0.0)]
    return docs + odd, labels + [(0, labels[0][1], labels[0][2]), (None, 1, 1), (5, None, None)]


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, {a: (b, c) for a, b, c in labels if b is not None}


@pytest.mark.parametrize("score, column, parts, remainder, reach", [(quality_scores, 0, 5, 0, 0.97), (toxicity_scores, 1, 4, 2, 0.97)])
def test_held_out_accuracy(spark, score, column, parts, remainder, reach):
    docs, labels, rows, truth = frames(spark)
    got = score(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == remainder) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in held]) >= reach
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    # Labels of held-out documents change nothing.
    turned = spark.createDataFrame([(a, b if zlib.crc32(str(a).encode()) % parts != remainder else 1 - b, c if zlib.crc32(str(a).encode()) % parts != remainder else 1 - c) for a, (b, c) in truth.items() if a is not None], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score) for r in score(docs, turned).collect() if r.doc_id is not None} == {(r.doc_id, r.score) for r in got if r.doc_id is not None}
    none = score(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and len({r.score for r in none}) == 1
    assert score(docs.limit(0), labels).collect() == []


def test_languages(spark):
    docs, _, rows, _ = frames(spark)
    got = language_scores(docs).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"aa", "bb", "und"}
    assert np.mean([by[i].lang_pred == lang for i, t, lang, *_ in rows if i in by and by[i].held_out and lang and t]) > 0.98
    assert by[1200].lang_pred == by[1201].lang_pred == by[1202].lang_pred == "und" and by[1203].lang_pred == "aa"
    assert {r.lang_pred for r in language_scores(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_kernel_is_the_share_of_common_grams():
    x = language_id.presence(["abab", "ab", "", None])
    assert np.allclose((x * x).sum(axis=1), [1, 1, 0, 0])
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    a, b = grams("abab"), grams("ab")
    assert np.isclose(x[0] @ x[1], len(a & b) / np.sqrt(len(a) * len(b)))


def brute_features(text):
    """Counts of (kind, feature) of one text, by Python strings: words, n-grams of words with their ends, pairs."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter()
    for w in words:
        marked = f" {w} "
        for size in quality_classifier.GRAMS:
            grams.update(marked[i : i + size] for i in range(len(marked) - size + 1))
    return Counter(words), grams, Counter(zip(words, words[1:]))


def test_features_match_brute_force():
    texts = ["a bc  def\tä", "", None, "日本語 日本語 🙂x", " lead\x0bing ", "x", "Te Te Te Te", "ñ" * 7, "é\ré"]
    doc, cell, kind = quality_classifier.features(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        for k, (want, low) in enumerate(zip(brute_features(text or ""), (quality_classifier.WORDS, quality_classifier.NGRAMS, quality_classifier.PAIRS))):
            own = cell[(doc == i) & (kind == k)]
            assert len(own) == sum(want.values()) and (own >= low).all() and (own < quality_classifier.CELLS).all()
            # One cell for each feature, the same in every text.
            counts = Counter(own.tolist())
            assert sorted(counts.values()) == sorted(want.values()) or len(counts) < len(want)
            if len(want) == 1:
                (feature,), (c,) = want, counts
                assert seen.setdefault((k, feature), c) == c
    same = [quality_classifier.features(pa.array([t])) for t in ("Te Te", "Te Te Te Te")]
    assert {c for c in same[0][1][same[0][2] == 1]} == {c for c in same[1][1][same[1][2] == 1]}


def test_scores_by_table_equal_the_network():
    texts = ["a b c a b c", "ä ö", ""]
    model = quality_classifier.train(texts * 5, np.array([1, 0, 1] * 5))
    bags = quality_classifier._bags(pa.array(texts))
    z = [float((w * model.logit[c]).sum()) + model.bias for c, w in bags]
    assert np.allclose(model(pa.array(texts)), 1 / (1 + np.exp(-np.array(z))), atol=1e-6)
    assert all(np.isclose(w.sum(), 1) for _, w in bags[:2])


def test_step_goes_down_the_gradient():
    """The step against the numeric gradient of a text's cross-entropy."""
    rng = np.random.default_rng(1)
    vectors, softmax, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), np.array([0.2, -0.1])
    cells, weights = np.array([1, 4]), np.array([0.25, 0.75], np.float32)

    def loss(v, s):
        z = (weights @ v[cells]) @ s + bias
        return np.log(np.exp(z).sum()) - z[1]

    def numeric(array, of):
        out, eps = np.zeros_like(array), 1e-6
        for at in np.ndindex(array.shape):
            up, down = array.copy(), array.copy()
            up[at] += eps
            down[at] -= eps
            out[at] = (of(up) - of(down)) / (2 * eps)
        return out

    new_v, new_s = vectors.copy(), softmax.copy()
    quality_classifier.step(new_v, new_s, bias, cells, weights, 1, 1e-3)
    assert np.allclose(softmax - new_s, 1e-3 * numeric(softmax, lambda s: loss(vectors, s)), atol=1e-7)
    assert np.allclose(vectors - new_v, 1e-3 * len(cells) * numeric(vectors, lambda v: loss(v, softmax)), atol=1e-7)


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    good = [np.where(rng.random(3000) < 0.6, np.where(truth, 1, -1) * np.where(rng.random(3000) < 0.9, 1, -1), 0) for _ in range(6)]
    copies = [good[0]] * 8
    post = toxicity.label_model(np.stack(good + copies, axis=1), 0.3)
    assert ((post > 0.5) == truth).mean() > 0.93


def test_posterior_beats_majority_vote(monkeypatch):
    """Many spellings of one weak voter outvote the good ones; the tree sees that they are one."""
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    vote = lambda speaks, right: np.where(rng.random(4000) < speaks, np.where(truth, 1, -1) * np.where(rng.random(4000) < right, 1, -1), 0)
    good, weak = [vote(0.7, 0.85) for _ in range(5)], vote(0.9, 0.6)
    v = np.stack(good + [np.where(rng.random(4000) < 0.97, weak, 0) for _ in range(9)], axis=1)
    majority = v.sum(axis=1) > 0
    post = toxicity.label_model(v, 0.3)
    right = ((post > 0.5) == truth).mean()
    assert right > (majority == truth).mean() + 0.15
    monkeypatch.setattr(toxicity, "TREE_EVERY", toxicity.ROUNDS + 1)
    independent = toxicity.label_model(v, 0.3)
    assert right > ((independent > 0.5) == truth).mean() + 0.05


def brute_tree(speaks, weights):
    """The weight of a maximum spanning tree of mutual information given the kind, by Kruskal over all pairs."""
    n, m = speaks.shape
    pairs = []
    for i in range(m):
        for j in range(i):
            total = 0.0
            for w in weights:
                for a in (0, 1):
                    for b in (0, 1):
                        p = w[(speaks[:, i] == a) & (speaks[:, j] == b)].sum() / w.sum()
                        pa_, pb = w[speaks[:, i] == a].sum() / w.sum(), w[speaks[:, j] == b].sum() / w.sum()
                        total += w.sum() / n * p * np.log(p / (pa_ * pb)) if p > 0 else 0.0
            pairs.append((total, i, j))
    group, weight = list(range(m)), 0.0
    for total, i, j in sorted(pairs, reverse=True):
        if group[i] != group[j]:
            weight, group = weight + total, [group[i] if g == group[j] else g for g in group]
    return weight, {frozenset((i, j)): t for t, i, j in pairs}


def test_tree_is_the_maximum_spanning_tree(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_G", -1.0)
    rng = np.random.default_rng(2)
    base = rng.random((600, 4)) < 0.4
    speaks = np.concatenate([base, base ^ (rng.random((600, 4)) < 0.15)], axis=1).astype(float)
    post = rng.random(600)
    want, of_pair = brute_tree(speaks, [post, 1 - post])
    parent = toxicity._tree(speaks, [post, 1 - post])
    edges = {frozenset((j, int(p))) for j, p in enumerate(parent) if p >= 0}
    assert len(edges) == 7 and abs(sum(of_pair[e] for e in edges) - want) < 1e-3


def test_ridge_on_all_landmarks_is_kernel_ridge_regression(monkeypatch):
    """With every text a landmark, the Nyström map is exact: the dual solution gives the same values."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(SYLLABLES["aa" if i % 3 else "bb"]) for _ in range(12)) for i in range(40)]
    marks = ["aa" if i % 3 else "bb" for i in range(40)]
    monkeypatch.setattr(language_id, "LANDMARKS", 80)
    model = language_id.train(texts, marks)
    x = language_id.presence(texts).astype(np.float64)
    kernel, goal = x @ x.T, np.array([[m == "aa", m == "bb"] for m in marks], float)
    weight = np.array([40 / (2 * marks.count(m)) for m in marks])
    dual = kernel @ np.linalg.solve(kernel + language_id.RIDGE * 40 / 100 * np.diag(1 / weight), goal)
    assert len(model.landmarks) == 40
    assert np.allclose((x @ model.landmarks.T) @ model.weights, dual, atol=2e-3)


def test_every_language_is_learned(spark):
    """A rare language among a hundred others."""
    rng, rows = random.Random(4), []
    for i in range(2600):
        lang = i % 100 if i < 2400 else 100 + i % 2
        alphabet = [chr(0x4E00 + 40 * lang + k) for k in range(12)]
        rows.append((i, "".join(rng.choice(alphabet) for _ in range(30)), f"l{lang:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_scores(docs).collect()}
    assert len(set(got.values())) == 102 and np.mean([got[i] == lang for i, _, lang in rows]) > 0.99


def test_repeated_labelled_rows_are_one(spark):
    docs = spark.createDataFrame([(1, "same text")] * 500 + [(2, "other"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, mark int")
    got = labelled_sample(docs, marks, F.lit(True))
    assert sorted(zip(got["doc_id"], got["text"], got["mark"])) == [(1, "same text", 1), (2, "other", 0)] or sorted(zip(got["doc_id"], got["text"], got["mark"])) == [(1, "same text", 1), (2, "other", 0), (3, "", 1)]


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_query_scores_texts_one_by_one(spark, score):
    """The query against the model put together by hand and asked for each whole text alone; a very long one among them."""
    docs, labels, rows, _ = frames(spark)
    module, column, parts, remainder = (quality_classifier, "quality", 5, 0) if score is quality_scores else (toxicity, "toxic", 4, 2)
    keep = ~held_out(parts, remainder)
    sample = labelled_sample(docs, labels.selectExpr("doc_id", f"{column} as mark"), keep)
    more = (unlabelled_sample(docs, sample["doc_id"].tolist(), keep, toxicity.FIT_ROWS),) if module is toxicity else ()
    model = module.train(sample["text"].tolist(), sample["mark"].to_numpy(np.int64), *more)
    got = {(r.doc_id, round(r.score, 9)) for r in score(docs, labels).collect()}
    assert got == {(i, round(float(model(pa.array([t], pa.string()))[0]), 9)) for i, t, *_ in rows}
