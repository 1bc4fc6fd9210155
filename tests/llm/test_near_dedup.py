import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pixelloom.llm import near_dedup as nd
from pixelloom.llm import support
from pixelloom.llm.near_dedup import LEVELS, Sampler, _idf, components, document_shingles, frequencies, links, near_classes, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(60):
        out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 200))))
    for base in out[:25]:
        for _ in range(4):
            words = base.split()
            for _ in range(max(1, len(words) // rng.choice([40, 80, 1000]))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    out += [shared + " " + " ".join(rng.choice(vocab) for _ in range(60)) for _ in range(30)]
    return out + [out[0]] * 5 + ["one two", "one two", "one  two", "three"]


def brute_classes(texts, low):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and jaccard(sets[i], sets[j]) >= low):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_classes_match_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_classes(df).collect()}
    # Damped TF-IDF moves similarities a little: links that are clear by plain counts must be there, and no others.
    sure, maybe = brute_classes(texts, 0.84), brute_classes(texts, 0.76)
    groups = defaultdict(set)
    for i, c in got.items():
        groups[c].add(i)
    for i in range(len(texts)):
        assert got[i] == got[sure[i]]
    for members in groups.values():
        assert len({maybe[i] for i in members}) == 1
        assert min(members) in groups and got[min(members)] == min(members)


def test_collision_rate_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    element = np.arange(400, dtype=np.uint64) * np.uint64(7919) + np.uint64(13)
    count_a, count_b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    level = (element % np.uint64(8)).astype(np.uint8)
    doc_elements = np.concatenate([element[:300], element[100:]])
    levels = np.concatenate([level[:300], level[100:]])
    sig = Sampler(4000).signatures(doc_elements, np.concatenate([count_a, count_b]), levels, np.array([0, 300]))
    a, b = np.zeros(400), np.zeros(400)
    a[:300], b[100:] = count_a * _idf(level[:300]), count_b * _idf(level[100:])
    assert abs((sig[:, 0] == sig[:, 1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_shingles_and_frequencies(spark):
    texts = [None, "", " a  b\tc d e f ", "a b c d e f", "x", "é é é é é é é é"]
    doc, element, count = document_shingles(pa.array(texts), 5)
    per = Counter(doc.tolist())
    assert dict(per) == {2: 2, 3: 2, 4: 1, 5: 1} and count[doc == 5].tolist() == [4]
    assert element[doc == 2].tolist() == element[doc == 3].tolist()
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    level = frequencies(df, "text", 5).level(element)
    assert level[0] < level[-1] == LEVELS - 1


def test_frequencies_are_exact(spark):
    """Every shingle of at least two documents and a hundredth of all has its own frequency, and the others the last level."""
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 6}" for _ in range(60)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    doc, element, _ = document_shingles(pa.array(texts), 5)
    names, counts = np.unique(element, return_counts=True)
    rarity = np.minimum(1, np.log(500 / counts) / np.log(1 / nd.FREQUENT))
    want = np.where(counts >= max(2, nd.FREQUENT * 500), np.round(rarity * (LEVELS - 1)), LEVELS - 1)
    assert len(set(want)) > 3 and (frequencies(df, "text", 5).level(names) == want).all()


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(400):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(120)] = f"n{i}-{rng.random()}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in near_classes(df).collect()} == {0}
    assert links(df).count() < 3 * 400


def exact_classes(spark, texts):
    """The classes by the exact similarity of all pairs, with the operator's weights."""
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    doc, element, count = document_shingles(pa.array(texts), 5)
    weight = frequencies(df, "text", 5).weight(element, count)
    names, column = np.unique(element, return_inverse=True)
    dense = np.zeros((len(texts), len(names)))
    dense[doc, column] = weight
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        shared = np.minimum(dense[i], dense[:i]).sum(axis=1)
        for j in np.flatnonzero(shared / (dense[i].sum() + dense[:i].sum(axis=1) - shared) >= 0.8):
            low, high = sorted((root(i), root(int(j))))
            parent[high] = low
    return {i: root(i) for i in range(len(texts))}


def template_family(n, pairs):
    """Texts that share 84 of 100 words, about 0.7 alike; in each of the first pairs, seven more words are the same."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(84)]
    own = [[f"u{i}-{rng.random()}" for _ in range(16)] for i in range(n)]
    for p in range(pairs):
        own[2 * p + 1][:8] = own[2 * p][:8]
    texts = [" ".join(template + o) for o in own]
    rng.shuffle(texts)
    return texts


def test_pairs_within_a_template_family_are_all_found(spark):
    texts = template_family(600, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = exact_classes(spark, texts)
    assert len(set(want.values())) == 600 - 60
    assert {r.doc_id: r.class_id for r in near_classes(df).collect()} == want


def test_bridges_between_large_groups_are_found(spark):
    """Pairs of groups with hubs 0.71 alike; one text of each group is like one of the other, and nothing else joins them."""
    rng, texts, worlds, copies = random.Random(5), [], 6, 90
    for w in range(worlds):
        t, c = [f"t{w}-{i}" for i in range(100)], [f"c{w}-{i}" for i in range(16)]
        for hub in (t, t[:84] + c):
            texts.append(" ".join(hub))
            for _ in range(copies):
                copy = list(hub)
                copy[rng.randrange(80)] = f"n{rng.random()}"
                texts.append(" ".join(copy))
        texts += [" ".join(t[:92] + c[8:]), " ".join(t[:88] + c[4:])]
    size = len(texts) // worlds
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_classes(df).collect()}
    assert got == {i: i // size * size for i in range(len(texts))}


def test_rounds_bound_work_and_not_results(spark, monkeypatch):
    monkeypatch.setattr(nd, "REFINEMENTS", 1)
    texts = template_family(300, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in near_classes(df).collect()} == exact_classes(spark, texts)


def test_odd_rows(spark):
    rows = [(None, None, 1), (7, "", 2), (7, "", 2), (3, "a b c d e f", 5), (3, "a b c d e f", 5), (None, "a b c d e f", 6), (9, "lone", 7), (8, "word " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert Counter((r.doc_id, r.class_id) for r in near_classes(df).collect()) == Counter({(None, 7): 1, (7, 7): 2, (3, 3): 2, (None, 3): 1, (9, 9): 1, (8, 8): 1})
    assert sorted(near_dedup(df).select("doc_id", "node").collect()) == [(3, 5), (7, 2), (8, 1), (9, 7)]
    assert near_classes(df.limit(0)).collect() == [] and near_dedup(df.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50}


def test_hot_keys_are_spread(spark, monkeypatch):
    """The same classes where every bucket, leader, text and hub counts as hot, and shingles meet in blocks of two."""
    monkeypatch.setattr(support, "LEAST_SHARE", 1)
    monkeypatch.setattr(nd, "BLOCK", 2)
    texts = template_family(120, 15) + ["same text in many places " * 6] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_classes(df).collect()}
    want = exact_classes(spark, texts[:120])
    assert got == want | {i: 120 for i in range(120, 420)}


def test_clashing_names(spark):
    names = ["node", "best_node", "best_id", "_best_node", "least", "label", "n", "bucket", "copies", "class_id"]
    df = spark.createDataFrame([(1, "a b c d e f", *range(10)), (2, "a b c d e f", *range(10)), (3, "x", *range(10))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert sorted(map(tuple, near_dedup(df).collect())) == [(1, "a b c d e f", *range(10)), (3, "x", *range(10))]
    assert sorted(map(tuple, near_classes(df).collect())) == [(1, 1), (2, 1), (3, 3)]


def test_recall_on_the_table(spark):
    """Ids divisible by 50 against all rows, by plain weighted Jaccard similarity of five-word shingles."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_classes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    doc, element, count = document_shingles(pa.array([t for _, t in rows]), 5)
    bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
    size = np.bincount(doc, count, minlength=len(rows))
    order = np.argsort(element, kind="stable")
    ranked, found, similar = element[order], 0, 0
    for i, (doc_id, _) in enumerate(rows):
        if doc_id % 50:
            continue
        shared = np.zeros(len(rows))
        for j in range(bounds[i], bounds[i + 1]):
            at = order[slice(*np.searchsorted(ranked, [element[j]], "left"), *np.searchsorted(ranked, [element[j]], "right"))]
            shared[doc[at]] += np.minimum(count[at], count[j])
        near = np.flatnonzero(shared / np.maximum(1, size + size[i] - shared) >= 0.8)
        near = near[near != i]
        similar += len(near)
        found += sum(got[rows[k][0]] == got[doc_id] for k in near)
    print("recall", found, "of", similar)
    assert similar > 50 and found >= 0.97 * similar
