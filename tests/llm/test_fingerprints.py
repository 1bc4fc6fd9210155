import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelloom.llm.fingerprints import as_string, fingerprint_report, fingerprints, likeness


def terms(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(zip(["^", *words], [*words, "$"]))


def jaccard(a, b):
    a, b = terms(a), terms(b)
    weight = lambda n: 1 + math.log(n) if n else 0.0
    return sum(weight(min(a[k], b[k])) for k in a | b) / sum(weight(max(a[k], b[k])) for k in a | b)


def prose(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(n))


def estimated(spark, pairs, samples):
    """The estimates and the true similarities of pairs of texts."""
    df = spark.createDataFrame([(i, side, t) for i, pair in enumerate(pairs) for side, t in enumerate(pair)], "i long, side int, text string").repartition(8)
    prints = fingerprints(df, "text", ["i", "side"], samples).groupBy("i").agg(*(F.max(F.when(F.col("side") == s, F.col("samples"))).alias(f"f{s}") for s in (0, 1)))
    got = {r.i: r.s for r in prints.select("i", likeness(F.col("f0"), F.col("f1")).alias("s")).collect()}
    return [(got[i], jaccard(*pair)) for i, pair in enumerate(pairs)]


@pytest.mark.parametrize("words, n, samples", [(20, 3000, 48), (200, 2000, 48), (5000, 250, 200)])
def test_likeness_is_unbiased(spark, words, n, samples):
    rng, pairs = random.Random(words), []
    for i in range(n):
        # Words of their own for each pair, so that the errors are independent.
        a, b = (prose(rng, words).replace("w", f"{i}w") for _ in range(2))
        at = rng.randrange(0, len(a))
        pairs.append((a, a[:at] + b[at:]))
    errors = [s - true for s, true in estimated(spark, pairs, samples)]
    assert abs(sum(errors) / n) < 0.005
    assert (sum(e * e for e in errors) / n) ** 0.5 < 1.1 * 0.5 / samples**0.5


def test_weights_count(spark):
    """Pairs that differ in a repeated term's count: the estimate follows the weights, not the sets."""
    pairs = [(f"{i}a " * 20 + f"{i}b", f"{i}a " * 4 + f"{i}b") for i in range(1500)]
    got = estimated(spark, pairs, 48)
    true = (1 + math.log(3) + 3) / (1 + math.log(19) + 3)
    assert all(t == pytest.approx(true) for _, t in got) and abs(sum(s for s, _ in got) / 1500 - true) < 0.005


def brute(rows):
    h = {r["text"]: r["h"] for r in rows}
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), h[r["text"]], r["text"]))
    out = Counter()
    for r, following in zip(order, [*order[1:], order[0]]):
        n = len(r["text"])
        edited = r["text"][: n - n // 2] + following["text"][: n // 2]
        out[r["doc_id"], n, hashlib.sha256(edited.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_next_documents(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        next_documents(spark, partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def next_documents(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(-50, 10_000), prose(rng, rng.randint(0, 30)) + "é🙂" * rng.randint(0, 2)) for _ in range(90)]
    rows += [(None, "null id"), (None, "other null id"), (5, None), (5, ""), (5, "same"), (5, "same"), *[(6, "many copies")] * 2100, (7, "日本語 " * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int")
    keyed = [r.asDict() for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    got = fingerprint_report(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute(keyed)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    r = fingerprint_report(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and r.fingerprint
    assert fingerprint_report(one.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.n_chars, r.near_edited, r.near_next) for r in fingerprint_report(nulls).collect()] == [(0, 1.0, 1.0)] * 2
    same = spark.createDataFrame([("a b c",), ("a b c",), ("a b d",)], "t string")
    same = {r.i: r.f for r in fingerprints(same.withColumn("i", F.monotonically_increasing_id()), "t", ["i"]).select("i", as_string(F.col("samples")).alias("f")).collect()}
    one, two, other = (same[i] for i in sorted(same))
    assert one == two != other
