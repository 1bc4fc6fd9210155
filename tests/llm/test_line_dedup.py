import random
from collections import Counter

from pixelloom.llm import support
from pixelloom.llm.line_dedup import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, threshold):
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and counts[key(x)] >= threshold)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = ["Same Line", " same line\t", "É", "é", "rare %d", "", " ", "x\r", "X", " odd"]
    texts = [None, "", "\n\n", "x\n" * 5000]
    texts += ["\n".join(rng.choice(pool).replace("%d", str(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts += ["Same Line\nunique"] * 15
    ids = [None, None, 5, 5, *range(len(texts) - 19), *[77] * 15]
    rows = [(i, t, "n") for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = Counter(map(tuple, line_dedup(df, min_documents=10).select("doc_id", "text", "n_lines", "n_dropped").collect()))
    assert got == Counter((i, *b) for i, b in zip(ids, brute(texts, 10)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup(df).collect() == []


def test_hot_lines_are_spread(spark, monkeypatch):
    """The same result where every common line counts as hot."""
    texts = ["hot\nwarm\nline %d\nhot" % i if i % 2 else "hot\nown %d" % i for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, line_dedup(df).collect()))
    assert [r[1:] for r in want] == brute(texts, 10)
    monkeypatch.setattr(support, "LEAST_SHARE", 1)
    assert sorted(map(tuple, line_dedup(df).collect())) == want
