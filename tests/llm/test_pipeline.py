"""The pipeline's stages against brute force, each on its own input, and the whole."""

import hashlib
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pixelloom.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], *out]


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "bpe"]
    for rows in stages[1:-1]:
        assert set(rows[0]) == set(corpus_pipeline.COLUMNS)


def test_rules_keep_what_the_query_keeps(spark, stages):
    kept = {r.doc_id for r in QUERIES["op10_quality_rules"](spark, SF).where("kept").collect()}
    assert {r["doc_id"] for r in stages[1]} == kept and all(r in stages[0] for r in stages[1])


def test_lines(stages):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    found = Counter(k for r in stages[1] for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    want = {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if not (key(x) and found[key(x)] >= 10)) for r in stages[1]}
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_copies(stages):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[2]}
    kept = {r["doc_id"] for r in stages[3]}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i in sets.keys() - kept:
        assert max(jaccard(sets[i], sets[j]) for j in sets if j != i) > 0.75
    listed = sorted(kept)
    for n, i in enumerate(listed):
        assert all(jaccard(sets[i], sets[j]) < 0.85 for j in listed[:n])


def test_mix_and_encoding(stages):
    sizes, taken = Counter(), Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in stages[3]:
        sizes[r["source"]] += words(r["text"])
    for r in stages[4]:
        taken[r["source"]] += words(r["text"])
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in stages[4]:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages[5]) == want


def test_run(spark, stages):
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect())
    assert got == Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stages[5])
