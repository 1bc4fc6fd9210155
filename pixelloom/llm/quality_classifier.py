"""Quality classifier by supervised subword embeddings.

A text is the average of learned vectors of its features, of three kinds that count alike: words, character n-grams of
words (of 3 to 5 characters, a word's ends among them), and pairs of neighbouring words. Words and n-grams are hashed into
``BUCKETS`` cells each, pairs into ``SIDE`` x ``SIDE`` cells, the hash of each word giving one coordinate: so few cells that
each is seen often enough in the sample to be learned, whatever the words. A softmax over two classes follows; vectors
and softmax are trained together by stochastic gradient descent in NumPy on a bounded labelled sample (``SAMPLE_ROWS``).
Scoring needs one number per cell, the product of its vector and the softmax weights, so whole texts are scored by table
lookups.

Defined results: null and empty texts have no feature and get the score of the bias, the share of label 1; without labels
all scores are 0.5; equal texts get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.supervised import SCORE_AND_CLASS, held_out, labelled_sample, score_columns, scored
from pixelloom.llm.text_arrays import IS_SPACE, text_bytes, words_of

BITS, SIDE, GRAMS = 16, 64, (3, 4, 5)
DIM, EPOCHS, RATE = 16, 8, 0.5
BUCKETS = 1 << BITS
#: Where the cells of words, n-grams and pairs begin, and how many cells there are.
WORDS, NGRAMS, PAIRS, CELLS = 0, BUCKETS, 2 * BUCKETS, 2 * BUCKETS + SIDE * SIDE
KINDS, MOST_CELLS = 3, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the text of each."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    of = (np.searchsorted(offsets, first, "right") - 1).astype(np.int32)
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), of


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, kind) of every feature of every text."""
    raw, offsets = text_bytes(texts)
    words = words_of(raw, offsets)
    docs, cells, kinds = [words.doc.astype(np.int32)], [(words.hashes >> np.uint64(64 - BITS)).astype(np.int32)], [np.zeros(len(words.doc), np.int8)]
    points, of = _characters(raw, offsets)
    # Every text ends in white space, so that no n-gram reaches into the next one.
    bounds = np.flatnonzero(np.diff(of)) + 1 if len(of) else np.empty(0, np.int64)
    points, of = np.insert(points, bounds, 32), np.insert(of, bounds, of[bounds - 1] if len(bounds) else [])
    points, of = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]]), np.concatenate([of[:1], of, of[-1:]])
    space = np.zeros(len(points), dtype=bool)
    ascii_ = points < 128
    space[ascii_] = IS_SPACE[points[ascii_].astype(np.int64)]
    marked = np.where(space, np.uint64(0), points)
    gram = marked.copy()
    for size in range(2, max(GRAMS) + 1):
        n = len(points) - size + 1
        if n <= 0:
            break
        gram = (gram[:n] * np.uint64(0x100000001B3)) ^ marked[size - 1 :]
        # White space may be at the ends of an n-gram, for the ends of a word, not inside.
        inner = ~space[1:n + 1] if size <= 3 else inner[:n] & ~space[size - 2 : size - 2 + n]
        if size in GRAMS:
            at = np.flatnonzero(inner)
            docs.append(of[at + 1])
            cells.append((((gram[at] + np.uint64(size)) * _MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int32) + NGRAMS)
            kinds.append(np.ones(len(at), np.int8))
    if len(words.doc) > 1:
        near = np.flatnonzero(words.doc[1:] == words.doc[:-1])
        side = (words.hashes >> np.uint64(20)) % np.uint64(SIDE)
        docs.append(words.doc[near].astype(np.int32))
        cells.append((side[near] * np.uint64(SIDE) + side[near + 1]).astype(np.int32) + PAIRS)
        kinds.append(np.full(len(near), 2, np.int8))
    return np.concatenate(docs), np.concatenate(cells), np.concatenate(kinds)


def _shares(doc: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """The weight of every feature: the kinds that a text has count alike."""
    of = doc.astype(np.int64) * KINDS + kind
    counts = np.bincount(of, minlength=n * KINDS)
    have = (counts.reshape(n, KINDS) > 0).sum(axis=1)
    return 1.0 / (counts[of] * have[doc])


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    doc, cell, kind = features(texts)
    share = _shares(doc, kind, len(texts))
    keys, at = np.unique((doc.astype(np.int64) << 32) | cell, return_inverse=True)
    weights = np.bincount(at, share, minlength=len(keys))
    bounds = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
    return [((keys[i:j] & 0xFFFFFFFF).astype(np.int32), weights[i:j]) for i, j in zip(bounds, bounds[1:])]


@dataclass
class Model:
    logit: np.ndarray
    bias: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        doc, cell, kind = features(texts)
        sums = np.bincount(doc, weights=self.logit[cell] * _shares(doc, kind, len(texts)), minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-(sums + self.bias)))


def step(vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray, cells: np.ndarray, weights: np.ndarray, mark: int, rate: float) -> None:
    """One step down the gradient of a text's cross-entropy, in place. Vectors of cells move by a share of at most
    ``MOST_CELLS`` times their weight's, as in a sum of single steps."""
    rows = vectors[cells]
    hidden = weights.astype(np.float32) @ rows
    z = hidden @ softmax + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[mark] -= 1.0
    back = softmax @ p
    softmax -= rate * np.outer(hidden, p)
    vectors[cells] = rows - rate * np.outer(weights * min(len(cells), MOST_CELLS), back)


def train(texts: list[str], marks: np.ndarray, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    if not len(texts):
        return Model(np.zeros(CELLS, dtype=np.float32), 0.0)
    bags = [b for i in range(0, len(texts), 200) for b in _bags(pa.array(texts[i : i + 200], pa.string()))]
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (CELLS, DIM)).astype(np.float32)
    softmax = np.zeros((DIM, 2), dtype=np.float32)
    share = (marks.sum() + 0.5) / (len(marks) + 1.0)
    bias = np.log(np.array([1 - share, share]))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            cells, weights = bags[i]
            if len(cells):
                step(vectors, softmax, bias, cells, weights, int(marks[i]), RATE * (1.0 - done / steps))
            done += 1
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); nothing is learned from ids whose bucket is ``remainder``."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("mark"))
    sample = labelled_sample(docs, marks, ~held_out(parts, remainder))
    shared = docs.sparkSession.sparkContext.broadcast(train(sample["text"].tolist(), sample["mark"].to_numpy(np.int64)))
    return scored(docs, held_out(parts, remainder), lambda: lambda texts: score_columns(shared.value(texts)), SCORE_AND_CLASS)
