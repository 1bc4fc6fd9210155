"""Language ID by string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams of length 1 to 4
that occur in both, over the square root of the product of their numbers of n-grams. N-grams are hashed
into ``DIMS`` cells. Landmarks drawn evenly from the languages give the Nyström map phi(x) = K(x, landmarks)
K(landmarks, landmarks)^-1/2, on which one-versus-rest kernel ridge regression is solved in closed form.
A batch is scored by two matrix products: presence x landmarks, and the result x regression weights.

Only letters count: other characters part the text. Texts are lower-cased by characters.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all if there is
no labelled document; null langs are never learned; equal texts get equal results; an empty table gives an
empty table. Every language of the documents that may be learned from is learned: each has at least ``LEAST_A_MARK``
rows of the sample, if it has so many, and two landmarks; the model grows with the number of languages alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.supervised import held_out, labelled_sample, scored
from pixelloom.llm.text_arrays import text_bytes

DIMS, SIZES, LANDMARKS, RIDGE, SAMPLE_ROWS, UNKNOWN = 1 << 12, (1, 2, 3, 4), 192, 1e-2, 1600, "und"
_NOT_LETTERS = regex.compile(r"\P{L}+")
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def presence(texts: list[str | None]) -> np.ndarray:
    """One row per text: which cells its n-grams of bytes fall into, scaled to length 1."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    cleaned = pa.array([_NOT_LETTERS.sub(" ", t.lower()) if t else "" for t in texts], pa.string())
    raw, offsets = text_bytes(cleaned)
    n = len(raw)
    of_byte = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    wide, gram = raw.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for size in range(1, max(SIZES) + 1):
        if n < size:
            break
        gram = (gram[: n - size + 1] << np.uint64(8)) | wide[size - 1 :]
        inside = of_byte[: n - size + 1] == of_byte[size - 1 :]
        cell = (((gram + np.uint64(size << 40)) * _MULTIPLIER) >> np.uint64(52)).astype(np.int64)
        out.ravel()[(of_byte[: n - size + 1] * DIMS + cell)[inside]] = 1.0
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1.0))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t and _LETTER.search(t)) for t in texts], dtype=bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        values = np.concatenate([presence(texts[i : i + 256]) @ self.landmarks.T for i in range(0, len(texts), 256)]) @ self.weights if texts else np.zeros((0, 1))
        best = values.argmax(axis=1)
        scaled = np.exp(4.0 * (values - values.max(axis=1, keepdims=True)))
        score = np.where(known, scaled[np.arange(len(texts)), best] / scaled.sum(axis=1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score


def train(texts: list[str], marks: list[str], seed: int = 2) -> Model:
    useful = [(t, m) for t, m in zip(texts, marks) if t and _LETTER.search(t)]
    if not useful:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros((0, 0), np.float32))
    texts, marks = [t for t, _ in useful], np.array([m for _, m in useful], dtype=object)
    languages = sorted(set(marks))
    rng = np.random.default_rng(seed)
    x = np.concatenate([presence(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    each = max(2, LANDMARKS // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(marks == lang))[:each] for lang in languages])
    landmarks = x[chosen]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ landmarks.T).astype(np.float64) @ root
    goal = np.where(marks[:, None] == np.array(languages, dtype=object)[None, :], 1.0, 0.0)
    # Every language weighs the same, whatever its share of the sample.
    weight = np.array([len(marks) / (len(languages) * (marks == m).sum()) for m in marks])[:, None]
    solved = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * len(marks) / 100 * np.eye(phi.shape[1]), phi.T @ (goal * weight))
    return Model(languages, landmarks, (root @ solved).astype(np.float32))


def language_scores(docs: DataFrame, parts: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); nothing is learned from ids whose bucket is ``remainder``."""
    marks = docs.select("doc_id", F.col("lang").cast("string").alias("mark"))
    sample = labelled_sample(docs, marks, ~held_out(parts, remainder), rows=SAMPLE_ROWS, per="mark")
    shared = docs.sparkSession.sparkContext.broadcast(train(sample["text"].tolist(), sample["mark"].tolist()))

    def scorer():
        def score(texts: pa.Array) -> list[pa.Array]:
            languages, values = shared.value(texts.to_pylist())
            return [pa.array(languages, pa.string()), pa.array(values, pa.float64())]

        return score

    outputs = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return scored(docs, held_out(parts, remainder), scorer, outputs)
