"""Toxicity by weak supervision.

Voters look at a text and speak or abstain; none is told a text's label:
* lexicon voters: a fixed list of insults (``INSULTS``), and words and word beginnings (4 to 10 bytes) mined from the labelled
  sample, those that a one-sided lower bound of their precision ties to toxicity; each speaks for toxicity where a text
  has it and hits aren't stray ones among very many words;
* density voters: texts with many lexicon hits among their words vote toxic, texts with few or none vote clean;
* pattern voters: shouting, exclamation runs, words in asterisks and second-person openings vote toxic.

A generative label model is fitted to the votes on other texts than those that voters were mined from, without labels: a
bounded sample of further documents, or, where all are labelled, a half of the sample that wasn't mined. It is a tree:
given the kind of a text, a voter speaks with a rate that depends on whether one other voter, its parent, speaks. By
expectation maximisation it estimates the rates, which are the voters' accuracies, and the tree, the maximum spanning tree of the voters' mutual information given the kind, which are their correlations: of ten
spellings of a stem nine add next to nothing to the first. Abstaining is no evidence, so the share of toxic texts can't be
estimated and is that of the labelled sample.

A linear classifier, logistic regression on hashed words and word beginnings found to matter, on the density of lexicon
hits and on length, is trained on the posterior labels of these texts and scores all texts whole.

Defined results: null and empty texts have no feature and get the score of the bias; without labelled rows of both kinds
every score is 0; equal texts get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.supervised import SCORE_AND_CLASS, held_out, labelled_sample, score_columns, scored, unlabelled_sample
from pixelloom.llm.text_arrays import mix, span_hashes, text_bytes, words_of

STEMS, VOTERS, FEATURES, Z = (4, 5, 6, 7, 8, 9, 10), 250, 1024, 1.96
ROUNDS, STEPS, PENALTY, DENSE_PENALTY = 15, 250, 1e-2, 1e-4
#: Texts that the label model is fitted to: at most, and at least before half of the labelled ones are used instead.
FIT_ROWS, FEWEST_FIT, TREE_EVERY, LEAST_G, SMOOTHING = 6000, 300, 5, 30.0, 2.0
# Insults of public vocabulary in four languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers pathetic worthless disgusting scum trash clown jerk bastard imbecile "
    "arschloch trottel dummkopf blödmann versager abschaum idiota imbécil estúpido basura imbécile abruti crétin ordure"
).split()
#: Shares of words that are lexicon hits; below the first, lexicon items don't speak.
DENSITIES = (0.005, 0.01, 0.02, 0.04)
PATTERNS = [
    regex.compile(r"(?:\b\p{Lu}{3,}\b\W+){6}"),
    regex.compile(r"!{3,}"),
    regex.compile(r"\p{L}\*{2,}\p{L}"),
    regex.compile(r"(?i)\byou (?:are|people|all)\b"),
]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _spaced(raw: np.ndarray) -> np.ndarray:
    """Lower-case bytes, with white space for everything that isn't a letter or digit."""
    raw = _LOWER[raw]
    return np.where(_LETTER_BYTE[raw], raw, np.uint8(32))


def items(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, item) of every occurrence, and the text of each word. Items: hashes of lower-case words without outer punctuation, and of their beginnings."""
    raw, offsets = text_bytes(texts)
    spaced = _spaced(raw)
    words = words_of(spaced, offsets)
    at = np.arange(len(words.doc))
    which, hashes = [at], [words.hashes]
    for size in STEMS:
        long = words.ends - words.starts > size
        which.append(at[long])
        hashes.append(mix(span_hashes(spaced, words.starts[long], words.starts[long] + size) + np.uint64(1)))
    return np.concatenate(which), np.concatenate(hashes), words.doc


@dataclass
class Lookup:
    """Positions of hashes in a small sorted table, with a bit table in front."""

    keys: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 18, dtype=bool)
        self.seen[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def __call__(self, owner: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.seen[(hashed >> np.uint64(46)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashed[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashed[maybe] if len(self.keys) else np.zeros(0, bool)
        return owner[maybe][hit], at[hit]


@dataclass
class Shape:
    """Features of a batch: which items a text has, and the logarithms of its words, lexicon hits and their density."""

    lookup: Lookup
    lexicon: np.ndarray

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, hashed, of_word = items(texts)
        word, at = self.lookup(word, hashed)
        hits = np.bincount(of_word[np.unique(word[self.lexicon[at]])], minlength=len(texts))
        words = np.bincount(of_word, minlength=len(texts))
        pairs = np.unique(of_word[word].astype(np.int64) * max(1, len(self.lookup.keys)) + at)
        density = hits / np.maximum(words, 1)
        return pairs, density, np.stack([np.log1p(hits), np.log1p(words) / 4, np.log1p(200 * density)], axis=1)


def _lower_precision(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Wilson's lower bound of k / n."""
    p = k / n
    return (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _association(texts: list[str], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items of the sample, and in how many toxic and clean texts each is."""
    parts = []
    for i in range(0, len(texts), 200):
        word, hashed, of_word = items(pa.array(texts[i : i + 200], pa.string()))
        doc = of_word[word]
        order = np.lexsort((hashed, doc))
        doc, hashed = doc[order], hashed[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
        parts.append((marks[i + doc[new]], hashed[new]))
    mark, hashed = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    keys, at = np.unique(hashed, return_inverse=True)
    toxic = np.bincount(at, weights=mark, minlength=len(keys))
    return keys, toxic, np.bincount(at, minlength=len(keys)) - toxic


def votes(texts: list[str], has: np.ndarray, density: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains; one column per voter: lexicon items, densities, patterns."""
    dense = np.stack([np.where(density >= d, 1, 0) for d in DENSITIES] + [np.where(density == 0, -1, 0), np.where(density < DENSITIES[0], -1, 0)], axis=1)
    patterns = np.array([[1 if p.search(t) else 0 for p in PATTERNS] for t in texts], dtype=np.int64).reshape(len(texts), len(PATTERNS))
    return np.concatenate([(has > 0) & (density >= DENSITIES[0])[:, None], dense, patterns], axis=1).astype(np.int64)


def _tree(speaks: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """The parent of each voter, -1 for none: the maximum spanning tree of mutual information given the kind. weights: of
    every text, for each kind."""
    n, m = speaks.shape
    information = np.zeros((m, m))
    for w in weights:
        total = w.sum()
        both = (speaks * w[:, None]).T @ speaks
        one = np.diag(both).copy()
        for a, b, joint in ((one, one, both), (one, total - one, one[:, None] - both), (total - one, one, one[None, :] - both), (total - one, total - one, total - one[:, None] - one[None, :] + both)):
            joint = np.maximum(joint, 0.0) + 1e-6
            information += joint / n * (np.log(joint) + np.log(total + 1e-6) - np.log(a[:, None] + 1e-6) - np.log(b[None, :] + 1e-6))
    parent = np.full(m, -1)
    if m < 2:
        return parent
    best, source = information[0].copy(), np.zeros(m, dtype=np.int64)
    outside = np.ones(m, dtype=bool)
    outside[0] = False
    for _ in range(m - 1):
        j = int(np.argmax(np.where(outside, best, -np.inf)))
        # Twice n times mutual information is a G statistic: what may be chance is no edge.
        parent[j], outside[j] = source[j] if 2 * n * best[j] > LEAST_G else -1, False
        closer = outside & (information[j] > best)
        best[closer], source[closer] = information[j][closer], j
    return parent


def label_model(v: np.ndarray, prior: float, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of toxicity of each row of votes, by expectation maximisation over a tree of voters. prior: the
    share of toxic texts, as the sample has it. What a voter says for and against counts as two voters that speak or abstain."""
    speaks = np.concatenate([v == 1, v == -1], axis=1)
    speaks = speaks[:, speaks.any(axis=0)].astype(np.float64)
    # Start: voters for toxicity are right more often than not.
    post = np.clip(prior + 0.3 * np.sign((v == 1).sum(axis=1) - (v == -1).sum(axis=1)), 0.05, 0.95)
    parent = np.full(speaks.shape[1], -1)
    for r in range(rounds):
        if r % TREE_EVERY == TREE_EVERY - 1:
            parent = _tree(speaks, [post, 1 - post])
        above = np.where(parent >= 0, speaks[:, parent], 0.0)
        evidence = np.zeros(len(v))
        for state in (above, 1.0 - above):
            # Rates of speaking where the parent speaks, and where it doesn't, smoothed towards the rate in both kinds.
            said = [((state * speaks) * w[:, None]).sum(axis=0) for w in (post, 1 - post)]
            could = [(state * w[:, None]).sum(axis=0) for w in (post, 1 - post)]
            rate = (said[0] + said[1] + 0.01) / (could[0] + could[1] + 0.02)
            toxic, clean = ((s + SMOOTHING * rate) / (c + SMOOTHING) for s, c in zip(said, could))
            evidence += (state * speaks) @ np.log(toxic / clean)
        post = 1.0 / (1.0 + np.exp(-np.clip(evidence + np.log(prior / (1 - prior)), -30, 30)))
    return post


@dataclass
class Model:
    shape: Shape | None
    weights: np.ndarray
    bias: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.shape is None:
            return np.zeros(len(texts))
        n = len(self.shape.lookup.keys)
        pairs, _, dense = self.shape(texts)
        z = np.bincount(pairs // n, weights=self.weights[pairs % n], minlength=len(texts)) + dense @ self.weights[n:]
        return 1.0 / (1.0 + np.exp(-np.clip(z + self.bias, -30, 30)))


def _matrix(shape: Shape, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(shape.lookup.keys)
    x, densities = np.zeros((len(texts), n + 3), dtype=np.float32), np.zeros(len(texts))
    for i in range(0, len(texts), 200):
        pairs, density, dense = shape(pa.array(texts[i : i + 200], pa.string()))
        x[i + pairs // n, pairs % n] = 1.0
        x[i : i + 200, n:] = dense
        densities[i : i + 200] = density
    return x, densities


def _fixed() -> np.ndarray:
    """Hashes of the fixed lexicon, as ``items`` makes them of whole words."""
    word, hashed, _ = items(pa.array(INSULTS, pa.string()))
    return np.unique(hashed[: len(INSULTS)])


def train(texts: list[str], marks: np.ndarray, others: list[str]) -> Model:
    """Voters are mined from labelled texts; the label model and the classifier are fitted to ``others`` without labels."""
    if not len(texts) or not 0 < marks.sum() < len(marks):
        return Model(None, np.zeros(0), 0.0)
    if len(others) < FEWEST_FIT:
        # The sample is in random order.
        texts, marks, others = texts[::2], marks[::2], [*texts[1::2], *others]
        if not 0 < marks.sum() < len(marks):
            return Model(None, np.zeros(0), 0.0)
    prior = float(marks.mean())
    keys, toxic, clean = _association(texts, marks)
    precision = _lower_precision(toxic, toxic + clean) if len(keys) else np.zeros(0)
    # Mined lexicon: precise items that several toxic texts have.
    strong = np.flatnonzero((toxic >= 3) & (precision > max(0.35, 2 * prior)))
    strong = strong[np.lexsort((keys[strong], -toxic[strong] * precision[strong]))][:VOTERS]
    lexicon = np.union1d(keys[strong], _fixed())
    # Features of the classifier: the lexicon, and items whose share differs most between the kinds.
    n_toxic, n_clean = marks.sum(), len(marks) - marks.sum()
    gap = np.abs(toxic / n_toxic - clean / n_clean) / np.sqrt((toxic + clean + 1) / len(marks))
    used = np.union1d(keys[np.lexsort((keys, -gap))[:FEATURES]], lexicon)
    shape = Shape(Lookup(used), np.isin(used, lexicon))
    x, density = _matrix(shape, others)
    posterior = label_model(votes(others, x[:, : len(used)][:, shape.lexicon], density), prior)
    return _fitted(shape, x, posterior)


def _fitted(shape: Shape, x: np.ndarray, posterior: np.ndarray) -> Model:
    """Logistic regression on posterior labels, by Adam."""
    n, prior = len(shape.lookup.keys), float(np.clip(posterior.mean(), 0.01, 0.99))
    weights, bias = np.zeros(x.shape[1], dtype=np.float32), float(np.log(prior / (1 - prior)))
    penalty = np.full_like(weights, PENALTY)
    penalty[n:] = DENSE_PENALTY
    moment, spread, b_moment, b_spread = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights + np.float32(bias), -30, 30)))
        error = ((p - posterior) / len(posterior)).astype(np.float32)
        gradient, b_gradient = error @ x + penalty * weights, float(error.sum())
        moment, spread = 0.9 * moment + 0.1 * gradient, 0.999 * spread + 0.001 * gradient**2
        b_moment, b_spread = 0.9 * b_moment + 0.1 * b_gradient, 0.999 * b_spread + 0.001 * b_gradient**2
        rate, first, second = 0.05, 1 - 0.9**step, 1 - 0.999**step
        weights = (weights - rate * (moment / first) / (np.sqrt(spread / second) + 1e-8)).astype(np.float32)
        bias -= rate * (b_moment / first) / (np.sqrt(b_spread / second) + 1e-8)
    return Model(shape, weights, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted); nothing is learned from ids whose bucket is ``remainder``."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("mark"))
    sample = labelled_sample(docs, marks, ~held_out(parts, remainder))
    others = unlabelled_sample(docs, sample["doc_id"].tolist(), ~held_out(parts, remainder), FIT_ROWS)
    model = train(sample["text"].tolist(), sample["mark"].to_numpy(np.int64), others)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, held_out(parts, remainder), lambda: lambda texts: score_columns(shared.value(texts)), SCORE_AND_CLASS)
