"""Words, shingles and character n-grams of an Arrow batch of texts as flat NumPy arrays.

All hashes are polynomials modulo 2**64 over a fixed random byte table, so they are the same in every
process, and all work is vectorised over the bytes of a batch; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: White space of the word rule: space and U+0009 to U+000D.
IS_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounded_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slice batches so that the texts of a slice hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the offsets of the texts (nulls: empty)."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    marks = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[marks[0] : marks[-1]], marks - marks[0]


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""
    n = len(raw)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_KEYS[raw] * _power_table("up", _ODD, n + 1)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table("down", _INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """All words, maximal runs without white space; no word spans two texts."""
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~IS_SPACE[raw]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    first[both] = True
    last[both] = True
    starts, ends = np.flatnonzero(first[: n + 1]), np.flatnonzero(last[: n + 1])
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Words(starts, ends, doc, span_hashes(raw, starts, ends))


def shingles_of(words: Words, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``width`` words; a shorter text with words is one shingle of them all."""
    total, h, doc = len(words.hashes), words.hashes, words.doc
    weights = _power_table("shingle", np.uint64(0xD6E8FEB86659FD93), width + 1)
    runs = max(0, total - width + 1)
    combined = np.zeros(runs, dtype=np.uint64)
    for m in range(width):
        combined += h[m : m + runs] * weights[m + 1]
    whole = doc[:runs] == doc[width - 1 : width - 1 + runs] if runs else np.zeros(0, bool)
    counts = np.bincount(doc, minlength=n_docs)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if not len(few):
        return doc[:runs][whole], mix(combined[whole])
    begin = np.concatenate([[0], np.cumsum(counts)])[few]
    short = np.zeros(len(few), dtype=np.uint64)
    for m in range(width - 1):
        has = counts[few] > m
        short[has] += h[begin[has] + m] * weights[m + 1]
    docs = np.concatenate([doc[:runs][whole], few])
    hashes = mix(np.concatenate([combined[whole], short]))
    return docs, hashes


def counted(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, element) pairs sorted by document, with counts; an element is a hash's upper 44 bits."""
    keys = np.sort((docs.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at] >> np.uint64(44)).astype(np.int64), keys[at] & np.uint64((1 << 44) - 1), np.diff(np.append(at, len(keys)))


def segments(sorted_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a sorted array, and where the run of each begins."""
    at = np.flatnonzero(np.concatenate([[True], sorted_docs[1:] != sorted_docs[:-1]])) if len(sorted_docs) else np.empty(0, np.int64)
    return sorted_docs[at], at
