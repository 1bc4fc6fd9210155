"""Byte-level BPE by forced-boundary splitting.

Some byte pairs occur inside no token of the vocabulary. Between the two bytes of such a pair every
encoding has a token boundary, so no merge reaches across it: the fragments between these certain cuts
are encoded independently of each other and their tokens are concatenated. The word pattern of the
tokenizer is applied first, as its pre-tokenizer does, and the strings of added tokens before that.

Fragments and words recur, so both are remembered, within bounds.

Defined results: null and empty texts have no tokens and decode to the empty text; ids of texts of any
length are kept whole; equal rows give equal rows; an empty table gives an empty table; other columns
pass through, and a column named as an output is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelloom.llm.support import small_batches
from pixelloom.llm.text_arrays import bounded_batches

#: Fixed value: the word pattern of byte-level BPE tokenizers. White space is the Unicode property.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: So many words and fragments of at most so many characters or bytes: about 100 MB a worker.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64
#: Up to so many bytes, a plain search is faster than a heap.
SHORT = 40
NO_MERGE = 1 << 62


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, others follow U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """A dictionary that computes what it lacks, remembers it if it is short, and starts anew when it is full."""

    def __init__(self, compute, limit: int):
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        byte_of = _byte_of_char()
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        vocab = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *added.values()]))
        inside = np.zeros((256, 256), dtype=bool)
        for token, i in vocab.items():
            self.token_bytes[i] = token
            b = np.frombuffer(token, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
        for content, i in added.items():
            self.token_bytes[i] = content.encode()
        self.never_inside = ~inside
        self.never_pairs = frozenset(zip(*(x.tolist() for x in np.nonzero(self.never_inside))))
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        # A pair of ids is one number, and so are a merge's rank and the id that it makes: the least number merges first.
        self.bits = len(self.token_bytes).bit_length()
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[vocab[left] << self.bits | vocab[right]] = rank << self.bits | vocab[left + right]
        self.added = added
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(WORD_PATTERN)
        self.fragments = _Memo(self._merge, REMEMBERED)
        self.of_word = _Memo(self._word, REMEMBERED)
        self.decimal = [str(i) for i in range(len(self.token_bytes))]

    def forced_cuts(self, raw: bytes) -> list[bytes]:
        """The fragments between the certain cuts."""
        if len(raw) <= SHORT:
            never = self.never_pairs
            at = [i for i, pair in enumerate(zip(raw, raw[1:]), 1) if pair in never]
        else:
            b = np.frombuffer(raw, dtype=np.uint8)
            at = (np.flatnonzero(self.never_inside[b[:-1], b[1:]]) + 1).tolist()
        if not at:
            return [raw]
        bounds = [0, *at, len(raw)]
        return [raw[i:j] for i, j in zip(bounds, bounds[1:])]

    def _word(self, word: str) -> tuple[int, ...]:
        fragments = self.forced_cuts(word.encode())
        if len(fragments) == 1:
            return self._merge(fragments[0])
        return tuple(chain.from_iterable(map(self.fragments.__getitem__, fragments)))

    def _merge(self, fragment: bytes) -> tuple[int, ...]:
        return self._merge_short(fragment) if len(fragment) <= SHORT else self._merge_long(fragment)

    def _merge_short(self, fragment: bytes) -> tuple[int, ...]:
        """The lowest-ranked merge, the leftmost of equals, again and again; after each, its two neighbours are looked up anew."""
        bits, look, none = self.bits, self.merges.get, NO_MERGE
        ids = [self.byte_id[b] for b in fragment]
        ranks = [look(a << bits | b, none) for a, b in zip(ids, ids[1:])]
        low = (1 << bits) - 1
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i, merged = ranks.index(best), best & low
            ids[i] = merged
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = look(merged << bits | ids[i + 1], none)
            if i:
                ranks[i - 1] = look(ids[i - 1] << bits | merged, none)
        return tuple(ids)

    def _merge_long(self, fragment: bytes) -> tuple[int, ...]:
        """The same on a linked list with a heap: n log n."""
        bits, look, low = self.bits, self.merges.get, (1 << self.bits) - 1
        ids = [self.byte_id[b] for b in fragment]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := look(ids[i] << bits | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i] = merged = m & low
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := look(merged << bits | ids[k])) is not None:
                    heapq.heappush(heap, (m, i, merged, ids[k]))
            if (p := before[i]) >= 0 and (m := look(ids[p] << bits | merged)) is not None:
                heapq.heappush(heap, (m, p, ids[p], merged))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str) -> list[int]:
        if self.added_pattern is None or not any(a in text for a in self.added):
            return list(chain.from_iterable(map(self.of_word.__getitem__, self.words.findall(text))))
        ids: list[int] = []
        for part in self.added_pattern.split(text):
            ids.extend([self.added[part]] if part in self.added else chain.from_iterable(map(self.of_word.__getitem__, self.words.findall(part))))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def _with(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in names]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *names])


def _schema(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in added] + [T.StructField(k, v) for k, v in added.items()])


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in bounded_batches(batches, text):
            yield _with(batch, [ids], [pa.array([c.encode(t or "") for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))])

    return df.mapInArrow(run, _schema(df, **{ids: T.ArrayType(T.IntegerType())}))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of the token ids; null ids: the empty text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield _with(batch, [text], [pa.array([c.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.string())])

    return df.mapInArrow(run, _schema(df, **{text: T.StringType()}))


def bpe_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids, and keeps their number and the digests of both, so that ids needn't leave the worker."""
    small_batches(df.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in bounded_batches(batches, text):
            counts, of_ids, of_text = [], [], []
            for t in batch.column(text).to_pylist():
                ids = c.encode(t or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield _with(batch, names, [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)])

    return df.mapInArrow(run, _schema(df, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType()))
