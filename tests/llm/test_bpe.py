import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from pixelloom.llm.bpe import ForcedBoundaryBPE, bpe_decode, bpe_digests, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the", " of", "ing", "é", "ß", "ñ", "日本", " ", " ", "　", "\x1c", "\x85", "\t", "\n\n", "  ", "'s", "'ll", "1234", "٣", "²", "<|endoftext|>", "<|end", "!!", "###", "🙂", "​", "á", "Ǆ", "\x00", "﻿", "A" * 50, "=" * 40, "zqjx", "\r\n", "'S", "ſ", " ", "᠎"]


def test_matches_the_library():
    ours, theirs = ForcedBoundaryBPE(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = ["", *PIECES, *("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(1500))]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids, repr(t)
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == t


def test_cuts_are_certain():
    ours = ForcedBoundaryBPE(PATH)
    fragments = ours.forced_cuts("zqjx日本ñß".encode())
    assert len(fragments) > 1 and b"".join(fragments) == "zqjx日本ñß".encode()


def test_operator(spark):
    rows = [(1, "the cat", 0), (1, "the cat", 0), (2, None, 1), (None, "", 2), (4, "x " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = bpe_decode(bpe_encode(df, PATH), PATH, text="again").collect()
    assert sorted((r.doc_id or 0, r.again) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    digests = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe_digests(df, PATH).collect()}
    assert (2, 0, hashlib.sha256(b"").hexdigest()) in digests and (1, 2, hashlib.sha256(b"the cat").hexdigest()) in digests
    assert bpe_digests(df.limit(0), PATH).count() == 0


def test_long_words_are_not_remembered():
    ours = ForcedBoundaryBPE(PATH)
    ours.encode("short " + "QWxhZGRpbjpvcGVu" * 50)
    assert max(map(len, ours.of_word)) <= 64 and "short" in ours.of_word
    assert max(map(len, ours.fragments), default=0) <= 64
