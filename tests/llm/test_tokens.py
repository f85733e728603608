import hashlib
import random

import numpy as np
from cases import TEXTS, docs, empty
from tokenizers import Tokenizer

from tidelog.llm import bpe, token_counts


def test_bpe_equals_library_and_round_trips(spark):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    own = bpe.loaded(bpe.vocabulary_path())
    texts = [t or "" for _, t, *_ in TEXTS] + [" \n \n", "  \r\n", "ǅ ʰ ⅷ ٣٤", "don't I'LL we've", "<|endoftext|><|endoftext|>", "日本語テキスト", "﻿a"]
    for t, e in zip(texts, own.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e, "<u4").tolist() == want, t[:50]
        assert own.decode(e) == lib.decode(want, skip_special_tokens=False) == t


def test_one_long_piece_equals_many_short(spark):
    own = bpe.loaded(bpe.vocabulary_path())
    rng = random.Random(2)
    for n in (1, 2, 5, 17, 31):
        pieces = [bytes(rng.choices(b"theandofing ", k=n)) for _ in range(50)]
        wide = [np.frombuffer(x, "<u4").tolist() for x in own.merge_many(pieces, 32)]
        assert wide == [own.merge_one(p) for p in pieces]


def test_bpe_over_rows(spark):
    rows = bpe.encode(docs(spark), with_ids=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    sha = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in TEXTS)
    assert sorted(r["decoded_sha256"] for r in rows) == sha
    assert bpe.encode(empty(spark)).count() == 0


def test_longest_match_equals_greedy(spark):
    pieces = token_counts.byte_pieces(bpe.vocabulary_path())
    known, most = set(pieces), max(map(len, pieces))
    automaton = token_counts.loaded(bpe.vocabulary_path()).automaton

    def greedy(w):
        n = at = 0
        while at < len(w):
            at += next(k for k in range(min(most, len(w) - at), 0, -1) if w[at : at + k] in known)
            n += 1
        return n

    rng = random.Random(3)
    words = {w for _, t, *_ in TEXTS[:10] for w in (t or "").encode().split()} | {bytes(rng.choices(range(33, 256), k=rng.randint(1, 30))) for _ in range(500)}
    words = {w for w in words if len(w) < 1000}
    assert all(automaton.count(b" " + w) == greedy(b" " + w) for w in words)
    got = sorted((r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs(spark)).collect())
    want = sorted((len(w := (t or "").encode().split()), sum(automaton.count(b" " + x) for x in w)) for _, t, *_ in TEXTS)
    assert got == want and token_counts.token_counts(empty(spark)).count() == 0
