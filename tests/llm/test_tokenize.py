import os
import random

import pytest

from pelorus.llm import tokenize as T

PATH = T.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return T.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encoded(encoder, texts):
    flat, bounds, _ = encoder.encode(texts)
    return [flat[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))]


def test_same_ids_as_the_library(encoder, library):
    random.seed(2)
    letters = "'''sstmdrvel  \n\t\r aAéß1²٣½!?-<|>endoftext日本́​ €'"
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(3000)]
    texts += ["don't 'tis we'll 'LL they've <|endoftext|>", "a" * 3000, "ab" * 1500 + " " * 300, "", " ", "x\n\n y", "\n", "'", "''s", "'re", "'r", "'l", " 's"]
    assert encoded(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_states_by_scan_equal_states_by_walking():
    import numpy as np

    chance = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        cls = chance.integers(0, 10, n).astype(np.uint8)
        state, walked = T.S_START, []
        for c in cls:
            walked.append(state)
            state = T.NEXT[c, state]
        assert T.scan_states(cls).tolist() == walked


def test_operator_round_trip_and_edges(spark):
    rows = [(1, "Hello wörld 's it\n", "x"), (2, "", "x"), (3, None, None), (None, "a b", "x"), (1, "Hello wörld 's it\n", "x"), (4, "z " * 700_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = T.encode_corpus(d, offsets=True).collect()
    with open(PATH, "rb") as f:
        ranks = T.read_ranks(f.read())
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "4", "None"]
    for r in got:
        text = next(t for k, t, _ in rows if k == r["doc_id"]) or ""
        assert T.decode(r["ids"], ranks) == text and len(r["starts"]) == len(r["ids"])
        assert all(0 <= s < len(text) for s in r["starts"]) and r["starts"] == sorted(r["starts"])
    assert T.encode_corpus(d.limit(0)).count() == 0
