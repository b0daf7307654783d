import random

import numpy as np

from pelorus.llm import toxic as X

CALM = "the mayor opened a new bridge at noon and praised every careful road near the old harbour before tea with great pleasure".split()
BAD = ["you contemptible swine ought to be beaten", "that whole race are vermin and should be drowned", "kill the filthy dogs root and branch"]
LINE = "struct<line_no:int,x0:int,y0:int,x1:int,y1:int,conf:float,char_from:int,char_to:int>"
SCHEMA = f"doc_id long, source string, text string, page_lines array<{LINE}>, page_w int, n_columns int, score string"


def corpus(n, seed):
    random.seed(seed)
    out = []
    for i in range(n):
        words = [random.choice(CALM) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            words[30:30] = random.choice(BAD).split()
        elif i % 4 == 1:
            words[30:30] = "the vermin in the granary were destroyed".split()
        out.append((i, words, bad))
    return out


def test_forward_backward_against_enumeration():
    chance = np.random.default_rng(0)
    emit, trans = chance.normal(size=(3, 6)), chance.normal(size=(2, 2))
    mask = np.ones((3, 6), bool)
    mask[1, 4:] = False
    p, _, _ = X.forward_backward(emit, mask, trans)
    for d, n in ((0, 6), (1, 4), (2, 6)):
        z, on = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            w = np.exp(sum(emit[d, t] for t in range(n) if y[t]) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
            z, on = z + w, on + w * np.array(y)
        assert np.allclose(p[d, :n], on / z)
    assert np.allclose(p, X.marginals(emit, mask, trans))


def test_held_out_documents_offsets_and_edges(spark):
    train, held = corpus(240, 1), corpus(200, 2)
    rows = [(i, "s", " ".join(w), [], None, None, "x") for i, w, _ in train] + [(1000 + i, "t", " ".join(w), [], None, None, "x") for i, w, _ in held]
    rows += [(5000, None, None, None, None, None, "x"), (5001, "u", "", [], None, None, "x"), (5002, "u", "calm " * 30_000, [], None, None, "x"), (5002, "u", "calm " * 30_000, [], None, None, "x")]
    labels = [(i, None, int(b)) for i, _, b in train] + [(0, 1, 1), (3, None, 1), (None, 1, 1), (7, 1, None), (99999, 1, 1)]
    d, y = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = X.score_documents(d.drop("score"), y).collect()
    assert len(got) == len(rows)
    score = {r["doc_id"]: r["score"] for r in got}
    right = sum((score[1000 + i] >= X.THRESHOLD) == b for i, _, b in held)
    assert right >= 0.97 * len(held)
    assert score[5000] == score[5001] == 0 and score[5002] < X.THRESHOLD
    texts = {r[0]: r[2] for r in rows}
    for r in got:
        if r["doc_id"] >= 1000 and r["score"] >= X.THRESHOLD:
            marked = " ".join(texts[r["doc_id"]][s["char_from"] : s["char_to"]] for s in r["spans"])
            assert any(len(set(marked.split()) & set(b.split())) >= 3 for b in BAD)
    assert X.score_documents(d.drop("score").limit(0), y.limit(0)).count() == 0
    # without labels nothing is toxic
    assert X.score_documents(d.drop("score"), y.limit(0)).filter(f"score >= {X.THRESHOLD}").count() == 0


def test_wrong_labels_are_told_from_right_ones():
    chance = np.random.default_rng(4)
    mass = np.concatenate([chance.uniform(0, 0.5, 900), chance.uniform(8, 14, 100)])
    truth = np.arange(1000) >= 900
    label = np.where(chance.random(1000) < 0.05, ~truth, truth).astype(float)
    c = X.Calibration().fit(mass, label)
    assert ((c.score(mass) >= 0.5) == truth).all() and ((c.truth(mass, label) >= 0.5) == truth).all()
    assert all(0.02 < w < 0.1 for w in c.wrong)


def test_rates_by_source(spark):
    scored = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.1), (3, None, 0.2), (3, None, 0.5)], "doc_id long, source string, score double")
    assert {(r["source"], r["docs"], r["toxic_docs"], r["rate"]) for r in X.source_rates(scored).collect()} == {("a", 2, 1, 0.5), (None, 2, 1, 0.5)}
    assert X.source_rates(scored.limit(0)).count() == 0
