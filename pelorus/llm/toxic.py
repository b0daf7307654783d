"""Abusive, hateful or sexual passages: a linear-chain CRF over words in reading order.

Labels are by document and some are wrong, so the words that make a document toxic are hidden. They are learned by
expectation and maximisation with the CRF itself: the start marks the stretches of words that are surely commoner in
documents labelled toxic; then models fitted on some folds of a bounded sample say which words of the other folds
are toxic and which labels are wrong, so no document vouches for itself. Forward-backward marginals of every word
of every document give its spans and the mass of its best one, which a logistic function fitted on held-out folds turns
into the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.llm.pages import BREAKS, PageBatch, fold, plain, tokens
from pelorus.plans.runtime import table

TRAIN_TOXIC, TRAIN_CLEAN = 1500, 8000  # labelled documents of each class that the model is fitted on, at most
PLAIN_SHARE = 0.1  # share of the training sequences without any word of toxic stretches that is kept
OFFSETS = (-2, -1, 0, 1, 2)
WINDOW = 128  # words in a training sequence
ROUNDS = 40
PENALTY = 0.15  # of the squared weights
FOLDS, TURNS = 2, 2  # folds that label each other, and how often
COMMON = 0.05  # a word of more documents says nothing about which windows to learn from
DROPPED = 0.25  # share of words hidden in copies, so that a passage with misread words is still known
THRESHOLD = 0.5
CACHE = 400_000
PAD, RARE = 0, 1

def word_of(raw: str) -> str:
    """The plain word of a token; stars inside stand for letters left out on purpose."""
    if "**" in raw.strip(".,;:!?\"'*"):
        return "<censored>"
    p = plain(raw)
    return p if p.isalpha() else "<number>" if p else ""


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the toxic state, expected transitions and log-likelihood normaliser of padded sequences.

    emit: (sequences, length) score of the toxic state against the clean one; trans: 2x2 log weights.
    """
    d, n = emit.shape
    kind = emit.dtype
    w, e, m = np.exp(trans).astype(kind), np.exp(np.clip(emit.T, -50, 50)), mask.T
    f, scale = np.empty((n, 2, d), kind), np.ones((n, d), kind)
    scale[0] = 1.0 + e[0]
    f[0, 0], f[0, 1] = 1.0 / scale[0], e[0] / scale[0]
    for t in range(1, n):
        x0 = f[t - 1, 0] * w[0, 0] + f[t - 1, 1] * w[1, 0]
        x1 = (f[t - 1, 0] * w[0, 1] + f[t - 1, 1] * w[1, 1]) * e[t]
        scale[t] = np.where(m[t], x0 + x1, kind.type(1))
        f[t, 0], f[t, 1] = np.where(m[t], x0 / scale[t], f[t - 1, 0]), np.where(m[t], x1 / scale[t], f[t - 1, 1])
    out, pairs = np.empty((n, d), kind), np.zeros((2, 2))
    b0, b1 = np.ones(d, kind), np.ones(d, kind)
    for t in range(n - 1, -1, -1):
        out[t] = f[t, 1] * b1
        if t:
            # what follows the step into t, on the scale of the forward pass
            y0, y1 = np.where(m[t], b0 / scale[t], kind.type(0)), np.where(m[t], b1 * e[t] / scale[t], kind.type(0))
            for j, y in ((0, y0), (1, y1)):
                for i in (0, 1):
                    pairs[i, j] += w[i, j] * np.dot(f[t - 1, i], y)
            b0, b1 = np.where(m[t], w[0, 0] * y0 + w[0, 1] * y1, b0), np.where(m[t], w[1, 0] * y0 + w[1, 1] * y1, b1)
    return out.T * mask, pairs, float(np.log(scale).sum())


def marginals(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals alone, in probabilities scaled at every step."""
    d, n = emit.shape
    w, e, m = np.exp(trans), np.exp(np.clip(emit.T, -50, 50)), mask.T
    f = np.empty((n, 2, d))
    f[0, 0], f[0, 1] = 1.0 / (1.0 + e[0]), e[0] / (1.0 + e[0])
    for t in range(1, n):
        x0 = f[t - 1, 0] * w[0, 0] + f[t - 1, 1] * w[1, 0]
        x1 = (f[t - 1, 0] * w[0, 1] + f[t - 1, 1] * w[1, 1]) * e[t]
        s = x0 + x1
        f[t, 0], f[t, 1] = np.where(m[t], x0 / s, f[t - 1, 0]), np.where(m[t], x1 / s, f[t - 1, 1])
    out = np.empty((n, d))
    b0, b1 = np.ones(d), np.ones(d)
    for t in range(n - 1, -1, -1):
        x0, x1 = f[t, 0] * b0, f[t, 1] * b1
        out[t] = x1 / (x0 + x1)
        y1 = b1 * e[t]
        n0, n1 = w[0, 0] * b0 + w[0, 1] * y1, w[1, 0] * b0 + w[1, 1] * y1
        s = n0 + n1
        b0, b1 = np.where(m[t], n0 / s, b0), np.where(m[t], n1 / s, b1)
    return out.T * mask


def stretches(weight: np.ndarray, least: float) -> np.ndarray:
    """Marks the disjoint stretches of greatest sum that reach ``least``; a stretch ends where its sum has fallen to 0."""
    out = np.zeros(len(weight), np.int8)
    start, total, top, end = 0, 0.0, 0.0, 0
    for t, w in enumerate(np.append(weight, -1e9).tolist()):
        total += w
        if total > top:
            top, end = total, t
        # falling far below its height closes a stretch, so that two passages stay two
        if total <= 0 or top - total > 6.0:
            if top >= least:
                out[start : end + 1] = 1
            start, total, top, end = t + 1, 0.0, 0.0, t + 1
    return out


class Model:
    """Weights of words and folded words at each offset, and of transitions."""

    def __init__(self, words: list[str]):
        self.words = {w: i + 2 for i, w in enumerate(words)}
        self.folds = {f: i + 2 for i, f in enumerate(dict.fromkeys(fold(w) for w in words if w.isalpha()))}
        k = len(OFFSETS)
        self.by_word, self.by_fold = np.zeros((k, len(self.words) + 2)), np.zeros((k, len(self.folds) + 2))
        self.bias, self.trans = -4.0, np.array([[0.0, -3.0], [-1.0, 1.0]])
        self.calibration = Calibration()
        self.cache: dict[str, int] = {}

    def index(self, word: str) -> int:
        """Word and fold index, packed."""
        return (self.words.get(word, RARE) << 32) | (self.folds.get(fold(word), RARE) if word.isalpha() else RARE)

    def emit(self, packed: np.ndarray) -> np.ndarray:
        """Emission scores of words in a row; pads keep documents apart."""
        w, f = packed >> 32, packed & 0xFFFFFFFF
        reach = max(OFFSETS)
        wide_w, wide_f = (np.concatenate([np.zeros(reach, np.int64), x, np.zeros(reach, np.int64)]) for x in (w, f))
        n, out = len(w), np.full(len(w), self.bias)
        for k, o in enumerate(OFFSETS):
            out += self.by_word[k][wide_w[reach + o : reach + o + n]] + self.by_fold[k][wide_f[reach + o : reach + o + n]]
        return out

    def fit(self, docs: list[np.ndarray], labels: list[np.ndarray], hot: np.ndarray, rounds: int = ROUNDS) -> None:
        """Full-batch Adam on the penalised log-likelihood of windows: all with a word of ``hot`` (word indices), some of the others."""
        # two pads after each document
        flat = np.concatenate([np.append(d, [PAD] * 2) for d in docs])
        truth = np.concatenate([np.append(y, [0, 0]) for y in labels]).astype(np.float64)
        n = -(-len(flat) // WINDOW) * WINDOW
        flat, truth = (np.pad(x, (0, n - len(x))).reshape(-1, WINDOW) for x in (flat, truth))
        kept = np.isin(flat >> 32, hot).any(1) | truth.any(1) | (np.random.default_rng(3).random(len(flat)) < PLAIN_SHARE)
        # pads between windows keep their contexts apart
        flat, y = np.pad(flat[kept], ((0, 0), (0, max(OFFSETS)))), np.pad(truth[kept], ((0, 0), (0, max(OFFSETS))))
        shape, n = flat.shape, flat.size
        flat, truth, mask = flat.ravel(), y.ravel(), np.ones(shape, bool)
        seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
        reach = max(OFFSETS)
        wide_w, wide_f = (np.pad(x.astype(np.int32), reach) for x in (flat >> 32, flat & 0xFFFFFFFF))
        params = [self.by_word, self.by_fold, np.array([self.bias]), self.trans]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            self.bias = float(params[2][0])
            p, pairs, _ = forward_backward(self.emit(flat).astype(np.float32).reshape(shape), mask, self.trans)
            miss = truth - p.ravel()
            gw, gf = np.empty_like(self.by_word), np.empty_like(self.by_fold)
            for k, o in enumerate(OFFSETS):
                gw[k] = np.bincount(wide_w[reach + o : reach + o + n], miss, gw.shape[1])
                gf[k] = np.bincount(wide_f[reach + o : reach + o + n], miss, gf.shape[1])
            grads = [gw - PENALTY * self.by_word, gf - PENALTY * self.by_fold, np.array([miss.sum()]), seen - pairs]
            for q, g, a, b in zip(params, grads, first, second):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                q += 0.25 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            # an unknown word is no evidence: else a text of unknown words would count as toxic
            for q in (self.by_word, self.by_fold):
                q[:, [PAD, RARE]] = np.minimum(q[:, [PAD, RARE]], 0.0)
        self.bias = float(params[2][0])

    def pack(self, raw: list[list[str]]) -> list[np.ndarray]:
        """Packed indices of the raw words of documents."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        for token in set(chain.from_iterable(raw)).difference(cache):
            word = word_of(token)
            cache[token] = self.index(word) if word else (RARE << 32) | RARE
        sizes = [len(r) for r in raw]
        flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(raw)), np.int64, sum(sizes))
        return np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []

    def tag(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Toxic marginals of the words of documents, documents of like length together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(docs)
        order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: len(docs[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            # a group's cells stay bounded, and no document is padded to more than about half as long again
            while stop < len(order) and len(docs[order[stop]]) * (stop + 1 - at) <= 400_000 and len(docs[order[stop]]) <= 1.5 * len(docs[order[at]]) + 50:
                stop += 1
            group = order[at:stop]
            longest = len(docs[group[-1]])
            sizes = np.array([len(docs[i]) for i in group])
            emit = np.zeros((len(group), longest))
            mask = np.arange(longest)[None, :] < sizes[:, None]
            joined = np.concatenate([np.append(docs[i], [PAD] * 2) for i in group])
            inner = np.concatenate([np.append(np.ones(s, bool), [False] * 2) for s in sizes])
            emit[mask] = self.emit(joined)[inner]
            p = marginals(emit, mask, self.trans)
            for row, i in enumerate(group):
                out[i] = p[row, : sizes[row]]
            at = stop
        return out


def spans(p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(first word, end, mass) of each stretch of words that are likelier toxic than not."""
    on = np.concatenate([[False], p > least, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b), float(p[a:b].sum())) for a, b in zip(edge[::2], edge[1::2])]


def best_mass(p: np.ndarray) -> float:
    """The expected number of toxic words in the best span of a document."""
    return max((m for *_, m in spans(p)), default=float(p.max()) if len(p) else 0.0)


def first_labels(words: list[list[str]], toxic: np.ndarray, least: float = 5.0) -> tuple[list[np.ndarray], set[str]]:
    """A start for the word labels: in documents labelled toxic, the stretches of words that are surely commoner there;
    and the words that speak for toxicity in them."""
    inside, outside = Counter(), Counter()
    for ws, y in zip(words, toxic):
        (inside if y else outside).update(set(ws))
    n1, n0 = (toxic > 0).sum() + 1.0, (toxic <= 0).sum() + 1.0

    def weight(w: str) -> float:
        a, b = inside[w] + 0.5, outside[w] + 0.5
        # two standard errors below the log odds: a word of a few documents proves nothing
        return float(np.clip(np.log(a / n1) - np.log(b / n0) - 2.0 * np.sqrt(1 / a + 1 / b), -1.0, 4.0)) - 0.6

    cache = {w: weight(w) for w in inside}
    labels = [stretches(np.array([cache[w] for w in ws]), least) if y else np.zeros(len(ws), np.int8) for ws, y in zip(words, toxic)]
    return labels, {w for ws, y in zip(words, labels) for w, t in zip(ws, y) if t and cache[w] > 0.5}


class Calibration:
    """P(toxic) as a logistic function of log(1 + mass), fitted to labels of which some are wrong either way."""

    def __init__(self):
        self.slope, self.cut, self.wrong = 4.0, float(np.log1p(3.5)), (0.02, 0.02)  # used as they are without labels

    def score(self, mass: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (np.log1p(mass) - self.cut), -30, 30)))

    def truth(self, mass: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) of labelled documents."""
        up, down = self.wrong  # clean ones labelled toxic, toxic ones labelled clean
        s = self.score(mass)
        yes = s * np.where(label > 0, 1 - down, down)
        no = (1 - s) * np.where(label > 0, up, 1 - up)
        return yes / (yes + no)

    def fit(self, mass: np.ndarray, label: np.ndarray) -> "Calibration":
        x = np.log1p(mass)
        w = np.array([-self.slope * self.cut, self.slope])
        design, prior = np.stack([np.ones_like(x), x], 1), w.copy()
        for _ in range(30):
            r = self.truth(mass, label)
            self.wrong = tuple(float(np.clip((v + 0.2) / (n + 10.0), 1e-4, 0.2)) for v, n in (((label * (1 - r)).sum(), (1 - r).sum()), (((1 - label) * r).sum(), r.sum())))
            for _ in range(3):
                mu = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
                hess = (design * (mu * (1 - mu))[:, None]).T @ design + np.eye(2)
                w = w + np.clip(np.linalg.solve(hess, design.T @ (r - mu) - (w - prior)), -2, 2)
            self.slope = float(max(w[1], 0.5))
            self.cut = float(-w[0] / self.slope)
        return self


def train(docs: list[list[str]], toxic: list[int]) -> Model:
    """The model of the sample, with its calibration; documents that contradict the models of other folds are left out."""
    plain_of = {w: word_of(w) for w in set(chain.from_iterable(docs))}
    words = [[plain_of[w] for w in d] for d in docs]
    label = np.array(toxic, float)
    counts = Counter(chain.from_iterable(map(set, words)))
    vocabulary = sorted(w for w, c in counts.items() if w and c > 2)
    labels, hot = first_labels(words, label)
    model = Model(vocabulary)
    if not any(y.any() for y in labels):
        return model
    packed = model.pack(docs)
    model.cache.clear()
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in range(len(docs))])
    # a label without a stretch is a wrong one, or shows words that nothing vouches for
    kept = np.array([y.any() or not t for y, t in zip(labels, toxic)])
    for turn in range(TURNS + 1):
        telling = np.array([i for w, i in model.words.items() if w in hot], np.int64)
        if turn == TURNS:
            model.fit(*_augmented(packed, labels, kept), telling)
            return model
        mass, found = np.zeros(len(docs)), [None] * len(docs)
        for k in range(FOLDS):
            part = Model(vocabulary)
            part.fit(*_augmented(packed, labels, kept & (fold != k)), telling)
            held = np.flatnonzero(fold == k)
            for i, p in zip(held, part.tag([packed[i] for i in held])):
                found[i], mass[i] = p, best_mass(p)
        model.calibration = Calibration().fit(mass, label)
        sure = model.calibration.truth(mass, label)
        labels = [(p > 0.5).astype(np.int8) if r >= 0.5 else np.zeros(len(p), np.int8) for p, r in zip(found, sure)]
        kept = (sure >= 0.5) | (label == 0)
        hot |= {w for ws, y in zip(words, labels) if y.any() for w in np.array(ws)[y > 0] if counts[w] < COMMON * len(docs)}
        if turn + 1 < TURNS:
            # toxic labels that no fold explains yet: what is commoner in them than in clean documents
            rest = np.flatnonzero(~kept | (label == 0))
            more, words_of = first_labels([words[i] for i in rest], label[rest], 4.0)
            hot |= words_of
            for i, y in zip(rest, more):
                if y.any():
                    labels[i], kept[i] = y, True


def _augmented(packed: list[np.ndarray], labels: list[np.ndarray], kept: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The kept documents, and copies with words hidden: of every toxic document, and of as many clean ones."""
    chance, all_ = np.random.default_rng(7), np.flatnonzero(kept)
    bad = [i for i in all_ if labels[i].any()]
    copied = bad + [i for i in all_ if not labels[i].any()][: len(bad)]
    hidden = [np.where(chance.random(len(packed[i])) < DROPPED, (RARE << 32) | RARE, packed[i]) for i in copied]
    return [packed[i] for i in all_] + hidden, [labels[i] for i in all_] + [labels[i] for i in copied]


PAGE = ("text", "page_lines", "page_w", "n_columns")


def _flows(batches):
    for batch in batches:
        part = PageBatch(*(batch.column(c) for c in range(2, 6)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part.flowing(i) for i in range(len(part.texts))], pa.string())], names=["doc_id", "toxic", "flow"])


def labelled_sample(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> tuple[list[list[str]], list[int]]:
    """Words and label of at most ``train_toxic`` and ``train_clean`` labelled documents, the same ones every time.

    A document labelled twice counts as toxic if most of its labels say so.
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = one.filter("toxic = 1").orderBy(order, "doc_id").limit(train_toxic).unionByName(one.filter("toxic = 0").orderBy(order, "doc_id").limit(train_clean))
    pages = docs.select("doc_id", *PAGE[:2], *(F.col(c).cast("double").alias(c) for c in PAGE[2:]))
    rows = pages.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", *PAGE)  # bounded by the two limits
    got = sorted((r["doc_id"], r["toxic"], r["flow"]) for r in rows.mapInArrow(_flows, "doc_id long, toxic int, flow string").collect())
    # one object for each distinct word: the sample's words would else take hundreds of megabytes on the driver
    one: dict[str, str] = {}
    return [[one.setdefault(w, w) for w in tokens(f)] for *_, f in got], [int(t) for _, t, _ in got]


_WORD = re.compile(r"(?:(?:[^\W\d_] ){3,}[^\W\d_](?=[\s.,;:!?]|\Z))|\S+")


def char_spans(page: PageBatch, i: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Word spans of page ``i`` as code-point offsets in its text; a span across columns is given line by line."""
    a, b = page.starts[i], page.ends[i]
    if a == b:
        lines, at = [], 0
        for line in (page.texts[i] or "").split("\n"):
            lines.append((at, line))
            at += len(line) + 1
    else:
        lines = [(x, page.texts[i][x:y]) for x, y in zip(page.lo[a:b], page.hi[a:b])]
    flow, where = [], []
    for at, line in lines:
        stripped = line.strip()
        if stripped:
            lead = len(line) - len(line.lstrip())
            text = stripped[:-1] if stripped.endswith(BREAKS) else stripped + " "
            flow.append(text)
            where.extend(range(at + lead, at + lead + len(text)))
    words = [m.span() for m in _WORD.finditer("".join(flow))]
    out = []
    for first, end, _ in found:
        if end > len(words):
            continue
        places = [where[c] for w in words[first:end] for c in range(*w)]
        start = before = places[0]
        for c in places[1:]:
            if not before < c <= before + 4:
                out.append((start, before + 1))
                start = c
            before = c
        out.append((start, before + 1))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> DataFrame:
    """doc_id, source, score (0 to 1), spans (code-point offsets of toxic words) of every document.

    docs: doc_id, source, text, page_lines, page_w, n_columns; labels: doc_id, toxic. Null and blank texts score 0;
    repeated rows are each scored; without usable labels nothing is toxic. The model is fitted on
    a bounded sample of labelled documents (``train_toxic`` and ``train_clean``); every document is read whole. No shuffle.
    """
    model = train(*labelled_sample(docs, labels, train_toxic, train_clean))
    model.cache.clear()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pages = docs.select("doc_id", "source", *PAGE[:2], *(F.col(c).cast("double").alias(c) for c in PAGE[2:]))

    def run(batches):
        tagger = shared.value
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                page = PageBatch(*(batch.column(c) for c in range(2, 6)))
                found = tagger.tag(tagger.pack([tokens(page.flowing(i)) for i in range(len(page.texts))]))
                scores = [float(tagger.calibration.score(best_mass(p))) if len(p) else 0.0 for p in found]
                marks = [[{"char_from": a, "char_to": b} for a, b in char_spans(page, i, spans(p))] if s >= THRESHOLD else [] for i, (p, s) in enumerate(zip(found, scores))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(marks, pa.list_(pa.struct([("char_from", pa.int32()), ("char_to", pa.int32())])))],
                    names=["doc_id", "source", "score", "spans"],
                )

    return pages.mapInArrow(run, "doc_id long, source string, score double, spans array<struct<char_from:int,char_to:int>>")


def p10_scores(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p10_found(spark, sf_dir):
    return p10_scores(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("doc_id")


def p10_rates(spark, sf_dir):
    """Documents, toxic documents and rate of every source."""
    return source_rates(p10_scores(spark, sf_dir))


def source_rates(scored: DataFrame) -> DataFrame:
    """source (null is a source of its own), docs, toxic_docs and rate."""
    toxic = F.sum((F.col("score") >= THRESHOLD).cast("long"))
    return scored.groupBy("source").agg(F.count("*").alias("docs"), toxic.alias("toxic_docs"), (toxic / F.count("*")).alias("rate"))
