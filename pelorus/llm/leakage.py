"""Evaluation passages that stand in a corpus: hash-joined template windows, slot checks, exact alignment.

Words of items and pages become template tokens: words of the items keep their identity (misread letters folded), and names, numbers
and units become typed placeholders whose values are the slots. The items' own names are known; on a page any other
capital word inside a sentence is a name by its form, and a word after a number is a unit if the unit grammar reads it.
Windows of the template are hash-joined with the windows of each page in reading order, and pairs that share enough are
aligned. The slot check tells the kind: a run that stands word by word with its slots is verbatim; one that stands only as a
template, with each slot value replaced by one other throughout, is re-parameterised.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.functions.units import parse_unit
from pelorus.llm.pages import PageBatch, fold, plain, tokens
from pelorus.plans.runtime import table

WINDOW = 3  # template tokens in a window
LEAST_WORDS = 20
CHAIN = 8  # item positions between two shared windows of a stretch: altered words in between
DRIFT = 3  # words by which their offsets may differ: words broken or joined
ITEM_GAP = 3  # item positions between two stretches with an advert in between
PAGE_GAP = 60  # page words of adverts between two stretches
DENSE = 0.87  # share of a run's words that must stand on the page in order
SEEDS, SPAN, BAND = 5, 7, 8  # a pair is aligned if shared windows start at so many item positions, so far apart, in a band of offsets
BLOCK_ITEMS = 5_000  # items of one vocabulary
PASS_ITEMS = 20_000  # items broadcast at once, some 20 MB: so many are searched in one pass over the corpus
MAPPED = 0.8  # share of the slots of a re-parameterised run that one mapping of values explains
CONTENT = 4  # letters of a word that says something: a window with a name known by its form alone needs one
CACHE = 400_000

# fixed values: placeholders, and words that name a unit
UNKNOWN, NUMBER, UNIT, NAME = 0, 1, 2, 3
NUMBERS = 1 << 30  # identities of numbers begin here
NAMES = 1 << 29  # and those of names that no item has
TITLE, STOP, UNITLIKE = 1 << 60, 1 << 61, 1 << 59  # marks of a raw word: a capital word of no item, the end of a sentence, a unit
UNITS = frozenset("acres bushels feet foot guineas inches lbs miles pence per pounds shillings tons yards years".split())


def _deletes(word: str, n: int) -> set[str]:
    """The word and what remains of it when up to ``n`` letters are left out."""
    out = last = {word}
    for _ in range(n):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def _errors(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Positions (in a, in b) of a longest common subsequence of two arrays of identities; 0 is no word."""
    rows = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for n, x in enumerate(a):
        hit = rows[n, :-1] + ((b == x) & (x > 0))
        rows[n + 1, 1:] = np.maximum.accumulate(np.maximum(hit, rows[n, 1:]))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def densest(n: int, hits: list[int], least: int) -> tuple[int, int]:
    """The longest stretch [first, end) of ``n`` positions, of ``least`` or more, of which DENSE are hits, or (0, 0); it begins and ends with a hit."""
    best = (0, 0)
    for x, first in enumerate(hits):
        for y in range(len(hits) - 1, x, -1):
            size = hits[y] + 1 - first
            if size < max(least, best[1] - best[0] + 1):
                break
            if y - x + 1 >= DENSE * size:
                best = (first, hits[y] + 1)
                break
    return best


class Templates(dict):
    """The vocabulary, template windows and token sequences of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        super().__init__()
        self.ids, self.exact, self.folded, self.near, self.plain = [], {}, {}, defaultdict(list), {}
        self.sequences: list[np.ndarray] = []  # template token of each word
        self.slots: list[np.ndarray] = []  # word identity of each word
        names, seen = set(), set()
        split = []
        for item, text in items:
            raw = tokens(text)
            words = [plain(w) for w in raw]
            for before, w, p in zip([".", *raw], raw, words):
                seen.add(p)
                if w[:1].isupper() and not before.endswith((".", "!", "?")):
                    names.add(p)
            split.append((item, [p for p in words if p]))
        words = sorted(w for w in seen if w.isalpha())
        self.kind = {}
        for n, w in enumerate(words):
            at = n + 10
            self.exact[w] = at
            # a word that is also written small somewhere is no name
            self.kind[at] = NAME if w in names else UNIT if w in UNITS else at
            self.folded.setdefault(fold(w), at)
            for d in _deletes(w, _errors(w)) if len(w) > 3 else ():
                self.near[d].append(at)
        self.word = dict(enumerate(words, 10))
        for item, ws in split:
            pairs = [self.token(w) for w in ws]
            self.ids.append(item)
            self.sequences.append(np.array([t for t, _ in pairs], np.int64))
            self.slots.append(np.array([s for _, s in pairs], np.int64))
        self.base = len(words) + 11
        self.content = np.zeros(self.base, bool)
        for w, at in self.exact.items():
            self.content[at] = len(w) >= CONTENT
        keys, where = [], []
        for k, seq in enumerate(self.slots):
            if len(seq) >= WINDOW:
                h = self.hash(self.sequences[k])
                keys.append(h)
                where.append(np.stack([np.full(len(h), k), np.arange(len(h))]))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.where = np.concatenate(where, axis=1) if where else np.zeros((2, 0), np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.where = self.keys[order], self.where[:, order]

    def hash(self, seq: np.ndarray) -> np.ndarray:
        """One number for each window of template tokens; windows with an unknown token get -1."""
        n = len(seq) - WINDOW + 1
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(WINDOW):
            part = seq[k : k + n]
            out = out * self.base + part
            known &= part > UNKNOWN
        return np.where(known, out, -1)

    def token(self, word: str) -> tuple[int, int]:
        """(template token, word identity) of a plain word of an item or a page."""
        at = self.exact.get(word)
        if at is None:
            if word and not any(c.isalpha() for c in word):
                return NUMBER, NUMBERS + zlib.crc32(word.encode()) % NUMBERS
            at = self.folded.get(fold(word)) if len(word) > 2 else None
            if at is not None and abs(len(self.word[at]) - len(word)) > 2:
                at = None
            if at is None and len(word) > 3:
                most = _errors(word)
                found = {c for d in _deletes(word, most) for c in self.near.get(d, ())}
                best = min(((_edits(word, self.word[c], most), c) for c in found), default=(9, 0))
                at = best[1] if best[0] <= most else None
        if at is None:
            return UNKNOWN, 0
        return self.kind[at], at

    def __missing__(self, raw: str) -> int:
        """Template token and word identity of a raw word, packed with its marks; -1 for signs alone."""
        word = plain(raw)
        got = self.plain.get(word)
        if got is None:
            kind, at = self.token(word)
            got = self.plain[word] = (kind << 32) | (at & 0xFFFFFFFF) if word else -1
        if got >= 0:
            if got >> 32 == UNKNOWN:
                bare = raw.lstrip("\"'([{“‘")
                if bare[:1].isupper() and bare[1:2].islower():
                    got |= TITLE | (NAMES + zlib.crc32(word.encode()) % NAMES)
                elif word in UNITS or parse_unit(word) is not None:
                    got |= UNITLIKE
            if raw.endswith((".", "!", "?")):
                got |= STOP
        self[raw] = got
        return got

    def pages(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Of each text the template tokens of words that items know, the tokens with those known by form, and the word identities.

        Words of signs alone are left out.
        """
        if len(self) > CACHE:
            self.clear()
            self.plain.clear()
        raw = [tokens(t) for t in texts]
        sizes = np.cumsum([0, *map(len, raw)])
        packed = np.fromiter(map(self.__getitem__, chain.from_iterable(raw)), np.int64, int(sizes[-1]))
        kept = packed >= 0
        bounds = np.concatenate([[0], np.cumsum(kept)])[sizes][1:-1]
        packed = packed[kept]
        known = (packed >> 32) & 0x3FFFFFF
        # a capital word begins no sentence if the word before ends none; at the start of a page it does
        inside = np.append(False, (packed[:-1] & STOP) == 0)
        inside[bounds[bounds < len(inside)]] = False
        after = np.append(False, known[:-1] == NUMBER)
        formed = np.where(((packed & TITLE) != 0) & inside, NAME, np.where(((packed & UNITLIKE) != 0) & after, UNIT, known))
        words = packed & 0xFFFFFFFF
        return np.split(known, bounds), np.split(formed, bounds), np.split(words, bounds)

    def segments(self, item: list[int], page: list[int], hits: list[tuple[int, int]]) -> list[list[int]]:
        """Stretches [i0, j0, i1, j1] of an item that stand on the page with no more than single words altered.

        hits: (item position, page position) of shared windows, in page order. Windows whose offsets differ by a few
        words are one stretch; its ends are then moved on word by word.
        """
        open_, done = [], []
        for j, i in sorted((j, i) for i, j in hits):
            still, home = [], None
            for seg in open_:
                if j - seg[3] > CHAIN + DRIFT:
                    done.append(seg)
                    continue
                still.append(seg)
                di, dj = i - seg[2], j - seg[3]
                if 0 < di <= CHAIN and abs(di - dj) <= DRIFT and (home is None or abs(di - dj) < home[0]):
                    home = (abs(di - dj), seg)
            open_ = still
            if home:
                home[1][2], home[1][3] = i, j
            else:
                open_.append([i, j, i, j])
        out = []
        for i0, j0, i1, j1 in done + open_:
            i1, j1 = self._extend(item, page, i1 + WINDOW - 1, j1 + WINDOW - 1, 1)
            i0, j0 = self._extend(item, page, i0, j0, -1)
            out.append([i0, j0, i1, j1])
        return out

    @staticmethod
    def _extend(item: list[int], page: list[int], i: int, j: int, step: int) -> tuple[int, int]:
        """Move the end of a stretch on, over single altered, broken or joined words that a match follows."""
        n, m = len(item), len(page)
        moves = ((1, 1), (2, 2), (2, 3), (1, 2), (2, 1), (3, 2))
        while True:
            for di, dj in moves:
                a, b = i + step * di, j + step * dj
                if 0 <= a < n and 0 <= b < m and item[a] == page[b] > 0:
                    if (di, dj) != (1, 1):
                        # a jump must be borne out by the next word too
                        a2, b2 = a + step, b + step
                        if not (0 <= a2 < n and 0 <= b2 < m and item[a2] == page[b2]):
                            continue
                    i, j = a, b
                    break
            else:
                return i, j

    def runs(self, item: np.ndarray, page: np.ndarray, hits: list[tuple[int, int]], least: int) -> tuple[int, list[tuple[int, int]]]:
        """(length in item words, matched positions) of the longest dense run of ``least`` words or more; (0, []) if there is none.

        Every run is tried, and one that isn't dense is cut back to its longest dense stretch.
        """
        reach: list[list[int]] = []
        for seg in sorted(s for s in self.segments(item.tolist(), page.tolist(), hits) if s[2] - s[0] >= 3):
            start, first = seg[0], seg[1]
            for other in reach:
                # the passage goes on after an advert: the item without a gap, the page with one
                if -2 <= seg[0] - other[2] <= ITEM_GAP and 0 < seg[1] - other[3] <= PAGE_GAP and other[4] < start:
                    start, first = other[4], other[5]
            reach.append([*seg, start, first])
        best: tuple[int, list[tuple[int, int]]] = (0, [])
        for run, a, end, ja, jb in sorted({(s[2] - s[4] + 1, s[4], s[2], s[5], s[3]) for s in reach}, reverse=True):
            if run < max(least, best[0] + 1):
                break
            hit = matched(item[a : end + 1], page[ja : jb + 1])
            if len(hit) < DENSE * run:
                lo, hi = densest(run, [i for i, _ in hit], least)
                hit = [(i, j) for i, j in hit if lo <= i < hi]
                run = hi - lo
            if run > best[0]:
                best = (run, [(a + i, ja + j) for i, j in hit])
        return best

    def align(self, k: int, template: np.ndarray, words: np.ndarray, hits: list[tuple[int, int]], least: int) -> tuple[int, int, int, bool]:
        """(longest run in item words, slots in it, slots with the item's value, verbatim) of item ``k``; zeros without a run."""
        kinds, values = self.sequences[k], self.slots[k]

        def slots(hit):
            return [(int(values[i]), int(words[j])) for i, j in hit if kinds[i] in (NAME, NUMBER, UNIT)]

        run, hit = self.runs(values, words, hits, least)
        if run:
            # word by word: a slot that stands on the page has the item's value, or is misread
            first, last = hit[0][0], hit[-1][0]
            return run, int(np.isin(kinds[first : last + 1], (NAME, NUMBER, UNIT)).sum()), len(slots(hit)), True
        run, hit = self.runs(kinds, template, hits, least)
        pairs = slots(hit)
        if not run or 2 * len(pairs) > run or len(pairs) < 2:
            return 0, 0, 0, False
        there, back = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
        for x, y in pairs:
            there[x][y] += 1
            back[y][x] += 1
        # consistent: the item's value stands for this one value throughout, and no other item value does
        mapped = sum(max(there[x], key=there[x].get) == y and max(back[y], key=back[y].get) == x for x, y in pairs)
        if mapped < MAPPED * len(pairs):
            return 0, 0, 0, False
        return run, len(pairs), sum(x == y for x, y in pairs), False

    def search(self, known: list[np.ndarray], formed: list[np.ndarray], page_words: list[np.ndarray], least: int):
        """(page, item index, run, slots, agreeing, verbatim) of every pair whose run reaches ``least``."""
        sizes = [len(s) for s in known]

        def join(parts):
            # unknown tokens between pages, so that no window spans two
            return np.concatenate([np.append(s, [UNKNOWN] * WINDOW) for s in parts]) if parts else np.zeros(0, np.int64)

        tokens_ = join(formed)
        if len(tokens_) < WINDOW or not len(self.keys):
            return
        h, plain_ = self.hash(tokens_), self.hash(join(known))
        # a window alive by form alone must hold a word that says something
        says = np.append(self.content[tokens_], np.zeros(WINDOW, bool))
        says = np.any([says[k : k + len(h)] for k in range(WINDOW)], axis=0)
        h = np.where((plain_ < 0) & ~says, -1, h)
        joined = tokens_
        a, b = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        hit = np.flatnonzero((b > a) & (h >= 0))
        if not len(hit):
            return
        n = (b - a)[hit]
        at = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(hit, n)
        ends = np.cumsum(np.array(sizes) + WINDOW)
        page = np.searchsorted(ends, pos, "right")
        item, ipos = self.where[:, at]
        pair = page * np.int64(len(self.ids)) + item
        # a passage keeps its offset but for broken words: count the item positions met in bands of offsets
        keep = np.zeros(len(pair), bool)
        for shift in (0, BAND // 2):
            band = (pos - ipos + shift + len(joined)) // BAND
            order = np.lexsort((ipos, band, pair))
            p, d, i = pair[order], band[order], ipos[order]
            new = np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1]))
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            distinct = np.add.reduceat(np.append(True, i[1:] != i[:-1]) | new, first)
            last = np.append(first[1:], len(i)) - 1
            good = (distinct >= SEEDS) & (i[last] - i[first] >= SPAN)
            keep[order[good[group]]] = True
        wanted = np.isin(pair, np.unique(pair[keep]))
        pair, ipos, pos = pair[wanted], ipos[wanted], pos[wanted]
        order = np.argsort(pair, kind="stable")
        pair, ipos, pos = pair[order], ipos[order], pos[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        for f, t in zip(first.tolist(), np.append(first[1:], len(pair)).tolist()):
            p, k = divmod(int(pair[f]), len(self.ids))
            start = int(ends[p]) - sizes[p] - WINDOW
            run, slots, agree, verbatim = self.align(k, formed[p], page_words[p], list(zip(ipos[f:t].tolist(), (pos[f:t] - start).tolist())), least)
            if run >= least:
                yield p, k, run, slots, agree, verbatim


_BUILT: dict[bytes, list[Templates]] = {}


def _templates(key: bytes, items: list[tuple[int, str]]) -> list[Templates]:
    """The worker's templates of a pass, kept between tasks."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [Templates(items[lo : lo + BLOCK_ITEMS]) for lo in range(0, len(items), BLOCK_ITEMS)]
    return _BUILT[key]


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("run", pa.int32()), ("slots", pa.int32()), ("slots_agree", pa.int32()), ("kind", pa.string())])


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, run (item words in order), slots (names, numbers and units among them), slots_agree and kind
    (``verbatim`` or ``reparameterised``).

    docs: doc_id, text, page_lines, page_w, n_columns; items: item_id, text. One row for each document and item with a
    run of ``least`` words or more. Null and blank texts leak nothing; repeated documents are each reported; whole
    texts are read. No shuffle: the items (a held-out set, small by nature) are broadcast in passes of bounded size,
    so a set of up to PASS_ITEMS takes one pass over the documents.
    """
    spark = docs.sparkSession
    pages = docs.select("doc_id", "text", "page_lines", F.col("page_w").cast("double"), F.col("n_columns").cast("double"))
    listed = ((int(r["item_id"]), r["text"]) for r in items.filter("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator())
    out = None
    while (block := list(islice(listed, PASS_ITEMS))) or out is None:
        shared = spark.sparkContext.broadcast(block)
        key = repr((len(block), zlib.crc32(repr(block).encode()))).encode()

        def run(batches, shared=shared, key=key):
            templates = _templates(key, shared.value)
            for big in batches:
                for at in range(0, big.num_rows, 500):
                    batch = big.slice(at, 500)
                    part = PageBatch(*(batch.column(c) for c in range(1, 5)))
                    texts = [part.flowing(i) for i in range(len(part.texts))]
                    ids = batch.column(0).to_pylist()
                    found = [(ids[p], t.ids[k], r, s, g, "verbatim" if v else "reparameterised") for t in templates for p, k, r, s, g, v in t.search(*t.pages(texts), least)]
                    if found:
                        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=FOUND.names), schema=FOUND, preserve_index=False)

        part = pages.mapInArrow(run, "doc_id long, item_id long, run int, slots int, slots_agree int, kind string")
        out = part if out is None else out.unionByName(part)
    return out


def p9_leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_found(spark, sf_dir):
    """The verbatim leaks: the slot check sets apart those that only follow an item's template."""
    return p9_leaks(spark, sf_dir).filter("kind = 'verbatim'").select("doc_id", "item_id").distinct()
