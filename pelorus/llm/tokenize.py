"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are joined into one array of code points. A table turns code points into classes, and a small
automaton over the classes marks where pre-tokens start. The automaton is run as a scan: each
character is a transition function on the states, functions compose associatively, so blocks are
composed side by side, block prefixes by doubling, and all characters of a block column at once.
The slices between starts are looked up in a cache of merged pieces; ids are gathered in bulk.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# classes of characters; APOS2 and APOS3 open a contraction of two or three characters
LETTER, NUMBER, OTHER, APOS2, APOS3, BLANK_LAST, BLANK, SPACE_LAST, SPACE, SEP = range(10)
# states: what the last character left open
S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACES, S_CUT, S_ONE, S_TWO = range(9)

CHUNK_CHARS = 1_000_000
CACHE_WORDS = 300_000
BLOCK = 256


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) by class and state."""
    nxt, start = np.zeros((10, 9), np.uint8), np.ones((10, 9), bool)
    for cls, state in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER)):
        nxt[cls] = state
        start[cls, [state, S_BLANK]] = False
    # inside a contraction the letters are counted off
    nxt[LETTER, S_TWO], nxt[LETTER, S_ONE] = S_ONE, S_CUT
    start[LETTER, [S_TWO, S_ONE]] = False
    for cls, state in ((APOS2, S_ONE), (APOS3, S_TWO)):
        nxt[cls] = state
        nxt[cls, [S_OTHER, S_BLANK]] = S_OTHER
        start[cls, [S_OTHER, S_BLANK]] = False
    nxt[BLANK_LAST], nxt[SPACE_LAST] = S_BLANK, S_CUT
    for cls in (BLANK, SPACE):
        nxt[cls] = S_SPACES
        start[cls, S_SPACES] = False
    nxt[SEP] = S_START
    return nxt, start


NEXT, STARTS = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that sequences of classes can act by: (element of a class, composition table, end from the start state).

    There are few of them, so a composition is one look-up of a byte.
    """
    letters = [tuple(int(x) for x in row) for row in NEXT]
    unit = tuple(range(NEXT.shape[1]))
    elements = {unit: 0}
    queue = [unit]
    for f in queue:
        for g in letters:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    table = np.array([[elements[tuple(g[x] for x in f)] for g in queue] for f in queue], np.uint8)
    return np.array([elements[f] for f in letters], np.uint8), table, np.array([f[S_START] for f in queue], np.uint8)


ELEMENT, COMPOSE, ENDS_IN = _monoid()


def scan_states(classes: np.ndarray) -> np.ndarray:
    """State before each character, by an associative scan of transition functions."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.uint8)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, SEP, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(ELEMENT[padded].reshape(blocks, BLOCK).T).astype(np.intp)
    flat, width = COMPOSE.ravel(), len(COMPOSE)
    # within blocks: the function of the characters before each
    before = np.empty((BLOCK, blocks), np.uint8)
    acc = np.zeros(blocks, np.uint8)
    for k in range(BLOCK):
        before[k] = acc
        columns[k] += acc.astype(np.intp) * width
        acc = flat.take(columns[k])
    # over blocks, by doubling: acc[b] becomes the function of blocks 0..b
    step = 1
    while step < blocks:
        acc[step:] = flat.take(acc[:-step].astype(np.intp) * width + acc[step:])
        step *= 2
    lead = np.concatenate([[0], acc[:-1]]).astype(np.intp) * width
    states = ENDS_IN.take(flat.take(lead[None, :] + before))
    return states.T.reshape(-1)[:n]


_TABLE: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of every code point, from its Unicode category."""
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, OTHER, np.uint8)
        by_letter = {"L": LETTER, "N": NUMBER}
        for cp in range(0x110000):
            cls = by_letter.get(unicodedata.category(chr(cp))[0])
            if cls is not None:
                table[cp] = cls
        # fixed values: White_Space of the Unicode character database
        for lo, hi in ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
            table[lo : hi + 1] = SPACE
        table[0x20] = BLANK
        _TABLE = table
    return _TABLE


def piece_starts(points: np.ndarray, seps: np.ndarray) -> np.ndarray:
    """Positions at which pieces start; ``seps`` are the positions between texts, which belong to none."""
    cls = class_table()[points]
    cls[seps] = SEP
    follows = np.append(cls[1:], SEP)
    solid = (follows != BLANK) & (follows != SPACE) & (follows != SEP)
    blank, space = cls == BLANK, cls == SPACE
    cls[blank & solid] = BLANK_LAST
    cls[space & solid] = SPACE_LAST
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        # the sentinel keeps the two looks ahead inside the array
        ahead = np.append(points, [0, 0]).astype(np.int64)
        ahead[seps] = 0
        one, two = ahead[at + 1], ahead[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cls[at[short]], cls[at[long]] = APOS2, APOS3
    starts = STARTS.ravel()[cls.astype(np.int16) * STARTS.shape[1] + scan_states(cls)]
    starts[seps] = False
    return np.flatnonzero(starts)


class Merges:
    """Pair merges over ids: a pair's rank is the id of the token that it makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = [ranks[bytes([b])] for b in range(256)]
        # any two tokens that join to a token are a pair
        self.pairs = {(ranks[t[:k]] << 20) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def apply(self, word: bytes) -> list[int]:
        """The ids of a piece: always the lowest rank first, leftmost among equals."""
        ids, get, none = [self.byte[b] for b in word], self.pairs.get, 1 << 60
        if len(ids) >= 200:
            return self._long(ids)
        rank = [get((a << 20) | b, none) for a, b in zip(ids, ids[1:])]
        while rank:
            best = min(rank)
            if best == none:
                break
            i = rank.index(best)
            ids[i : i + 2] = [best]
            del rank[i]
            if i:
                rank[i - 1] = get((ids[i - 1] << 20) | best, none)
            if i < len(rank):
                rank[i] = get((best << 20) | ids[i + 1], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a linked list and a heap, for pieces of any length."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a << 20) | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := get((ids[a] << 20) | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]


class _Pieces(dict):
    """Index of each piece seen; a new piece is merged once."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.ids, self.ends = merges, [], [0]

    def __missing__(self, word: bytes) -> int:
        self.ids.extend(self.merges.apply(word))
        self.ends.append(len(self.ids))
        self[word] = at = len(self)
        return at


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its id a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file lies: ``folder``, else the installed package of public tokenizers."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


class Encoder:
    """Encodes lists of texts to a flat array of ids, the offsets of each text in it, and the start of each id's piece."""

    def __init__(self, data: bytes):
        self.merges = Merges(read_ranks(data))
        self.pieces = _Pieces(self.merges)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        seps = np.cumsum(lengths + 1) - 1
        starts = piece_starts(points, seps)
        # a piece ends where the next starts, or at the end of its text
        owner = np.searchsorted(seps, starts)
        ends = np.minimum(np.append(starts[1:], len(points)), seps[owner])
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = _Pieces(self.merges)
        size = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            size += points >= least
        at = np.concatenate([[0], np.cumsum(size)])
        raw = joined.encode("utf-8", "surrogatepass")
        words = [raw[a:b] for a, b in zip(at[starts].tolist(), at[ends].tolist())]
        index = np.fromiter(map(self.pieces.__getitem__, words), np.int64, len(words))
        ids, bounds = np.asarray(self.pieces.ids, np.int32), np.asarray(self.pieces.ends, np.int64)
        sizes = bounds[index + 1] - bounds[index]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(bounds[index] - total[:-1], sizes) + np.arange(total[-1])]
        offsets = total[np.searchsorted(owner, np.arange(len(texts) + 1))]
        text_start = np.concatenate([[0], seps[:-1] + 1]) if len(texts) else seps
        places = np.repeat(starts - text_start[owner], sizes).astype(np.int32)
        return flat, offsets.astype(np.int32), places


_ENCODER: tuple[bytes, Encoder] | None = None


def _encoder(data: bytes) -> Encoder:
    """The worker's encoder, kept between tasks with its cache."""
    global _ENCODER
    if _ENCODER is None or _ENCODER[0] != data:
        _ENCODER = (data, Encoder(data))
    return _ENCODER[1]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """key, ids (array of int) of every row; with ``offsets`` also ``starts``, the code point at which each id's piece starts.

    An empty or null text has the empty list; special-token strings in a text are ordinary text; texts are encoded
    whole. Rows are neither merged nor dropped, null keys included, and other columns are ignored. No shuffle: the
    vocabulary (a fixed file under 1 MB) goes to the executors, texts are taken in chunks of bounded size.
    """
    with open(path or vocabulary_path(), "rb") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    kind = docs.schema[key].dataType

    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            sizes = np.array([len(t or "") for t in column.to_pylist()], np.int64) if batch.num_rows else np.zeros(0, np.int64)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_CHARS, "right")) + at)
                flat, bounds, places = encoder.encode(column.slice(at, stop - at).to_pylist())
                columns = [keys.slice(at, stop - at), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(places)))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "starts"][: len(columns)])
                at = stop

    schema = f"key {kind.simpleString()}, ids array<int>" + (", starts array<int>" if offsets else "")
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of a list of ids."""
    words = {v: k for k, v in ranks.items()}
    return b"".join(words[i] for i in ids).decode("utf-8", "replace")
