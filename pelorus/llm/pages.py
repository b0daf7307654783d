"""Reading order of scanned pages, and words with their misread letters folded."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

#: signs that end a line inside a word
BREAKS = ("-", "¬", "\xad", "=", "‐", "‑")

# fixed values: digits and signs that scanning puts for letters
_AS_LETTER = str.maketrans({"0": "o", "1": "l", "2": "z", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "$": "s", "!": "l", "|": "l", "(": "c", "\\": "a", "@": "a", "ſ": "s", "€": "e", "£": "e", "ß": "b"})
# fixed values: letter groups that look alike in print, each pair folded to its second member
_ALIKE = (("vv", "w"), ("ivi", "m"), ("rn", "m"), ("nn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("ri", "n"))
_ONE = str.maketrans({"c": "e", "o": "e", "a": "e", "h": "b", "u": "n", "f": "t", "l": "i", "j": "i", "r": "t", "q": "g", "y": "v", "s": "t"})


def plain(token: str) -> str:
    """Lower case, without accents, marks and signs around; misread digits inside a word made letters."""
    token = token.replace("ſ", "s")
    if not token.isascii():
        token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    token = token.strip(".,;:?!\"'()[]{}“”‘’—–-_*•☞<>«»„`~^+=#/&%")
    if token.isalpha():
        return token.lower()
    if not any(c.isalpha() for c in token):
        return token
    return "".join(c for c in token.lower().translate(_AS_LETTER) if c.isalpha())


def fold(word: str) -> str:
    """A key that is mostly the same for a word and its misreadings."""
    for a, b in _ALIKE:
        word = word.replace(a, b)
    return word.translate(_ONE)


def _numbers(values: pa.Array) -> np.ndarray:
    return np.nan_to_num(values.cast(pa.float64()).to_numpy(zero_copy_only=False))


class PageBatch:
    """The texts of an Arrow batch (columns text, page_lines, page_w, n_columns) in reading order, line by line."""

    def __init__(self, text: pa.Array, page_lines: pa.Array, page_w: pa.Array, n_columns: pa.Array):
        self.texts = text.to_pylist()
        sizes = np.nan_to_num(page_lines.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        self.ends = np.cumsum(sizes)
        flat = page_lines.flatten()
        doc = np.repeat(np.arange(len(self.texts)), sizes)
        x0, x1, y0, lo, hi = (_numbers(flat.field(c)) for c in ("x0", "x1", "y0", "char_from", "char_to"))
        width, columns = _numbers(page_w)[doc], np.maximum(_numbers(n_columns)[doc], 1)
        # the column of a line is where its left half begins; a page without a width is one column
        column = np.where(width > 0, np.floor((0.75 * x0 + 0.25 * x1) * columns / np.maximum(width, 1)), 0)
        order = np.lexsort((np.arange(len(doc)), y0, np.clip(column, 0, columns - 1), doc))
        self.lo, self.hi = lo[order].astype(np.int64).tolist(), hi[order].astype(np.int64).tolist()
        self.starts = (self.ends - sizes).tolist()
        self.ends = self.ends.tolist()

    def lines(self, i: int) -> list[str]:
        text = self.texts[i]
        if not text:
            return []
        a, b = self.starts[i], self.ends[i]
        if a == b:
            return text.split("\n")
        return [text[x:y] for x, y in zip(self.lo[a:b], self.hi[a:b])]

    def flowing(self, i: int) -> str:
        """The text of page ``i`` as one string, with words joined that a line end breaks."""
        out = []
        for line in self.lines(i):
            line = line.strip()
            if line:
                out.append(line[:-1] if line.endswith(BREAKS) else line + " ")
        return "".join(out)


_LETTER_SPACED = re.compile(r"(?:(?<=\s)|\A)(?:[^\W\d_] ){3,}[^\W\d_](?=[\s.,;:!?]|\Z)")


def tokens(text: str) -> list[str]:
    """Words of a text; letters printed apart are drawn together."""
    if " " in text and _LETTER_SPACED.search(text):
        text = _LETTER_SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return text.split()
