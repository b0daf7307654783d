"""Units as scale, offset and a vector of dimension exponents, parsed from expressions and free text.

Grammar of an expression (after quotes, brackets and repeated blanks are dropped)::

    unit   = factor (("*" | "." | " " | "/" | "per") factor)*      "/" and "per" divide the next factor
    factor = number | "10^" integer | [prefix] base [["^" | "**"] integer]

Numbers multiply the scale (``1e-3 Jy/beam``); prefixes are symbols (case matters) or words.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: base dimensions, unit spellings, prefixes
DIMENSIONS = ("flux", "temperature", "time", "angle", "beam", "pixel")
_ARCSEC = 1.0 / 3600.0
#: spelling -> (scale to the canonical unit, offset, exponents); canonical are Jy, K, s, degree, beam, pixel
BASES = {
    "jy": (1.0, 0.0, {"flux": 1}), "jansky": (1.0, 0.0, {"flux": 1}), "janskys": (1.0, 0.0, {"flux": 1}),
    "k": (1.0, 0.0, {"temperature": 1}), "kelvin": (1.0, 0.0, {"temperature": 1}), "kelvins": (1.0, 0.0, {"temperature": 1}),
    "degc": (1.0, 273.15, {"temperature": 1}),
    "hz": (1.0, 0.0, {"time": -1}), "hertz": (1.0, 0.0, {"time": -1}), "s": (1.0, 0.0, {"time": 1}),
    "deg": (1.0, 0.0, {"angle": 1}), "degs": (1.0, 0.0, {"angle": 1}), "degree": (1.0, 0.0, {"angle": 1}), "degrees": (1.0, 0.0, {"angle": 1}),
    "rad": (180.0 / np.pi, 0.0, {"angle": 1}), "sr": ((180.0 / np.pi) ** 2, 0.0, {"angle": 2}), "steradian": ((180.0 / np.pi) ** 2, 0.0, {"angle": 2}),
    "arcmin": (1 / 60.0, 0.0, {"angle": 1}), "arcmins": (1 / 60.0, 0.0, {"angle": 1}), "arcminute": (1 / 60.0, 0.0, {"angle": 1}), "arcminutes": (1 / 60.0, 0.0, {"angle": 1}), "amin": (1 / 60.0, 0.0, {"angle": 1}), "'": (1 / 60.0, 0.0, {"angle": 1}),
    "arcsec": (_ARCSEC, 0.0, {"angle": 1}), "arcsecs": (_ARCSEC, 0.0, {"angle": 1}), "arcsecond": (_ARCSEC, 0.0, {"angle": 1}), "arcseconds": (_ARCSEC, 0.0, {"angle": 1}), "asec": (_ARCSEC, 0.0, {"angle": 1}), "as": (_ARCSEC, 0.0, {"angle": 1}), '"': (_ARCSEC, 0.0, {"angle": 1}), "''": (_ARCSEC, 0.0, {"angle": 1}),
    "beam": (1.0, 0.0, {"beam": 1}), "beams": (1.0, 0.0, {"beam": 1}), "bm": (1.0, 0.0, {"beam": 1}),
    "pixel": (1.0, 0.0, {"pixel": 1}), "pixels": (1.0, 0.0, {"pixel": 1}), "pix": (1.0, 0.0, {"pixel": 1}),
}
SYMBOLS = {"n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
WORDS = {"nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12}
#: bases whose SI prefixes are read whatever their case: a frequency in milli-hertz makes no sense in a map header
CASELESS = {"hz": {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12}}


class Unit(NamedTuple):
    scale: float
    offset: float
    dims: tuple[int, ...]


def _base(word: str) -> Unit | None:
    def unit(name: str, factor: float = 1.0) -> Unit:
        scale, offset, dims = BASES[name]
        return Unit(scale * factor, offset, tuple(dims.get(d, 0) for d in DIMENSIONS))

    low = word.lower()
    if low in BASES:
        return unit(low)
    for prefix, factor in WORDS.items():
        if low.startswith(prefix) and low[len(prefix) :] in BASES:
            return unit(low[len(prefix) :], factor)
    if len(word) > 1 and low[1:] in BASES:
        factor = CASELESS.get(low[1:], {}).get(low[0]) or SYMBOLS.get(word[0])
        if factor is None and word[0] == "K":  # a capital K before a base is a kilo in capitals
            factor = 1e3
        if factor:
            return unit(low[1:], factor)
    return None


_TOKEN = re.compile(
    r"\s*(?:(?P<op>/|\*(?!\*)|\bper\b)|(?P<power>10\s*(?:\^|\*\*)\s*[+-]?\d+)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>''|[\"']|[^\W\d_]+)(?:\s*(?:\^|\*\*)?\s*(?P<exp>[+-]?\d+)(?![\d.eE]))?)",
    re.IGNORECASE,
)


_BLANKS = re.compile(r"\s*")


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> Unit | None:
    """The unit that an expression names; None if it is blank or isn't a unit."""
    if text is None:
        return None
    text = re.sub(r"\(tb\)|[\[\]{}]", " ", text, flags=re.IGNORECASE).strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1].strip()
    text = re.sub(r"\b(arc|milli|micro)\s+(sec|min)", r"\1\2", text, flags=re.IGNORECASE).strip("() ")
    if not text:
        return None
    scale, offset, dims, at, sign, factors = 1.0, 0.0, [0] * len(DIMENSIONS), 0, 1, 0
    dangling = False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        if m["op"]:
            if dangling:
                return None
            sign, dangling = 1 if m["op"] == "*" else -1, True
            at = _BLANKS.match(text, at).end()
            continue
        dangling = False
        if m["power"]:
            scale *= 10.0 ** (sign * int(re.split(r"\^|\*\*", m["power"])[1]))
        elif m["number"]:
            scale *= float(m["number"]) ** sign
        else:
            unit = _base(m["word"])
            if unit is None:
                return None
            power = sign * int(m["exp"] or 1)
            scale *= unit.scale**power
            offset = unit.offset
            dims = [d + power * u for d, u in zip(dims, unit.dims)]
            factors += 1
        sign = 1
        at = _BLANKS.match(text, at).end()
    return Unit(scale, offset if factors == 1 else 0.0, tuple(dims)) if factors and not dangling else None


FREQUENCY, ANGLE = (0, 0, -1, 0, 0, 0), (0, 0, 0, 1, 0, 0)
PER_BEAM, PER_PIXEL, PER_ANGLE, BRIGHTNESS = (1, 0, 0, 0, -1, 0), (1, 0, 0, 0, 0, -1), (1, 0, 0, -2, 0, 0), (0, 1, 0, 0, 0, 0)

# fixed values: what a clause of a note may speak of, and how it names the unit
_CLAUSE = re.compile(r"[\n;|]|(?<!freq)\.(?=\s|\Z)", re.IGNORECASE)
_LINK = r"(?:\s*(?:is|are|was|were|axes|axis|fwhm|major/minor|given|listed|quoted|in|as|at|of|values?|units?|:|=)(?=[\s:=(\"']|\b))*"
_NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
SUBJECTS = {
    "frequency": re.compile(rf"\A\s*(?:(?:central |centre |center |reference |observing )?freq(?:uency)?\d?\.?|crval\d?)(?!\w){_LINK}\s*(?:{_NUMBER})?\s*(?P<unit>.+)\Z", re.IGNORECASE),
    "beam": re.compile(rf"\A\s*(?:(?:(?:restoring|synthesi[sz]ed|clean) )?beam|bmaj(?:\s*(?:/|and|&|,)\s*bmin)?|bmin)\b{_LINK}\s*(?:{_NUMBER}\s*(?:\"|''|')?\s*(?:x|by|×)\s*{_NUMBER})?\s*(?P<unit>.+)\Z", re.IGNORECASE),
    "map": re.compile(rf"\A\s*(?:(?:map|image|pixel)\s+(?:units?|values?)|intensit(?:y|ies)|brightness|bunit)\b{_LINK}\s*(?P<unit>.+)\Z", re.IGNORECASE),
}
_WANTED = {"frequency": (FREQUENCY,), "beam": (ANGLE,), "map": (PER_BEAM, PER_PIXEL, PER_ANGLE, BRIGHTNESS)}


@lru_cache(maxsize=65536)
def units_in_text(text: str | None) -> dict[str, Unit]:
    """The units that free text gives for frequency, beam and map: of each the first clause that is about it."""
    found: dict[str, Unit] = {}
    for clause in _CLAUSE.split(text or ""):
        for what, pattern in SUBJECTS.items():
            m = pattern.match(clause)
            if m and what not in found:
                unit = parse_unit(m["unit"].strip(" .()"))
                if unit and unit.dims in _WANTED[what]:
                    found[what] = unit
    return found


_UNIT = T.StructType([T.StructField("scale", T.DoubleType()), T.StructField("offset", T.DoubleType()), T.StructField("dims", T.ArrayType(T.IntegerType()))])
_NAMES = T.StructType([T.StructField(n, T.StringType()) for n in ("bunit", "frequnit", "beam")])


@F.pandas_udf(_UNIT)
def unit_of(text: pd.Series) -> pd.DataFrame:
    """Parse a column of unit expressions; each distinct spelling is parsed once in a worker."""
    units = [parse_unit(t) for t in text]
    return pd.DataFrame({"scale": [u.scale if u else None for u in units], "offset": [u.offset if u else None for u in units], "dims": [list(u.dims) if u else None for u in units]})


@F.pandas_udf(_NAMES)
def note_units(notes: pd.Series) -> pd.DataFrame:
    """Canonical expressions of the units that notes name, null where they name none."""
    found = [units_in_text(n) for n in notes]
    out = {}
    for column, what, base in (("bunit", "map", None), ("frequnit", "frequency", "Hz"), ("beam", "beam", "deg")):
        names = []
        for units in found:
            u = units.get(what)
            if u is None:
                names.append(None)
            elif what == "map":
                tail = {PER_BEAM: "Jy/beam", PER_PIXEL: "Jy/pixel", PER_ANGLE: "Jy deg^-2", BRIGHTNESS: "K"}[u.dims]
                names.append(f"{u.scale!r} {tail}")
            else:
                names.append(f"{u.scale!r} {base}")
        out[column] = names
    return pd.DataFrame(out).astype(object)


def in_dims(unit: Column, dims: tuple[int, ...]) -> Column:
    return unit["dims"] == F.lit(list(dims))


def to_canonical(value: Column, unit: Column) -> Column:
    """A value in ``unit`` as a value in the canonical unit of its dimensions."""
    return value * unit["scale"] + unit["offset"]
