"""A declarative cut language for catalogues, compiled to columns.

A line is ``name T|F op AND|OR {v1,v2,...} [{w1,w2,...}]`` with op one of == != <> >< >= <= -. A disabled cut
passes; each value (or interval) gives a boolean, joined by OR or AND; bounds are inclusive, reversed bounds pass
at v <= low or v >= high; thresholds are cast to the type of the operand. Lines starting with # * / or a blank are
skipped. An enabled cut whose name is neither registered nor a column is an error, or passes with a warning if asked.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(r"^(\S+)\s+([TF])\s+(==|!=|<>|><|>=|<=|-)\s+(AND|OR)\s*(?:\{([^}]*)\})?\s*(?:\{([^}]*)\})?")


@dataclass(frozen=True)
class Cut:
    name: str
    enabled: bool
    op: str
    combine: str
    values: tuple[float, ...] = ()
    uppers: tuple[float, ...] = ()


def parse_cuts(text: str) -> list[Cut]:
    """The cuts of a file, by name; a malformed line is an error."""
    out = []
    for line in text.splitlines():
        if not line.strip() or line[0] in "#*/ \t":
            continue
        m = _LINE.match(line)
        if not m:
            raise ValueError(f"not a cut: {line!r}")
        numbers = [tuple(float(x) for x in (g or "").split(",") if x.strip()) for g in m.groups()[4:]]
        if m[3] in ("<>", "><") and len(numbers[0]) != len(numbers[1]):
            raise ValueError(f"bounds don't pair: {line!r}")
        out.append(Cut(m[1], m[2] == "T", m[3], m[4], *numbers))
    return sorted(out, key=lambda c: c.name)


def passes(cut: Cut, value: Column, kind: str) -> Column:
    """Whether ``value`` (of Spark type ``kind``) passes a cut; null never does."""
    def as_operand(x: float):
        return F.lit(int(x)) if kind in ("int", "bigint", "smallint", "tinyint") else F.lit(bool(x)) if kind == "boolean" else F.lit(x)

    if not cut.enabled:
        return F.lit(True)
    if cut.op == "-":
        return F.coalesce(value.cast("boolean"), F.lit(False))
    lows = [as_operand(x) for x in (dict.fromkeys(cut.values) if cut.op in ("==", "!=") else cut.values)]
    highs = [as_operand(x) for x in cut.uppers]
    tests = {
        "==": lambda: [value == x for x in lows], "!=": lambda: [value != x for x in lows],
        ">=": lambda: [value >= x for x in lows], "<=": lambda: [value <= x for x in lows],
        "<>": lambda: [(value >= a) & (value <= b) for a, b in zip(lows, highs)], "><": lambda: [(value <= a) | (value >= b) for a, b in zip(lows, highs)],
    }[cut.op]()
    join = (lambda a, b: a | b) if cut.combine == "OR" else (lambda a, b: a & b)
    return F.coalesce(reduce(join, tests), F.lit(False)) if tests else F.lit(True)


#: cut name -> (operand, its type) over a flat catalogue; a ratio with 0 below is null, which passes no cut
Operand = tuple[Callable[[], Column], str]
_beams = lambda: F.try_divide(F.col("npix").cast("double"), F.col("beam_area"))
_red = lambda: F.try_divide(F.col("chi2"), F.col("ndf"))
_no_beam = lambda: F.coalesce(F.col("beam_area"), F.lit(0.0)) <= 0


def _snr(value: Column) -> Column:
    """A value over the mean noise of the island's pixels."""
    return F.try_divide(value, F.try_divide(F.col("rms_sum"), F.col("npix").cast("double")))


def _extended() -> Column:
    loose = ~F.col("has_fit") | (_red() > 10)
    return _no_beam() | (F.col("n_components") > 3) | (_beams() > 20) | ((_beams() > 10) & loose)


def _compact() -> Column:
    return (F.col("n_components") <= 3) & ((_beams() <= 10) | (F.col("has_fit") & (_red() <= 10)))


def _plain(column: str, kind: str = "double") -> Operand:
    return (lambda: F.col(column)), kind


# fixed values: the names of the registered cuts
ISLAND: dict[str, Operand] = {
    "nPixels": _plain("npix", "bigint"), "nComponents": _plain("n_components", "int"), "minBoundingBox": _plain("min_box"), "goodSourceFlag": _plain("good", "boolean"),
    "circRatio": _plain("circularity"), "elongation": _plain("elongation"), "ellipseAreaRatio": _plain("ellipse_ratio"), "beamAreaRatio": (_beams, "double"),
    "sourceMorphology": _plain("morph_id", "int"), "sourceness": _plain("sourceness_id", "int"), "sourceSimType": _plain("sim_type", "int"),
    "isExtended": (_extended, "boolean"), "isCompact": (_compact, "boolean"), "hasPixelsAtEdge": _plain("at_edge", "boolean"), "hasFit": _plain("has_fit", "boolean"),
    "fitStatus": _plain("fit_status", "int"), "hasGoodFitChi2": (_red, "double"), "fitQualityFlag": _plain("fit_quality", "int"), "fitFlux": _plain("flux"),
    "fitFluxToIslandRatio": ((lambda: F.try_divide("flux", "s")), "double"),
}
PASS_WITHOUT_FIT = {"fitStatus", "hasGoodFitChi2", "fitQualityFlag", "fitFlux"}
#: over an element of the array ``components``; the row gives the island's values
COMPONENT: dict[str, Callable[[Column], Column]] = {
    "fitComponentFlux": lambda c: c["flux"], "fitComponentCentroidInsideIsland": lambda c: c["inside"].cast("double"), "fitComponentPeakFluxToMaxRatio": lambda c: F.try_divide(c["a"], F.col("smax")),
    "fitComponentIntToPeakFluxRatio": lambda c: F.try_divide(c["flux"], c["a"]) - F.try_divide(F.lit(2.03), _snr(c["a"])),
    "fitComponentPeakSignificance": lambda c: _snr(c["a"] - F.try_divide(F.col("bkg_sum"), F.col("npix").cast("double"))),
    "fitComponentPeakSNR": lambda c: _snr(c["a"]),
    "fitComponentEccentricityRatio": lambda c: c["ecc_ratio"], "fitComponentBeamAreaRatio": lambda c: c["area_ratio"],
    "fitComponentMorphology": lambda c: c["morph_id"].cast("double"), "fitComponentSourceness": lambda c: c["sourceness_id"].cast("double"),
}
#: judges the components of a row together
ISOLATED = "fitComponentIsolatedCentroid"


def island_cut(cut: Cut, columns: dict[str, str], unknown: str = "error") -> Column:
    """Boolean column of a cut: a registered name, or any column of the table by its name. A disabled cut passes."""
    if not cut.enabled:
        return F.lit(True)
    if cut.name in ISLAND:
        operand, kind = ISLAND[cut.name]
        test = passes(cut, operand(), kind)
        if cut.name in PASS_WITHOUT_FIT:
            test = ~F.coalesce(F.col("has_fit"), F.lit(False)) | test
        return test | _no_beam() if cut.name == "beamAreaRatio" else test
    if cut.name in columns:
        return passes(cut, F.col(cut.name), columns[cut.name])
    if unknown != "pass":
        raise ValueError(f"cut {cut.name!r} is neither registered nor a column")
    warnings.warn(f"cut {cut.name!r} isn't registered and passes", stacklevel=3)
    return F.lit(True)


def component_test(cut: Cut) -> Callable[[Column], Column]:
    return lambda c: passes(cut, COMPONENT[cut.name](c), "double")


def isolated(components: Column, cut: Cut) -> Column:
    """The components that stand apart: from the brightest on, one is kept if along x or along y it passes the cut against all kept before it."""
    # brightest first; of equal ones the earlier
    numbered = F.transform(components, lambda c, i: F.struct((-c["a"]).alias("k"), i.alias("i"), c.alias("c")))
    bright = F.transform(F.array_sort(numbered), lambda e: e["c"])

    def step(kept: Column, c: Column) -> Column:
        apart = F.forall(kept, lambda o: passes(cut, F.abs(o["x0"] - c["x0"]), "double") | passes(cut, F.abs(o["y0"] - c["y0"]), "double"))
        return F.when(apart, F.concat(kept, F.array(c))).otherwise(kept)

    return F.aggregate(bright, F.filter(components, lambda c: F.lit(False)), step)


def component_cuts(df: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Drop the failing elements of ``components`` cut by cut; a row that loses all of them fails, one without a fit passes."""
    fitted = F.coalesce(F.col("has_fit"), F.lit(False)) if "has_fit" in df.columns else F.lit(True)
    for cut in cuts:
        if not cut.enabled or cut.name not in (*COMPONENT, ISOLATED):
            continue
        kept = isolated(F.col("components"), cut) if cut.name == ISOLATED else F.filter("components", component_test(cut))
        df = df.withColumn("components", F.when(fitted, kept).otherwise(F.col("components"))).filter(~fitted | (F.size("components") > 0))
    return df


def select(df: DataFrame, cuts: list[Cut], require_all: bool = True, unknown: str = "error") -> DataFrame:
    """Rows that pass all cuts (or, if not ``require_all``, at least one enabled cut). Component cuts drop failing
    elements of ``components`` first, and a row that loses all of them fails."""
    df = component_cuts(df, cuts)
    columns = dict(df.dtypes)
    tests = [island_cut(c, columns, unknown) for c in cuts if c.enabled and c.name not in (*COMPONENT, ISOLATED)]
    if not tests:
        return df
    return df.filter(reduce((lambda a, b: a & b) if require_all else (lambda a, b: a | b), tests))


def rejections(df: DataFrame, cuts: list[Cut]) -> DataFrame:
    """cut, rejected, share: how many rows each enabled cut would reject alone, in one pass."""
    columns = dict(df.dtypes)
    named = [(c.name, island_cut(c, columns)) for c in cuts if c.enabled and c.name not in (*COMPONENT, ISOLATED)]
    one = df.agg(F.count("*").alias("n"), *(F.sum((~t).cast("long")).alias(f"r{i}") for i, (_, t) in enumerate(named)))
    rows = F.array(*(F.struct(F.lit(n).alias("cut"), F.col(f"r{i}").alias("rejected"), (F.col(f"r{i}") / F.col("n")).alias("share")) for i, (n, _) in enumerate(named)))
    return one.select(F.inline(rows))


def promote_nested(df: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Selected rows of a table with id and mother_id: a nested row whose mother is rejected becomes a top row."""
    kept = select(df, cuts)
    mothers = kept.select(F.col("id").alias("mother_id"), F.lit(True).alias("_kept"))
    return kept.join(mothers, "mother_id", "left").withColumn("mother_id", F.when(F.col("_kept"), F.col("mother_id"))).drop("_kept")
