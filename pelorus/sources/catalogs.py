"""Text catalogues of external objects, parsed to one table: a layout for each format, columns JVM-side.

Lines that are blank or start with # * or / are skipped. With ``strict`` a line with a wrong number of fields fails
the read, as one malformed row rejects a file; otherwise such lines come out with ``error`` set.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCSEC = 1 / 3600.0


@dataclass(frozen=True)
class Layout:
    """delimiter (a regular expression), allowed numbers of fields, and output column -> (field, factor); factor None keeps text."""

    delimiter: str
    fields: tuple[int, ...]
    columns: dict[str, tuple[int, float | None]]
    sky: int | None = None  # field that holds "ra dec" in one
    flag: int | None = None  # field with T, L or P: true, likely, possible
    name: tuple[int, ...] = field(default=(0,))


def _errors(ra: int, dec: int, factor: float = ARCSEC) -> dict[str, tuple[int, float]]:
    return {"ra_err": (ra, factor), "dec_err": (dec, factor)}


# fixed values: where the fields stand in each format
LAYOUTS: dict[str, Layout] = {
    "simbad": Layout(r"\|", (4,), {"class": (2, None)}, sky=3, name=(1,)),
    "ned": Layout(r"\|", (5,), {"ra": (2, 1.0), "dec": (3, 1.0), "class": (4, None)}, name=(1,)),
    "gaia": Layout(r"\|", (5,), {"ra": (1, 1.0), "dec": (3, 1.0), **_errors(2, 4, ARCSEC / 1000)}),
    "mgps": Layout(r"\|", (12,), {"ra": (1, 1.0), "dec": (2, 1.0), **_errors(3, 4), "peak": (5, 1.0), "peak_err": (6, 1.0), "flux": (7, 1.0), "flux_err": (8, 1.0), "bmaj": (9, 1.0), "bmin": (10, 1.0), "pa": (11, 1.0)}),
    "selavy": Layout(r"[ \t]+", (37,), {"ra": (5, 1.0), "dec": (6, 1.0), **_errors(7, 8), "nu": (9, 1e-3), "peak": (10, 1.0), "peak_err": (11, 1.0), "flux": (12, 1.0), "flux_err": (13, 1.0), "bmaj": (14, 1.0), "bmin": (15, 1.0), "pa": (16, 1.0)}, name=(2,)),
    "aegean": Layout(r"[ \t]+", (27,), {"ra": (6, 1.0), "dec": (8, 1.0), "ra_err": (7, 1.0), "dec_err": (9, 1.0), "peak": (10, 1.0), "peak_err": (11, 1.0), "flux": (12, 1.0), "flux_err": (13, 1.0), "bmaj": (14, 1.0), "bmin": (16, 1.0), "pa": (18, 1.0)}, name=(24,)),
    "components": Layout(r"[ \t]+", (48, 61), {"ra": (8, 1.0), "dec": (9, 1.0), "ra_err": (10, 1.0), "dec_err": (11, 1.0), "nu": (12, 1.0), "peak": (13, 1.0), "peak_err": (14, 1.0), "flux": (15, 1.0), "flux_err": (16, 1.0), "bmaj": (26, 1.0), "bmin": (27, 1.0), "pa": (28, 1.0)}, name=(0, 2)),
    "hash": Layout(r"\|", (9,), {"ra": (4, 1.0), "dec": (5, 1.0), "bmaj": (6, 1.0), "bmin": (7, 1.0), "pa": (8, 1.0)}, flag=3, name=(2,)),
    "wise_hii": Layout(r"\|", (5,), {"class": (1, None), "ra": (2, 1.0), "dec": (3, 1.0), "radius": (4, ARCSEC)}),
    "atnf": Layout(r"\|", (4,), {"ra": (2, 1.0), "dec": (3, 1.0)}, name=(1,)),
    "wolf_rayet": Layout(r"\|", (4,), {"ra": (2, 1.0), "dec": (3, 1.0)}, name=(1,)),
    "mash": Layout(r"\|", (10,), {"ra": (0, 1.0), "dec": (1, 1.0), "bmaj": (7, 1.0), "bmin": (8, 1.0)}, flag=2, name=(4,)),
}
NUMERIC = ("ra", "dec", "ra_err", "dec_err", "nu", "peak", "peak_err", "flux", "flux_err", "bmaj", "bmin", "pa", "radius")


def parse(lines: DataFrame, format: str, column: str = "value", strict: bool = False) -> DataFrame:
    """name, class, confirmed, error and the numeric fields of a format from a frame of lines."""
    layout = LAYOUTS[format]
    rows = lines.filter(F.col(column).isNotNull() & ~F.col(column).rlike(r"^\s*([#*/]|$)"))
    text = F.regexp_replace(column, r"^[ \t]+|[ \t]+$", "") if "t" in layout.delimiter else F.col(column)
    parts = F.transform(F.split(text, layout.delimiter), lambda s: F.trim(s))
    d = rows.withColumn("_f", parts)
    n = F.size("_f")
    good = n.isin(list(layout.fields))
    at = lambda i: F.when(good, F.get("_f", F.lit(i)))
    sky = F.split(F.trim(at(layout.sky)), r"\s+") if layout.sky is not None else None

    def number(name: str) -> Column:
        if sky is not None and name in ("ra", "dec"):
            return F.get(sky, F.lit(int(name == "dec"))).try_cast("double")
        if name not in layout.columns:
            return F.lit(None).cast("double")
        i, factor = layout.columns[name]
        return at(i).try_cast("double") * factor

    kind = at(layout.columns["class"][0]) if "class" in layout.columns else F.lit(None).cast("string")
    # a question mark or a flag other than T makes a candidate
    confirmed = at(layout.flag) == "T" if layout.flag is not None else ~F.coalesce(kind.contains("?"), F.lit(False))
    wrong = F.concat(F.lit(f"{format}: "), n.cast("string"), F.lit(" fields"))
    error = F.when(~good, F.raise_error(wrong).cast("string") if strict else wrong)
    out = {"name": F.concat_ws("_", *map(at, layout.name)), "class": F.replace(kind, F.lit("?"), F.lit("")), "confirmed": F.when(good, confirmed), "error": error} | {c: number(c) for c in NUMERIC}
    kept = [c for c in rows.columns if c not in out]
    return d.select(*kept, *(e.alias(c) for c, e in out.items()))


def read(spark: SparkSession, path: str, format: str, strict: bool = True) -> DataFrame:
    return parse(spark.read.text(path), format, strict=strict)


_NUMBERS = r"[-+0-9.eE\"]+"


def parse_regions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add shape, cx, cy, r (degrees), w, h, a, b, theta, verts, name and tags of DS9 region lines; other lines have a null shape.

    A radius with a trailing double quote is in arcsec; sexagesimal coordinates give nulls.
    """
    body = F.regexp_extract(column, r"(?i)(polygon|box|circle|ellipse)\s*\(([^)]*)\)", 2)
    shape = F.nullif(F.lower(F.regexp_extract(column, r"(?i)(polygon|box|circle|ellipse)\s*\(", 1)), F.lit(""))
    d = lines.withColumns({"shape": shape, "_n": F.transform(F.split(body, ","), lambda s: F.trim(s))})
    num = lambda i: F.get("_n", F.lit(i)).try_cast("double")
    third = F.get("_n", F.lit(2))
    radius = F.when(third.endswith('"'), F.replace(third, F.lit('"'), F.lit("")).try_cast("double") / 3600).otherwise(third.try_cast("double"))
    is_ = lambda s: F.col("shape") == s
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("_n") / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get("_n", 2 * i).try_cast("double").alias("x"), F.get("_n", 2 * i + 1).try_cast("double").alias("y")))
    centre = F.when(~is_("polygon"), num(0)), F.when(~is_("polygon"), num(1))
    name = F.nullif(F.regexp_extract(column, r"text=\{([^}]*)\}", 1), F.lit(""))
    out = d.withColumns({"cx": centre[0], "cy": centre[1], "r": F.when(is_("circle"), radius), "w": F.when(is_("box"), num(2)), "h": F.when(is_("box"), num(3)), "a": F.when(is_("ellipse"), num(2)), "b": F.when(is_("ellipse"), num(3)), "theta": F.when(is_("box") | is_("ellipse"), num(4)), "verts": F.when(is_("polygon"), pairs), "name": name, "tags": F.regexp_extract_all(F.col(column), F.lit(r"tag=\{([^}]*)\}"), F.lit(1))})
    return out.drop("_n")


def region_lines(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """value: a DS9 line for each circle, box, ellipse or polygon of a table with the columns of parse_regions, and ``color`` if it
    has one; columns named in ``keep`` come along."""
    deg = lambda c: F.format_string("%.6f", F.col(c))
    shape = (
        F.when(F.col("shape") == "circle", F.concat(F.lit("circle("), F.concat_ws(",", deg("cx"), deg("cy"), F.format_string('%.3f"', F.col("r") * 3600)), F.lit(")")))
        .when(F.col("shape") == "box", F.concat(F.lit("box("), F.concat_ws(",", deg("cx"), deg("cy"), deg("w"), deg("h"), F.coalesce(F.format_string("%.2f", "theta"), F.lit("0"))), F.lit(")")))
        .when(F.col("shape") == "ellipse", F.concat(F.lit("ellipse("), F.concat_ws(",", deg("cx"), deg("cy"), deg("a"), deg("b"), F.format_string("%.2f", "theta")), F.lit(")")))
        .when(F.col("shape") == "polygon", F.concat(F.lit("polygon("), F.array_join(F.transform("verts", lambda p: F.concat(F.format_string("%.6f", p["x"]), F.lit(","), F.format_string("%.6f", p["y"]))), ","), F.lit(")")))
    )
    colour = F.concat(F.lit(" color="), F.coalesce("color", F.lit("white"))) if "color" in rows.columns else F.lit("")
    tail = F.concat(colour, F.when(F.col("name").isNotNull(), F.concat(F.lit(" text={"), "name", F.lit("}"))).otherwise(""), F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit(" tag={"), t, F.lit("}"))), ""))
    return rows.filter("shape is not null").select(*(keep or []), F.concat(shape, F.when(tail != "", F.concat(F.lit(" #"), tail)).otherwise("")).alias("value"))


def island_lines(rows: DataFrame, columns: list[str], header: bool = True) -> DataFrame:
    """value: a row for each island, fields separated by blanks, nulls as -999; the first line names the columns."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.format_string("%.8g", F.coalesce(F.col(c), F.lit(-999.0))) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("-999"))
    body = rows.select(F.concat_ws(" ", *map(text, columns)).alias("value"))
    if not header:
        return body
    return rows.sparkSession.createDataFrame([("# " + " ".join(columns),)], "value string").unionByName(body)


def island_json(islands: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """key, json: a document for each island with its components nested in order.

    An island has a bounded number of components; nothing is collected beyond it.
    """
    nested = components.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in components.columns if c != key]))).alias("components"))
    d = islands.join(nested, key, "left").withColumn("components", F.coalesce("components", F.array().cast(nested.schema["components"].dataType)))
    return d.select(key, F.to_json(F.struct(*d.columns)).alias("json"))


def read_json_catalog(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)
