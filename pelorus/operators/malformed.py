"""Rows that fail to parse: cells against a rule table, errors set apart with their reason, clean rows loaded.

A line is parsed into cells (row, column, value); row-level facts (quoting, number of fields) are the
cell of column 0. Cells meet a small rule table on their column, each rule's validation is evaluated,
the first failing rule of a row is its reason, and the anti-join of rows and errors is the clean load.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# possessive groups: matched by iteration, so very long fields and lines don't exhaust the stack
FIELD = r'(?:"(?:[^"]++|"")*+"|[^ \t"]++)'
WELL_QUOTED = rf"\A[ \t]*+(?:{FIELD}(?:[ \t]++|\z))*+\z"
COMMENT = r"\A[ \t]*+(?:\z|[#*/])"
NUMBER = r"\A[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"


@dataclass(frozen=True)
class Rule:
    """One validation of a column (1-based; 0 is the row itself): kind quoting, columns, filled or number."""

    reason: str
    column: int
    kind: str
    low: float | None = None
    high: float | None = None
    high_open: bool = False


SELAVY_COLUMNS = 37.0
SELAVY_RULES = (
    Rule("quoting", 0, "quoting"),
    Rule("columns", 0, "columns", SELAVY_COLUMNS, SELAVY_COLUMNS),
    Rule("component_name", 3, "filled"),
    Rule("ra_deg_cont", 6, "number", 0.0, 360.0, True),
    Rule("dec_deg_cont", 7, "number", -90.0, 90.0),
)


def unquote(field: Column) -> Column:
    """The content of a field: enclosing quotes removed, doubled quotes made one."""
    return F.when(field.startswith('"'), F.replace(F.substring(field, 2, F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def parse_lines(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Rows of ``lines`` that are data, with ``cells`` (array of values, null where the quoting is broken).

    Null, blank and comment lines are no rows. Any other column is kept.
    """
    rows = lines.filter(F.col(raw).isNotNull() & ~F.col(raw).rlike(COMMENT))
    fields = F.transform(F.regexp_extract_all(F.col(raw), F.lit(FIELD), F.lit(0)), unquote)
    return rows.withColumn("cells", F.when(F.col(raw).rlike(WELL_QUOTED), fields))


def _fails(kind: Column, value: Column, low: Column, high: Column, high_open: Column) -> Column:
    number = F.when(value.rlike(NUMBER), value.try_cast("double"))
    outside = number.isNull() | F.isnan(number) | (number < low) | (number > high) | (high_open & (number >= high))
    return (
        F.when(kind == "quoting", value.isNull())
        .when(kind == "columns", value.isNotNull() & outside)
        .when(kind == "filled", F.trim(F.translate(F.coalesce(value, F.lit("")), "\t", " ")) == "")
        .when(kind == "number", F.coalesce(outside, F.lit(True)))
        .otherwise(False)
    )


def row_errors(parsed: DataFrame, key: list[str], rules: tuple[Rule, ...] = SELAVY_RULES) -> DataFrame:
    """One row per failing row: the key and ``reason``, the first rule in order that fails.

    A column that a row lacks isn't validated: the number of fields is reported instead.
    """
    spark = parsed.sparkSession
    # the rule table has a handful of rows, whatever the data
    rule_rows = [(i, r.reason, r.column, r.kind, r.low, r.high, r.high_open) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rule_rows, "rule int, reason string, column int, kind string, low double, high double, high_open boolean")
    ruled = F.lit(sorted({r.column for r in rules if r.column > 0}))
    whole = F.struct(F.lit(0).alias("column"), F.size("cells").cast("string").alias("value"))
    cells = F.filter(F.transform("cells", lambda v, i: F.struct((i + 1).alias("column"), v.alias("value"))), lambda c: F.array_contains(ruled, c["column"]))
    row_cell = F.array(F.when(F.col("cells").isNull(), F.struct(F.lit(0).alias("column"), F.lit(None).cast("string").alias("value"))).otherwise(whole))
    long = parsed.select(*key, F.explode(F.concat(row_cell, F.coalesce(cells, F.array().cast("array<struct<column:int,value:string>>")))).alias("cell")).select(*key, "cell.column", "cell.value")
    failed = long.join(F.broadcast(table), "column").filter(_fails(F.col("kind"), F.col("value"), F.col("low"), F.col("high"), F.col("high_open")))
    return failed.groupBy(*key).agg(F.min(F.struct("rule", "reason")).alias("first")).select(*key, F.col("first.reason").alias("reason"))


def split_rows(lines: DataFrame, key: str = "line_id", raw: str = "raw_line", rules: tuple[Rule, ...] = SELAVY_RULES) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): parsed rows that pass every rule, and failing rows with ``reason``.

    Repeated rows are kept as often as they come; rows with a null key are split like any other, since the
    key is compared with the raw line and null-safely. Empty input gives two empty frames.
    """
    parsed = parse_lines(lines, raw)
    keyed = parsed.withColumns({"_k": F.struct(F.col(key).alias("k"), F.xxhash64(raw).alias("h"))})
    errors = row_errors(keyed, ["_k"], rules)
    clean = keyed.join(errors, "_k", "left_anti").drop("_k")
    rejected = keyed.join(errors, "_k").drop("_k", "cells")
    return clean, rejected


def load_selavy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clean rows as a typed table of the named fields, and the rejected rows."""
    clean, rejected = split_rows(lines)
    at = lambda i: F.get(F.col("cells"), F.lit(i))
    typed = {"island_id": at(0), "component_id": at(1), "component_name": at(2)} | {n: at(i).try_cast("double") for n, i in (("ra_deg_cont", 5), ("dec_deg_cont", 6), ("ra_err", 7), ("dec_err", 8), ("freq", 9), ("flux_peak", 10), ("flux_peak_err", 11), ("flux_int", 12), ("flux_int_err", 13), ("maj_axis", 14), ("min_axis", 15), ("pos_ang", 16))}
    return clean.withColumns(typed).drop("cells"), rejected
