"""Samples, pairs and random positions. A draw depends on a hash of the row's key, so a retried task draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the keys of a row."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def random_k(df: DataFrame, key: str, k: int, seed: int = 1) -> DataFrame:
    """k distinct rows, every set as likely: the rows with the smallest hashes (a top-k, no full sort)."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def resamples(df: DataFrame, key: str, samples: int, fraction: float = 1.0, seed: int = 1) -> DataFrame:
    """sample and the rows of ``samples`` draws with replacement: each row comes Poisson(fraction) times in each."""
    d = df.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u, p, total, steps = uniform(seed, F.col(key), F.col("sample")), math.exp(-fraction), 0.0, []
    for n in range(12):
        total += p
        steps.append(F.when(u > total, 1).otherwise(0))
        p *= fraction / (n + 1)
    return d.withColumn("_times", sum(steps, F.lit(0))).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def triangle_pairs(spark, n: int) -> DataFrame:
    """i, j, packed: the pairs i < j of 0..n-1 and their place in a packed upper triangle."""
    # the last number has no partner above it
    d = spark.range(max(n - 1, 0)).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("j"))
    return d.select("i", "j", (F.col("i") * n - F.floor(F.col("i") * (F.col("i") + 3) / 2) + F.col("j") - 1).cast("long").alias("packed"))


def positions_in_box(rows: DataFrame, key: str, x0: float, x1: float, y0: float, y1: float, inside, tries: int = 50, seed: int = 1) -> DataFrame:
    """Add x, y: for each row the first of ``tries`` random positions in a box that ``inside(x, y)`` accepts; null if none does."""
    def spot(k: Column) -> Column:
        return F.struct((x0 + (x1 - x0) * uniform(seed, F.col(key), k)).alias("x"), (y0 + (y1 - y0) * uniform(seed + 1, F.col(key), k)).alias("y"))

    spots = F.filter(F.transform(F.sequence(F.lit(1), F.lit(tries)), spot), lambda p: inside(p["x"], p["y"]))
    return rows.withColumn("_p", F.get(spots, F.lit(0))).select("*", "_p.x", "_p.y").drop("_p")


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """column, n: the values that come more than once; nulls aren't values."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
