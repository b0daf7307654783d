"""Robust and clipped statistics of groups: aggregations that merge, and exact order statistics without collecting a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.plans.runtime import cut_lineage

MAD_TO_RMS = 1.4826
# brackets of the exact order statistics: percentile_approx errs by 1/ACCURACY of the ranks at most
ACCURACY, MARGIN, SMALL = 10_000, 0.0005, 4_000
BROADCAST_GROUPS = 50_000  # rows of a few numbers: some MB


def finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def attach(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row a group to the rows. The groups are written and counted first: few are broadcast, so that the rows
    aren't shuffled onto a few hot keys; many are joined as any table."""
    groups = cut_lineage(per_group)
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return df.join(F.broadcast(groups) if few else groups, keys) if keys else df.crossJoin(F.broadcast(groups))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, rms, skewness, kurtosis, min, max of finite values; rms is 0 for two values or fewer."""
    v = F.col(value).cast("double")
    n = F.count("*")
    return df.filter(finite(v)).groupBy(*keys).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.when(n > 2, F.stddev_samp(v)).otherwise(0.0).alias("rms"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def partial_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and central sums m2..m4 of each group, ready to be merged."""
    v = F.col(value).cast("double")
    return df.filter(finite(v)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2"),
        (F.skewness(v) * F.pow(F.var_pop(v), 1.5) * F.count("*")).alias("m3"), ((F.kurtosis(v) + 3.0) * F.pow(F.var_pop(v), 2.0) * F.count("*")).alias("m4"),
    )


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of unions of disjoint parts (n, mean, m2, m3, m4)."""
    total = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    d = parts.join(total, keys).withColumn("d", F.col("mean") - F.col("_mean"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n, dd = F.col("n"), F.col("d")
    return d.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(zero("m2") + n * dd**2).alias("m2"),
        F.sum(zero("m3") + 3 * dd * zero("m2") + n * dd**3).alias("m3"),
        F.sum(zero("m4") + 4 * dd * zero("m3") + 6 * dd**2 * zero("m2") + n * dd**4).alias("m4"),
    )


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, Column]]) -> DataFrame:
    """keys, n and the exact value at each wanted rank.

    wanted: name -> (fraction, 0-based rank as a Column of ``n``). The fraction brackets the rank: values below the
    bracket are only counted, and just those inside it are ranked, so a group of any size is spread over tasks.
    """
    d = df.filter(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_v"))
    cuts = [x for f, _ in wanted.values() for x in (max(0.0, f - MARGIN), min(1.0, f + MARGIN))]
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", cuts, ACCURACY).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    names = list(wanted)
    small = F.col("n") <= SMALL
    ranks = [
        F.struct(
            F.lit(i).alias("i"),
            F.when(small | F.lit(cuts[2 * i] <= 0), F.col("_lo")).otherwise(F.col("_c")[2 * i]).alias("a"),
            F.when(small | F.lit(cuts[2 * i + 1] >= 1), F.col("_hi")).otherwise(F.col("_c")[2 * i + 1]).alias("b"),
            wanted[name][1].cast("long").alias("r"),
        )
        for i, name in enumerate(names)
    ]
    base = base.select(*keys, "n", F.array(*ranks).alias("_w"))
    counted = attach(d, base, keys)
    # below a bracket: one count; inside it: equal values are one row with a count, so that ties don't swell it
    place = F.when(F.col("_v") >= F.col("_q.a"), F.col("_v"))
    long = counted.select(*keys, "n", "_v", F.explode("_w").alias("_q")).filter(F.col("_v") <= F.col("_q.b"))
    ties = long.groupBy(*keys, "n", F.col("_q.i").alias("_i"), F.col("_q.r").alias("_r"), place.alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    hit = ties.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_r")) & (F.col("_upto") - F.col("_k") <= F.col("_r")))
    return hit.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)))


def _middle(compat: bool) -> tuple[Column, Column]:
    """0-based ranks whose mean is the median. compat: the parity of n/2 decides, instead of that of n."""
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    average = (half % 2 == 0) & (half > 0) if compat else n % 2 == 0
    return F.when(average, half - 1).otherwise(half), half


def medians(df: DataFrame, keys: list[str], value: str, compat: bool = False) -> DataFrame:
    """keys, n, median: exact; with ``compat`` by the fast selection's own rule for which ranks are averaged."""
    a, b = _middle(compat)
    d = order_statistics(df, keys, value, {"_m0": (0.5, a), "_m1": (0.5, b)})
    return d.select(*keys, "n", ((F.col("_m0") + F.col("_m1")) / 2).alias("median"))


def mad(df: DataFrame, keys: list[str], value: str, compat: bool = False) -> DataFrame:
    """keys, n, median, mad: the median of absolute deviations from the median (times 1.4826 it estimates the rms)."""
    m = medians(df, keys, value, compat)
    m = cut_lineage(m)
    away = attach(df, m.select(*keys, F.col("median").alias("_m")), keys).withColumn("_d", F.abs(F.col(value).cast("double") - F.col("_m")))
    return m.join(medians(away, keys, "_d", compat).select(*keys, F.col("median").alias("mad")), keys)


def clipped(df: DataFrame, keys: list[str], value: str, k: float = 3.0, iterations: int = 5, tol: float = 0.1) -> DataFrame:
    """keys, mean, rms, median after clipping: keep |x - median| < k·rms (strict) until the rms changes by ``tol`` at most.

    The last statistics stay where nothing survives. Every iteration is an aggregation over intervals, no group is collected.
    """
    v = F.col(value).cast("double")

    def stats(rows: DataFrame) -> DataFrame:
        plain = rows.filter(finite(v)).groupBy(*keys).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("rms"))
        return plain.join(medians(rows, keys, value).select(*keys, "median"), keys)

    now = cut_lineage(stats(df).withColumn("done", F.lit(False)))
    for _ in range(iterations):
        old = now.select(*keys, *(F.col(c).alias("o_" + c) for c in ("mean", "rms", "median", "done")))
        kept = attach(df, old, keys).filter(~F.col("o_done") & (F.abs(v - F.col("o_median")) < k * F.col("o_rms")))
        new = stats(kept.select(*keys, value))
        d = old.join(new, keys, "left")
        moved = F.col("mean").isNotNull() & ~F.col("o_done")
        still = F.abs(F.try_divide("rms", "o_rms") - 1.0) <= tol
        # a group's state is one row; writing it keeps the plan of the next round short
        now = cut_lineage(d.select(*keys, *(F.when(moved, F.col(c)).otherwise(F.col("o_" + c)).alias(c) for c in ("mean", "rms", "median")), (~moved | F.coalesce(still, F.lit(True))).alias("done")))
    return now.drop("done")


def biweight(df: DataFrame, keys: list[str], value: str, c: float = 6.0, iterations: int = 10, tol: float = 1e-4) -> DataFrame:
    """keys, location, scale: Tukey's biweight from the median and mad·1.4826; stops before the scale is updated once the location moves by ``tol`` at most."""
    start = mad(df, keys, value)
    now = start.select(*keys, F.col("median").alias("location"), (F.col("mad") * MAD_TO_RMS).alias("scale"), F.lit(False).alias("done"))
    v = F.col(value).cast("double")
    for _ in range(iterations):
        d = attach(df.filter(finite(v)), now, keys)
        u2 = F.try_divide(v - F.col("location"), c * F.col("scale")) ** 2
        inside = (u2 <= 1.0) & (F.col("scale") > 0)
        w = (1 - u2) ** 2
        sums = d.groupBy(*keys, "location", "scale", "done").agg(
            F.count("*").alias("_n"), F.sum(F.when(inside, w * v)).alias("_wx"), F.sum(F.when(inside, w)).alias("_w"),
            F.sum(F.when(inside, (v - F.col("location")) ** 2 * (1 - u2) ** 4)).alias("_num"), F.sum(F.when(inside, (1 - u2) * (1 - 5 * u2))).alias("_den"),
        )
        location = F.coalesce(F.try_divide("_wx", "_w"), F.col("location"))
        scale = F.when(F.abs(F.col("_den")) > 1.0, F.sqrt(F.col("_n") * F.col("_num")) / F.abs(F.col("_den"))).otherwise(F.col("scale"))
        settled = F.abs(F.try_divide(location, F.col("location")) - 1.0) < tol
        settled = F.coalesce(settled, F.lit(True))
        now = sums.select(*keys, F.when(F.col("done"), F.col("location")).otherwise(location).alias("location"), F.when(F.col("done") | settled, F.col("scale")).otherwise(scale).alias("scale"), (F.col("done") | settled).alias("done"))
    return now.drop("done")


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, q1, median, q3, min, max; quartiles interpolate linearly between ranks (type 7)."""
    n = F.col("n")
    wanted = {}
    for name, f in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (n - 1) * f
        wanted[f"_{name}0"], wanted[f"_{name}1"] = (f, F.floor(at)), (f, F.ceil(at))
    d = order_statistics(df, keys, value, wanted | {"min": (0.0, F.lit(0)), "max": (1.0, n - 1)})
    mid = lambda name, f: (F.col(f"_{name}0") + (F.col(f"_{name}1") - F.col(f"_{name}0")) * ((n - 1) * f - F.floor((n - 1) * f))).alias(name)
    return d.select(*keys, "n", mid("q1", 0.25), mid("median", 0.5), mid("q3", 0.75), "min", "max")


def remove_outliers(df: DataFrame, keys: list[str], value: str, factor: float = 1.5, rounds: int = 3) -> DataFrame:
    """Rows inside Tukey's fences q1 - f·iqr .. q3 + f·iqr, fences being set again ``rounds`` times or until nothing falls out."""
    for _ in range(rounds):
        q = box_stats(df, keys, value).select(*keys, F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
        reach = (F.col("_q3") - F.col("_q1")) * factor
        df = attach(df, q, keys).filter(F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_q1", "_q3")
    return df


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode (the smallest of the commonest values), n_modes."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    top = counts.groupBy(*keys).agg(F.max("_c").alias("_m"))
    return counts.join(top, keys).filter("_c = _m").groupBy(*keys).agg(F.min(value).alias("mode"), F.count("*").alias("n_modes"))


def histogram(df: DataFrame, value: str, bins: int, skip_zero: bool = True) -> DataFrame:
    """bin, count over equal half-open bins from least to greatest; the greatest value itself overflows and isn't counted."""
    v = F.col(value).cast("double")
    d = df.filter(finite(v) & (v != 0 if skip_zero else F.lit(True))).select(v.alias("v"))
    ends = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")
    return d.crossJoin(F.broadcast(ends)).filter("v < hi").groupBy(b.alias("bin"), "lo", "hi").agg(F.count("*").alias("count"))


def otsu(hist: DataFrame, bins: int) -> DataFrame:
    """threshold: the bin edge that parts a histogram (bin, lo, hi, count) with the greatest variance between classes."""
    # a histogram has as many rows as bins
    w = Window.partitionBy(F.lit(1)).orderBy("bin")
    total = Window.partitionBy(F.lit(1))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    d = hist.withColumns({"p": F.col("count") / F.sum("count").over(total), "x": centre})
    d = d.withColumns({"wb": F.sum("p").over(w), "sb": F.sum(F.col("p") * F.col("x")).over(w), "s": F.sum(F.col("p") * F.col("x")).over(total)})
    wf = 1.0 - F.col("wb")
    d = d.filter(wf > 1e-12).withColumn("between", F.col("wb") * (1.0 - F.col("wb")) * (F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / (1.0 - F.col("wb"))) ** 2)
    edge = F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins
    return d.agg(F.max_by(edge, F.struct(F.round("between", 6), -F.col("bin"))).alias("threshold"))


def cumulative_threshold(df: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """keys, threshold: the value at which the ascending running sum reaches ``fraction`` of the total."""
    # equal values are summed first; what is left to order is the distinct values of a group
    sums = df.filter(finite(F.col(value))).groupBy(*keys, value).agg((F.sum(F.col(value).cast("double"))).alias("_s"))
    run = Window.partitionBy(*keys).orderBy(value)
    d = sums.withColumns({"_run": F.sum("_s").over(run), "_all": F.sum("_s").over(Window.partitionBy(*keys))})
    return d.filter(F.col("_run") >= fraction * F.col("_all")).groupBy(*keys).agg(F.min(value).alias("threshold"))


def bootstrap(df: DataFrame, keys: list[str], value: str, samples: int = 100, seed: int = 1) -> DataFrame:
    """keys, mean_err: spread of the mean over Poisson resamples, in one pass; each row is drawn from a hash of its content and the
    sample, whatever its partition. Rows alike in every column are drawn together: give rows of one value a key."""
    v = F.col(value).cast("double")
    d = df.filter(finite(v)).withColumn("_r", F.xxhash64(*df.columns)).select(*keys, v.alias("v"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_k"), "_r")
    u = (F.pmod(F.xxhash64("_r", "_k", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # Poisson(1) by inversion, to where a double is 1
    steps = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1)) for n in range(17)]
    times = sum((F.when(u > p, 1).otherwise(0) for p in steps), F.lit(0))
    means = d.groupBy(*keys, "_k").agg(F.try_divide(F.sum(F.col("v") * times), F.sum(times)).alias("m"))
    return means.groupBy(*keys).agg(F.stddev_samp("m").alias("mean_err"))
