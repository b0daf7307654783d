"""Matching two catalogues without a common key: BM25 over all attributes, mutual test, calibrated confidence.

Every row of the indexed catalogue posts the tokens of the sky cells that its search disc meets, and a bin token for flux
and for size; their document frequencies give the idf weights. A query row scores what its lists hold, each attribute
with a soft term frequency that falls with the difference. Exact pruning: the frequencies of flux and size tokens
are smoothed, so their two lists together have an upper bound, and a match must score more than that bound; no
row that stands in the flux and size lists alone can, so only sky lists are opened and nothing is lost (MaxScore with the
threshold as running bound). Systematic offsets and the reach of each attribute are robust statistics of nearest pairs.
Confidence is a logistic function of the score and of its gap to the best scores of both rows, fitted against decoys:
the same queries displaced on the sky, weighted by distance so that as many of them contradict in flux and in size as do
among the pairs themselves, since real neighbours are commoner than chance ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.plans.runtime import cut_lineage, table

RADIUS = 12.0  # arcsec searched around a row
CELL = 4 * RADIUS / 3600.0 * math.pi / 180.0  # twice a disc: it meets one or two cells along an axis
K1 = 1.2
UNKNOWN = 0.4  # soft frequency of an attribute that one side lacks
SPREADS = {"d": 5.0, "fs": 7.0, "fb": 5.0}  # an attribute agrees up to so many standard deviations; a few fluxes vary
LEAST = {"d": 1.0, "fs": 0.1, "fb": 0.05}  # arcsec and decades: the least reach
MOST = {"d": RADIUS, "fs": 1.0, "fb": 0.5}
SHARE = 50  # the frequency of a flux or size token is smoothed by this part of all rows
BINS_PER_DECADE = 10
DECOYS = ((67.0, 0.0), (0.0, -67.0), (-67.0, 0.0), (0.0, 67.0))
WIDTH = 0.5  # of a bin of score or gap in the calibration


def _value(c: Column) -> Column:
    """The decimal logarithm of a positive value; anything else is missing."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (c > 0) & (c < 1e300), F.log10(c))


def prepare(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(distinct records, members): records have id, ra, dec, s, b (decades); members maps id to every row of the record.

    Rows without a usable position are left out: nothing else tells a source. Exact copies are one record, whose id is
    128 bits of its values, so both tables are made without a join.
    """
    ra, dec = F.col("ra"), F.col("dec")
    ok = ra.isNotNull() & dec.isNotNull() & ~F.isnan(ra) & ~F.isnan(dec) & (ra != -999) & (F.abs(ra) < 1e6) & (F.abs(dec) <= 90) & F.col(key).isNotNull()
    d = rows.filter(ok).select(F.col(key).alias("row"), F.pmod(ra, F.lit(360.0)).alias("ra"), F.col("dec").cast("double").alias("dec"), _value(F.col("s")).alias("s"), _value(F.col("bmaj")).alias("b"))
    values = ["ra", "dec", F.coalesce("s", F.lit(-999.0)), F.coalesce("b", F.lit(-999.0))]
    d = d.withColumn("id", F.struct(F.xxhash64(*values).alias("i"), F.xxhash64(F.lit(7), *values).alias("j")))
    return d.select("id", "ra", "dec", "s", "b").dropDuplicates(["id"]), d.select("id", "row")


def _xyz(df: DataFrame) -> DataFrame:
    r, d = F.radians("ra"), F.radians("dec")
    return df.withColumns({"x": F.cos(d) * F.cos(r), "y": F.cos(d) * F.sin(r), "z": F.sin(d)})


def _bin(c: str) -> Column:
    return F.floor(F.least(F.greatest(F.col(c), F.lit(-20.0)), F.lit(20.0)) * BINS_PER_DECADE).cast("int")


def _cell(*axes: Column) -> Column:
    """One number for a cell of the cube around the unit sphere."""
    return (axes[0] * 16384 + axes[1]) * 16384 + axes[2]


def _axis(c: Column) -> Column:
    return F.floor((c + 1.0) / CELL).cast("long")


def _idf(n, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def _saturated(tf):
    return tf * (K1 + 1) / (tf + K1)


def index(records: DataFrame) -> tuple[DataFrame, float]:
    """Postings by sky cell, with the idf weights of sky, flux and size tokens; and the most that flux and size can score."""
    d = _xyz(records).withColumns({"sb": _bin("s"), "bb": _bin("b")})
    n, most = None, 0.0
    for token, weight in (("sb", "w_s"), ("bb", "w_b")):
        # at most 401 bins and the missing, whatever the data
        bins = d.groupBy(token).count().collect()
        n = float(sum(r["count"] for r in bins))
        weights = [(r[token], math.log1p((n - r["count"] + 0.5) / (r["count"] + n / SHARE + 0.5)) if n > r["count"] else 0.0) for r in bins if r[token] is not None]
        small = d.sparkSession.createDataFrame(weights, f"{token} int, {weight} double")
        common = float(np.median([w for _, w in weights])) if weights else 0.0
        # an attribute that the posting lacks has no token: it weighs as a usual one
        d = d.join(F.broadcast(small), token, "left").withColumn(weight, F.coalesce(weight, F.lit(common)))
        most += max([w for _, w in weights] + [common])
    reach = CELL / 4 + 1e-12
    for a in "xyz":
        lo, hi = (_axis(F.col(a) + s * reach) for s in (-1, 1))
        d = d.withColumn(f"c{a}", F.explode(F.sequence(lo, hi)))
    # cells that the unit sphere misses are dropped before the shuffle
    centre = [(F.col(f"c{a}") + 0.5) * CELL - 1.0 for a in "xyz"]
    norm = F.sqrt(centre[0] ** 2 + centre[1] ** 2 + centre[2] ** 2)
    d = d.filter(F.abs(norm - 1.0) <= CELL * 0.8661).withColumn("cell", _cell(*(F.col(f"c{a}") for a in "xyz")))
    d = d.select("cell", F.col("id").alias("p"), "ra", "dec", "s", "b", "x", "y", "z", "w_s", "w_b")
    freq = d.groupBy("cell").agg(_idf(F.lit(n), F.count("*")).alias("w_sky"))
    return d.join(freq, "cell"), most


def displaced(queries: DataFrame) -> DataFrame:
    """The queries as they are (way 0) and displaced in each direction of DECOYS (ways 1, 2, ...)."""
    ways = F.array(*(F.struct(F.lit(k).alias("way"), F.lit(e / 3600.0).alias("e"), F.lit(n / 3600.0).alias("n")) for k, (e, n) in enumerate([(0.0, 0.0), *DECOYS])))
    d = queries.withColumn("w", F.explode(ways))
    return d.select(
        "id", F.col("w.way").alias("way"), "s", "b",
        F.when(F.col("w.way") == 0, F.col("ra")).otherwise(F.pmod(F.col("ra") + F.col("w.e") / F.greatest(F.cos(F.radians("dec")), F.lit(1e-3)), F.lit(360.0))).alias("ra"),
        F.least(F.greatest(F.col("dec") + F.col("w.n"), F.lit(-90.0)), F.lit(90.0)).alias("dec"),
    )


def lookup(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Candidate pairs within RADIUS: way, q, p, offsets dx, dy (arcsec, query minus posting), fs, fb (decades), weights."""
    d = _xyz(queries).withColumn("cell", _cell(*(_axis(F.col(a)) for a in "xyz")))
    q = d.select("cell", "way", F.col("id").alias("q"), *(F.col(c).alias("q_" + c) for c in ("ra", "dec", "s", "b", "x", "y", "z")))
    chord2 = (F.col("q_x") - F.col("x")) ** 2 + (F.col("q_y") - F.col("y")) ** 2 + (F.col("q_z") - F.col("z")) ** 2
    pairs = q.join(postings, "cell").filter(chord2 <= (CELL / 4) ** 2)
    dra = F.pmod(F.col("q_ra") - F.col("ra") + 180.0, F.lit(360.0)) - 180.0
    # near the poles the angle between meridians isn't small: the offset to the east is the tangent-plane one
    dx = F.cos(F.radians("q_dec")) * F.sin(F.radians(dra)) * (180.0 / math.pi)
    dy = (F.sin(F.radians("q_dec")) * F.cos(F.radians("dec")) - F.cos(F.radians("q_dec")) * F.sin(F.radians("dec")) * F.cos(F.radians(dra))) * (180.0 / math.pi)
    return pairs.select("way", "q", "p", (dx * 3600.0).alias("dx"), (dy * 3600.0).alias("dy"), (F.col("q_s") - F.col("s")).alias("fs"), (F.col("q_b") - F.col("b")).alias("fb"), "w_sky", "w_s", "w_b")


def offsets(pairs: DataFrame) -> dict[str, float]:
    """Median systematic differences dx, dy, fs, fb and the reach of d, fs, fb, over nearest pairs: of each query its nearest
    row, and of each row the nearest of these."""
    near = F.struct((F.col("dx") ** 2 + F.col("dy") ** 2).alias("d2"), "p", "q", "dx", "dy", "fs", "fb")
    one = pairs.filter("way = 0").groupBy("q").agg(F.min(near).alias("n")).groupBy("n.p").agg(F.min("n").alias("n")).select("n.*").filter(f"d2 < {(RADIUS / 2) ** 2}")
    row = one.agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in ("dx", "dy", "fs", "fb"))).first()
    out = {c: float(row[c][1]) if row[c] else 0.0 for c in ("dx", "dy", "fs", "fb")}
    spread = {c: (row[c][2] - row[c][0]) / 1.349 if row[c] else 0.0 for c in ("dx", "dy", "fs", "fb")}
    spread["d"] = math.sqrt((spread["dx"] ** 2 + spread["dy"] ** 2) / 2)
    for c, k in SPREADS.items():
        out["reach_" + c] = min(max(k * spread[c], LEAST[c]), MOST[c])
    return out


def score(pairs: DataFrame, fit: dict[str, float]) -> DataFrame:
    """way, q, p, ``score`` (the BM25 sum over sky, flux and size), the corrected distance d, and whether flux and size both contradict."""
    d = pairs.withColumns({"d": F.sqrt((F.col("dx") - fit["dx"]) ** 2 + (F.col("dy") - fit["dy"]) ** 2), "fs": F.abs(F.col("fs") - fit["fs"]), "fb": F.abs(F.col("fb") - fit["fb"])})

    def part(weight: str, c: str) -> Column:
        difference = F.col(c)
        tf = F.when(difference.isNull(), F.lit(UNKNOWN)).otherwise(F.greatest(F.lit(0.0), 1.0 - (difference / fit["reach_" + c]) ** 2))
        return F.col(weight) * _saturated(tf)

    off = (F.col("fs") >= fit["reach_fs"]) & (F.col("fb") >= fit["reach_fb"])
    return d.select("way", "q", "p", (part("w_sky", "d") + part("w_s", "fs") + part("w_b", "fb")).alias("score"), "d", F.coalesce(off, F.lit(False)).alias("off")).filter(F.col("d") < fit["reach_d"])


def with_gap(pairs: DataFrame) -> DataFrame:
    """Add ``gap``: how far the score lies below the best that either row has in its place (way 0); 0 for mutual best pairs."""
    real = pairs.filter("way = 0")
    best_q, best_p = (real.groupBy(end).agg(F.max("score").alias(name)) for end, name in (("q", "best_q"), ("p", "best_p")))
    d = pairs.join(best_q, "q", "left").join(best_p, "p", "left")
    return d.withColumn("gap", F.greatest(F.coalesce("best_q", F.lit(0.0)), F.coalesce("best_p", F.lit(0.0)), F.col("score")) - F.col("score")).drop("best_q", "best_p")


def _binned(scored: DataFrame) -> list[tuple[bool, int, int, int, bool, int]]:
    """(decoy, score bin, gap bin, distance bin, off, pairs): a bounded table, whatever the data."""
    s, g = (F.least(F.round(F.col(c) / WIDTH), F.lit(m)).cast("int") for c, m in (("score", 120), ("gap", 60)))
    rows = scored.groupBy((F.col("way") > 0).alias("decoy"), s.alias("s"), g.alias("g"), F.floor("d").cast("int").alias("d"), "off").count().collect()
    return [(r["decoy"], r["s"], r["g"], r["d"], r["off"], r["count"]) for r in rows]


def false_pairs(binned) -> dict[tuple[int, int], float]:
    """Expected false pairs in each bin of score and gap: decoys, weighted by distance to have as many contradictions as the pairs."""
    far = int(RADIUS) + 1
    real, decoy = np.zeros(far), np.zeros(far)
    for is_decoy, _, _, d, off, n in binned:
        if off:
            (decoy if is_decoy else real)[min(d, far - 1)] += n
    weight = (real + 1.0) / (decoy + len(DECOYS))
    out: dict[tuple[int, int], float] = {}
    for is_decoy, s, g, d, _, n in binned:
        if is_decoy:
            out[s, g] = out.get((s, g), 0.0) + n * weight[min(d, far - 1)]
    return out


def calibrate(binned) -> np.ndarray:
    """Weights of a logistic function of (1, score, gap) from counts of binned pairs, over all data.

    Of the pairs in a bin those are true that exceed the expected false ones.
    """
    good, bad = {}, false_pairs(binned)
    for is_decoy, s, g, _, _, n in binned:
        if not is_decoy:
            good[s, g] = good.get((s, g), 0.0) + n
    points = sorted(set(good) | set(bad))
    if not points:
        return np.array([-1.0, 0.0, 0.0])
    x = np.array([[1.0, s * WIDTH, g * WIDTH] for s, g in points])
    false = np.array([bad.get(p, 0.0) for p in points])
    true = np.maximum(np.array([good.get(p, 0.0) for p in points]) - false, 0.0)
    y, n = true, true + false
    w, ridge = np.zeros(3), np.diag([1e-6, 1e-3, 1e-3])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - n * mu) - ridge @ w
        step = np.linalg.solve((x * (n * mu * (1 - mu))[:, None]).T @ x + ridge, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def scored_pairs(a: DataFrame, b: DataFrame) -> tuple[DataFrame, np.ndarray, float, list]:
    """Pairs of records and decoys with score and gap, the weights of the confidence, the score a match must exceed, and the binned counts."""
    postings, bound = index(cut_lineage(b))
    pairs = cut_lineage(lookup(displaced(a), postings))
    scored = cut_lineage(with_gap(score(pairs, offsets(pairs))))
    binned = _binned(scored)
    return scored, calibrate(binned), bound, binned


def _confidence(w: np.ndarray) -> Column:
    return 1.0 / (1.0 + F.exp(-(float(w[0]) + float(w[1]) * F.col("score") + float(w[2]) * F.col("gap"))))


def link(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = 0.5) -> DataFrame:
    """left_key, right_key, confidence: rows of two catalogues (ra, dec in degrees, s, bmaj) that are one source.

    A source listed twice gives a pair for each row, so partners aren't limited in number; rows without a usable position
    are in no pair; a missing flux or size neither speaks for nor against. Other columns are ignored; an empty table gives no rows.
    """
    (a, a_rows), (b, b_rows) = prepare(left, left_key), prepare(right, right_key)
    scored, w, bound, _ = scored_pairs(a, b)
    kept = scored.filter((F.col("way") == 0) & (F.col("score") > bound)).withColumn("confidence", _confidence(w)).filter(F.col("confidence") >= threshold)
    out = kept.select("q", "p", "confidence")
    out = out.join(a_rows.select(F.col("id").alias("q"), F.col("row").alias(left_key)), "q")
    out = out.join(b_rows.select(F.col("id").alias("p"), F.col("row").alias(right_key)), "p")
    return out.select(left_key, right_key, "confidence")


def reliability(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Calibration measured: of each tenth of confidence the pairs of records, the false ones that the decoys lead one to
    expect, and the mean confidence, which ought to be near 1 - false / pairs."""
    (a, _), (b, _) = prepare(left, left_key), prepare(right, right_key)
    scored, w, bound, binned = scored_pairs(a, b)
    false = [(int(s), int(g), float(n)) for (s, g), n in false_pairs(binned).items()]
    spark = left.sparkSession
    real = scored.filter(F.col("way") == 0).select("score", "gap", F.lit(1.0).alias("n"), F.lit(0.0).alias("f"))
    expected = spark.createDataFrame(false, "s int, g int, n double").select((F.col("s") * WIDTH).alias("score"), (F.col("g") * WIDTH).alias("gap"), F.lit(0.0).alias("n"), F.col("n").alias("f"))
    both = real.unionByName(expected).filter(F.col("score") > bound).withColumn("c", _confidence(w))
    return both.groupBy(F.least(F.floor(F.col("c") * 10), F.lit(9)).cast("int").alias("decile")).agg(F.sum("n").cast("long").alias("pairs"), F.sum("f").alias("expected_false"), (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("mean_confidence"))


def p4_pairs(spark, sf_dir):
    return link(table(spark, sf_dir, "cat_mgps"), table(spark, sf_dir, "cat_own"), "mgps_id", "own_id")


def p4_found(spark, sf_dir):
    return p4_pairs(spark, sf_dir).select("mgps_id", "own_id")


def p4_reliability(spark, sf_dir):
    return reliability(table(spark, sf_dir, "cat_mgps"), table(spark, sf_dir, "cat_own"), "mgps_id", "own_id")
