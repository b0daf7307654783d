"""Queries of catalogue readers and writers and of the streaming extension, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pelorus.sources import catalogs
from pelorus.streaming import tiles
from pelorus.plans.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT region_id, shape, CASE WHEN shape <> 'polygon' THEN round(cx, 5) END AS cx, CASE WHEN shape <> 'polygon' THEN round(cy, 5) END AS cy, round(r, 2) AS r_arcsec, round(w, 4) AS w, round(h, 4) AS h,
 CASE WHEN shape = 'polygon' THEN CAST(len(verts) AS INTEGER) ELSE 0 END AS n_verts, name, CAST(len(coalesce(tags, [])) AS INTEGER) AS n_tags FROM skyregions WHERE r IS NOT NULL OR shape <> 'circle'""")
def ds9_regions(spark, sf_dir):
    d = catalogs.parse_regions(table(spark, sf_dir, "skyregions").filter("r is not null or shape <> 'circle'").select("region_id", "region_text"), "region_text")
    return d.select("region_id", "shape", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round(F.col("r") * 3600, 2).alias("r_arcsec"), F.round("w", 4).alias("w"), F.round("h", 4).alias("h"), F.when(F.col("shape") == "polygon", F.size("verts")).otherwise(0).alias("n_verts"), "name", F.size("tags").alias("n_tags"))


@query("""SELECT mgps_id, name, ra, dec, CASE WHEN isnan(s) THEN NULL ELSE s END AS flux, bmaj FROM cat_mgps WHERE s IS NOT NULL AND bmaj IS NOT NULL AND ra IS NOT NULL AND dec IS NOT NULL""")
def mgps_round_trip(spark, sf_dir):
    """The survey's rows written in its text format and parsed again."""
    d = table(spark, sf_dir, "cat_mgps").filter("s is not null and bmaj is not null and ra is not null and dec is not null")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = d.select("mgps_id", F.concat_ws("|", "name", *map(text, ("ra", "dec", "ra_err", "dec_err", "fluxdensity")), F.lit(""), *map(text, ("s", "s_err", "bmaj", "bmin", "pa"))).alias("value"))
    p = catalogs.parse(lines, "mgps")
    return p.select("mgps_id", "name", "ra", "dec", F.when(~F.isnan("flux"), F.col("flux")).alias("flux"), "bmaj")


@query("""SELECT region_id, CAST(len(verts) AS INTEGER) AS n, round(list_sum(list_transform(verts, lambda p: p.x)), 4) AS sx FROM skyregions WHERE shape = 'polygon' AND len(verts) > 0""")
def ds9_round_trip(spark, sf_dir):
    """Polygons written as region lines and parsed again."""
    d = table(spark, sf_dir, "skyregions").filter("shape = 'polygon' and size(verts) > 0").select(F.col("region_id").cast("string").alias("name"), "shape", "cx", "cy", "r", "w", "h", "verts", "tags", F.lit(0.0).alias("theta"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    p = catalogs.parse_regions(catalogs.region_lines(d))
    return p.select(F.col("name").cast("long").alias("region_id"), F.size("verts").alias("n"), F.round(F.aggregate("verts", F.lit(0.0), lambda a, v: a + v["x"]), 4).alias("sx"))


@query("SELECT coalesce(image_id, '-999') AS image_id, count(*) AS n_lines FROM components GROUP BY 1")
def island_ascii(spark, sf_dir):
    d = table(spark, sf_dir, "components")
    lines = catalogs.island_lines(d, ["image_id", "sname", "npix", "x0_wcs", "y0_wcs", "s", "morphid"], header=False)
    return lines.groupBy(F.split("value", " ")[0].alias("image_id")).agg(F.count("*").alias("n_lines"))


@query("""SELECT o_orderkey, CAST(count(l_orderkey) AS INTEGER) AS n_components, round(sum(l_quantity), 4) AS flux FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def json_catalog(spark, sf_dir):
    """Orders as islands and lines as components: nested documents written and read again."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    docs = catalogs.island_json(table(spark, sf_dir, "orders"), li, "o_orderkey")
    back = F.from_json("json", "o_orderkey long, components array<struct<l_quantity:double>>")
    d = docs.select(back.alias("d")).select("d.o_orderkey", "d.components").filter(F.size("components") > 0)
    return d.select("o_orderkey", F.size("components").alias("n_components"), F.round(F.aggregate(F.col("components"), F.lit(0.0), lambda a, c: a + c["l_quantity"]), 4).alias("flux"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tile_counts(spark, sf_dir):
    d = tiles.windowed(table(spark, sf_dir, "events"))
    return d.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tile_counts(spark, sf_dir):
    d = tiles.run_to_table(spark, f"{sf_dir}/events.parquet", f"tile_counts_{os.getpid()}_{abs(hash(sf_dir)) % 10**9}")
    return d.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
