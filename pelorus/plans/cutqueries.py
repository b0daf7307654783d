"""Every registered cut by itself on the catalogue of components, grouped to islands, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelorus.operators import cuts
from pelorus.plans.runtime import table

QUERIES: dict = {}
SQL: dict = {}

#: cut -> (its line, the SQL of passing: of an island i, or of a component c of island i)
_ISLAND = {
    "nPixels": ("nPixels T >= AND {12}", "npix >= 12"),
    "nComponents": ("nComponents T <= AND {2}", "n_components <= 2"),
    "minBoundingBox": ("minBoundingBox T >= AND {2}", "min_box >= 2"),
    "goodSourceFlag": ("goodSourceFlag T == AND {1}", "good"),
    "circRatio": ("circRatio T >= AND {0.4}", "circularity >= 0.4"),
    "elongation": ("elongation T <= AND {0.7}", "elongation <= 0.7"),
    "ellipseAreaRatio": ("ellipseAreaRatio T <> AND {0.6} {1.4}", "ellipse_ratio BETWEEN 0.6 AND 1.4"),
    "beamAreaRatio": ("beamAreaRatio T <> AND {5} {10}", "beam_area <= 0 OR npix / beam_area BETWEEN 5 AND 10"),
    "sourceMorphology": ("sourceMorphology T == OR {1,2}", "morph_id IN (1, 2)"),
    "sourceness": ("sourceness T != OR {1}", "sourceness_id <> 1"),
    "sourceSimType": ("sourceSimType T == OR {2,5}", "sim_type IN (2, 5)"),
    "isExtended": ("isExtended T - AND", "beam_area <= 0 OR n_components > 3 OR npix / beam_area > 20 OR (npix / beam_area > 10 AND (NOT has_fit OR chi2 / ndf > 10))"),
    "isCompact": ("isCompact T - AND", "n_components <= 3 AND (CASE WHEN beam_area <> 0 THEN npix / beam_area <= 10 END OR (has_fit AND chi2 / ndf <= 10))"),
    "hasPixelsAtEdge": ("hasPixelsAtEdge T == AND {0}", "NOT at_edge"),
    "hasFit": ("hasFit T == AND {1}", "has_fit"),
    "fitStatus": ("fitStatus T == OR {3,4}", "NOT has_fit OR fit_status IN (3, 4)"),
    "hasGoodFitChi2": ("hasGoodFitChi2 T <= AND {1.1}", "NOT has_fit OR chi2 / ndf <= 1.1"),
    "fitQualityFlag": ("fitQualityFlag T == OR {2,3}", "NOT has_fit OR fit_quality IN (2, 3)"),
    "fitFlux": ("fitFlux T >= AND {0.01}", "NOT has_fit OR flux >= 0.01"),
    "fitFluxToIslandRatio": ("fitFluxToIslandRatio T <= AND {1.2}", "flux / s <= 1.2"),
}
_COMPONENT = {
    "fitComponentFlux": ("fitComponentFlux T >= AND {0.01}", "c.flux >= 0.01"),
    "fitComponentCentroidInsideIsland": ("fitComponentCentroidInsideIsland T == AND {1}", "c.inside"),
    "fitComponentPeakFluxToMaxRatio": ("fitComponentPeakFluxToMaxRatio T <> AND {0.3} {2}", "c.a / i.smax BETWEEN 0.3 AND 2"),
    "fitComponentIntToPeakFluxRatio": ("fitComponentIntToPeakFluxRatio T <= AND {1.5}", "c.flux / c.a - 2.03 / (c.a / (i.rms_sum / i.npix)) <= 1.5"),
    "fitComponentPeakSignificance": ("fitComponentPeakSignificance T >= AND {20}", "(c.a - i.bkg_sum / i.npix) / (i.rms_sum / i.npix) >= 20"),
    "fitComponentPeakSNR": ("fitComponentPeakSNR T >= AND {20}", "c.a / (i.rms_sum / i.npix) >= 20"),
    "fitComponentEccentricityRatio": ("fitComponentEccentricityRatio T <> AND {0.5} {1.5}", "c.ecc_ratio BETWEEN 0.5 AND 1.5"),
    "fitComponentBeamAreaRatio": ("fitComponentBeamAreaRatio T >< AND {0.5} {1.5}", "c.area_ratio <= 0.5 OR c.area_ratio >= 1.5"),
    "fitComponentMorphology": ("fitComponentMorphology T == OR {1,2}", "c.morph_id IN (1, 2)"),
    "fitComponentSourceness": ("fitComponentSourceness T == OR {1}", "c.sourceness_id = 1"),
}
_APART = 60
_LINES = {**{k: v[0] for k, v in _ISLAND.items()}, **{k: v[0] for k, v in _COMPONENT.items()}, cuts.ISOLATED: f"{cuts.ISOLATED} T >= AND {{{_APART}}}"}


def islands(spark, sf_dir):
    """Islands of the components that share catalogindex and sname; what the table lacks is made of npix and comp_id."""
    c = F.col
    d = table(spark, sf_dir, "components").filter("catalogindex is not null and sname is not null")
    one = F.struct(c("comp_id"), c("fittedflux").alias("flux"), "a", "x0", "y0", (c("comp_id") % 3 != 0).alias("inside"), ((c("comp_id") % 9) / 4.0).alias("ecc_ratio"), ((c("comp_id") % 11) / 4.0).alias("area_ratio"), c("morphid").alias("morph_id"), c("sourcenessid").alias("sourceness_id"))
    # an island has a handful of components
    g = d.groupBy("catalogindex", "sname").agg(
        F.max("npix").alias("npix"), F.count("*").cast("int").alias("n_components"), F.max("morphid").alias("morph_id"), F.max("sourcenessid").alias("sourceness_id"), F.max("chi2").alias("chi2"),
        F.max("ndf").alias("ndf"), F.max("fitquality").alias("fit_quality"), F.max("fittedflux").alias("flux"), F.max("s").alias("s"), F.max("a").alias("smax"), F.array_sort(F.collect_list(one)).alias("components"),
    )
    n = c("npix")
    return g.withColumns({
        "min_box": (n % 7).cast("double"), "good": n % 3 != 0, "circularity": (n % 10) / 10.0, "elongation": (n % 8) / 8.0, "ellipse_ratio": (n % 13) / 8.0, "beam_area": (n % 5).cast("double"),
        "sim_type": (n % 6).cast("int"), "at_edge": n % 4 == 0, "has_fit": n % 6 != 0, "fit_status": (n % 5).cast("int"), "bkg_sum": n * 0.001, "rms_sum": n * 0.0005,
    })


_ISLANDS_SQL = """WITH RECURSIVE p AS (SELECT catalogindex || '|' || sname AS k, comp_id, fittedflux AS flux, a, x0, y0, comp_id % 3 <> 0 AS inside, (comp_id % 9) / 4.0 AS ecc_ratio, (comp_id % 11) / 4.0 AS area_ratio,
  morphid AS morph_id, sourcenessid AS sourceness_id, npix, chi2, ndf, fitquality, s FROM components WHERE catalogindex IS NOT NULL AND sname IS NOT NULL),
g AS (SELECT k, max(npix) AS npix, count(*) AS n_components, max(morph_id) AS morph_id, max(sourceness_id) AS sourceness_id, max(chi2) AS chi2, max(ndf) AS ndf, max(fitquality) AS fit_quality, max(flux) AS flux, max(s) AS s, max(a) AS smax FROM p GROUP BY k),
i AS (SELECT *, npix % 7 AS min_box, npix % 3 <> 0 AS good, (npix % 10) / 10.0 AS circularity, (npix % 8) / 8.0 AS elongation, (npix % 13) / 8.0 AS ellipse_ratio, CAST(npix % 5 AS DOUBLE) AS beam_area, npix % 6 AS sim_type, npix % 4 = 0 AS at_edge,
  npix % 6 <> 0 AS has_fit, npix % 5 AS fit_status, npix * 0.001::DOUBLE AS bkg_sum, npix * 0.0005::DOUBLE AS rms_sum FROM g),
o AS (SELECT p.k, row_number() OVER (PARTITION BY p.k ORDER BY p.a DESC, p.comp_id) AS n, p.x0, p.y0 FROM p JOIN i ON i.k = p.k WHERE i.has_fit),
z AS (SELECT k, n, [{'x': x0, 'y': y0}] AS kept FROM o WHERE n = 1 UNION ALL
  SELECT z.k, o.n, CASE WHEN len(list_filter(z.kept, lambda e: abs(e.x - o.x0) < __APART__ AND abs(e.y - o.y0) < __APART__)) = 0 THEN list_append(z.kept, {'x': o.x0, 'y': o.y0}) ELSE z.kept END FROM z JOIN o ON o.k = z.k AND o.n = z.n + 1),
zz AS (SELECT k, max_by(kept, n) AS kept FROM z GROUP BY k)
""".replace("__APART__", str(_APART))


def cut_registry(spark, sf_dir):
    """cut, rows: the islands that pass each island cut, and the components left by each component cut, alone."""
    d = islands(spark, sf_dir)
    columns = dict(d.dtypes)
    fitted = F.col("has_fit")
    counts = []
    for name, line in _LINES.items():
        cut = cuts.parse_cuts(line)[0]
        if name in _ISLAND:
            n = F.sum(cuts.island_cut(cut, columns).cast("long"))
        else:
            kept = cuts.isolated(F.col("components"), cut) if name == cuts.ISOLATED else F.filter("components", cuts.component_test(cut))
            n = F.sum(F.size(F.when(fitted, kept).otherwise(F.col("components"))).cast("long"))
        counts.append(F.struct(F.lit(name).alias("cut"), n.alias("rows")))
    return d.agg(F.array(*counts).alias("all")).select(F.inline("all"))


QUERIES["cut_registry"] = cut_registry
SQL["cut_registry"] = _ISLANDS_SQL + "\nUNION ALL ".join(
    [f"SELECT '{k}' AS cut, CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS rows FROM i" for k, (_, test) in _ISLAND.items()]
    + [f"SELECT '{k}', CAST(sum(CASE WHEN NOT i.has_fit OR ({test}) THEN 1 ELSE 0 END) AS BIGINT) FROM p c JOIN i ON i.k = c.k" for k, (_, test) in _COMPONENT.items()]
    + [f"SELECT '{cuts.ISOLATED}', CAST((SELECT sum(len(kept)) FROM zz) + (SELECT sum(n_components) FROM i WHERE NOT has_fit) AS BIGINT)"]
)
