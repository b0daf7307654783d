"""Image quantities recorded in different units, converted to Hz, arcsec and Jy/beam."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions import units as U

# fixed values: 2k/c² in Jy per K per Hz² and steradian, degrees in a radian
K_TO_JY_SR = 2 * 1.380649e-23 / 299792458.0**2 * 1e26
DEG = 180.0 / math.pi


def positive(c: Column) -> Column:
    """The value as double; null, NaN, infinite, zero and negative values are missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (d > 0) & (d < 1e300), d)


def harmonise(images: DataFrame) -> DataFrame:
    """Add freq_hz, bmaj_arcsec, bmin_arcsec and rms_jy_beam to image metadata.

    A unit column that names a unit wins over the notes; without either, freq is in Hz, the beam in degrees and
    imgrms has no value. A unit column that holds text which is no convertible unit (counts, unknown) still
    counts as the column's word for the map: the noise then has no value. Missing inputs (null, NaN, zero,
    negative) give a missing result; rows are never dropped.
    """
    noted = images.withColumn("_n", U.note_units("notes"))
    bunit = F.when(F.trim(F.translate("bunit", "'\"", "  ")) != "", F.col("bunit"))
    frequnit = F.when(F.trim(F.translate("frequnit", "'\"", "  ")) != "", F.col("frequnit"))
    d = noted.withColumns({
        "_map": U.unit_of(F.coalesce(bunit, F.col("_n.bunit"))),
        "_freq": U.unit_of(F.coalesce(frequnit, F.col("_n.frequnit"), F.lit("Hz"))),
        "_beam": U.unit_of(F.coalesce(F.col("_n.beam"), F.lit("deg"))),
    })
    freq, beam, unit = F.col("_freq"), F.col("_beam"), F.col("_map")
    d = d.withColumns({
        "freq_hz": F.when(U.in_dims(freq, U.FREQUENCY), U.to_canonical(positive(F.col("freq")), freq)),
        "_bmaj": F.when(U.in_dims(beam, U.ANGLE), U.to_canonical(positive(F.col("bmaj")), beam)),
        "_bmin": F.when(U.in_dims(beam, U.ANGLE), U.to_canonical(positive(F.col("bmin")), beam)),
    })
    solid = F.col("_bmaj") * F.col("_bmin") * (math.pi / (4 * math.log(2)))  # square degrees
    pixel = positive(F.abs(F.col("dx").cast("double") * F.col("dy").cast("double")))
    rms = U.to_canonical(positive(F.col("imgrms")), unit)
    rms_jy = (
        F.when(U.in_dims(unit, U.PER_BEAM), rms)
        .when(U.in_dims(unit, U.PER_PIXEL), rms * solid / pixel)
        .when(U.in_dims(unit, U.PER_ANGLE), rms * solid)
        .when(U.in_dims(unit, U.BRIGHTNESS), rms * K_TO_JY_SR * F.col("freq_hz") ** 2 * solid / (DEG * DEG))
    )
    return d.withColumns({"bmaj_arcsec": F.col("_bmaj") * 3600.0, "bmin_arcsec": F.col("_bmin") * 3600.0, "rms_jy_beam": rms_jy}).drop("_n", "_map", "_freq", "_beam", "_bmaj", "_bmin")


def harmonised_integers(images: DataFrame) -> DataFrame:
    """meta_id, freq_khz, bmaj_mas, rms_ujy of the images for which all three come out."""
    d = harmonise(images.select("meta_id", "bunit", "frequnit", "notes", "freq", "bmaj", "bmin", "imgrms", "dx", "dy"))
    d = d.select("meta_id", F.round(F.col("freq_hz") / 1e3).cast("long").alias("freq_khz"), F.round(F.col("bmaj_arcsec") * 1e3).cast("long").alias("bmaj_mas"), F.round(F.col("rms_jy_beam") * 1e6).cast("long").alias("rms_ujy"))
    return d.filter("freq_khz is not null and bmaj_mas is not null and rms_ujy is not null")
