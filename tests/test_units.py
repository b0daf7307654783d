import math

import pytest

from pelorus.functions.units import ANGLE, BRIGHTNESS, FREQUENCY, PER_ANGLE, PER_BEAM, PER_PIXEL, parse_unit, units_in_text
from pelorus.operators.harmonise import harmonise, harmonised_integers


@pytest.mark.parametrize("text,scale,dims", [("Jy/beam", 1, PER_BEAM), ("mJy  beam^-1", 1e-3, PER_BEAM), ("JY BEAM**-1", 1, PER_BEAM), ("10^-3 JY/BEAM", 1e-3, PER_BEAM), ("1.0E-6 Jy/beam", 1e-6, PER_BEAM), ("µJy/bm", 1e-6, PER_BEAM), ("microjansky per beam", 1e-6, PER_BEAM), ("Jy pixel-1", 1, PER_PIXEL), ("'K       '", 1, BRIGHTNESS), ("K (Tb)", 1, BRIGHTNESS), ("milliKelvin", 1e-3, BRIGHTNESS), ("GHZ", 1e9, FREQUENCY), ("Mhz", 1e6, FREQUENCY), ("10^6 Hz", 1e6, FREQUENCY), ("kilohertz", 1e3, FREQUENCY), ("arc sec", 1 / 3600, ANGLE), ("mas", 1 / 3.6e6, ANGLE), ('"', 1 / 3600, ANGLE), ("'", 1 / 60, ANGLE)])
def test_expressions(text, scale, dims):
    unit = parse_unit(text)
    assert unit.dims == dims and math.isclose(unit.scale, scale)


def test_solid_angle_and_no_units():
    assert parse_unit("MJy/sr").dims == PER_ANGLE
    assert math.isclose(parse_unit("MJy/sr").scale, 1e6 * math.radians(1) ** 2)
    assert parse_unit("degC").offset == 273.15
    for text in (None, "", "   ", "counts", "Jy//", "unknown", "x" * 5000):
        assert parse_unit(text) is None


def test_notes():
    assert {k: v.scale for k, v in units_in_text("uv taper 12 arcsec applied; BMAJ, BMIN: asec | freq. (megahertz)").items()} == {"beam": 1 / 3600, "frequency": 1e6}
    assert units_in_text("cleaned down to 0.5 mJy/beam peak\nprimary beam corrected. combined with 150 MHz data") == {}
    assert units_in_text("source counts in Jy; pixel values are mJy per beam")["map"].scale == 1e-3
    assert units_in_text(None) == {}


SCHEMA = "meta_id long, bunit string, frequnit string, notes string, freq float, bmaj float, bmin float, imgrms double, dx float, dy float, _n int"


def test_harmonise(spark):
    rows = [
        (1, "mJy/beam", "GHz", None, 1.5, 0.01, 0.005, 2.0, 0.001, 0.001, 1),
        (2, None, None, "map units uJy/beam; beam in arcsec; CRVAL3 in MHz", 1400.0, 10.0, 8.0, 50.0, 0.001, 0.001, 1),
        (3, "", " ", "", 1.4e9, 0.01, 0.01, 1.0, 0.001, 0.001, 1),
        (4, "counts", "Hz", "map units Jy/beam", 1.4e9, 0.01, 0.01, 1.0, 0.001, 0.001, 1),
        (5, "K", "Hz", None, 1.4e9, 0.01, -1.0, 1.0, 0.001, 0.001, 1),
        (6, "Jy/pixel", "Hz", None, 1.4e9, 0.01, 0.01, 1e-3, -0.001, 0.001, 1),
        (7, "Jy/beam", "Hz", None, float("nan"), 0.01, 0.01, 1.0, 0.001, 0.001, 1),
        (None, None, None, None, None, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["meta_id"]: (r["freq_khz"], r["bmaj_mas"], r["rms_ujy"]) for r in harmonised_integers(d.drop("_n")).collect()}
    assert got[1] == (1500000, 36000, 2000) and got[2] == (1400000, 10000, 50)
    assert set(got) == {1, 2, 6}
    assert got[6][2] == round(1e3 * math.pi * 1e-4 / (4 * math.log(2)) / 1e-6)
    assert harmonise(d.drop("_n")).count() == 8
    assert harmonised_integers(spark.createDataFrame([], SCHEMA)).count() == 0
