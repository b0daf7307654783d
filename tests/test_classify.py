"""Efficiency tables where nothing is real or nothing is found."""

from pelorus.operators import classify


def test_shares_of_nothing_are_null(spark):
    rows = [(1, 0), (0, 0), (None, 0)]
    d = spark.createDataFrame(rows, "truth int, predicted int")
    assert tuple(classify.efficiencies(d, "truth").first()) == (3, 0.0, None)
    assert tuple(classify.efficiencies(d.filter("truth = 0"), "truth").first()) == (1, None, None)
    assert tuple(classify.efficiencies(d.limit(0), "truth").first()) == (0, None, None)
