from pelorus.operators.malformed import load_selavy, split_rows

SCHEMA = "line_id long, raw_line string, reason string, cells int"


def line(name="n", ra="1.5", dec="-2", n=37):
    f = ["x"] * n
    if n > 6:
        f[2], f[5], f[6] = name, ra, dec
    return " ".join(f)


def run(spark, lines):
    d = spark.createDataFrame([(i, v, None, 1) for i, v in enumerate(lines)], SCHEMA)
    clean, bad = split_rows(d.drop("reason", "cells"))
    return {r["line_id"] for r in clean.collect()}, {r["line_id"]: r["reason"] for r in bad.collect()}


def test_reasons(spark):
    lines = [
        line(), "\t" + line('"a ""b"" c"').replace(" x", "\tx"), None, "", " \t", "  # comment", "*x", "/x",
        line('"open'), line('a"b'), line('"a"b'), line(n=36), line(n=38), line('""'), line('"  "'),
        line(ra="360"), line(ra="0"), line(ra="1e1"), line(ra="nan"), line(ra="١"), line(ra="1e999"), line(ra='"359.9"'), line(dec="90.1"), line(dec="+90."), line(dec="0x1"), line(dec=".5"), line(dec="-"),
        line("y" * 200_000), " ".join(["z"] * 20_000), '"' * 50_001,
    ]
    good, bad = run(spark, lines)
    assert good == {0, 1, 16, 17, 21, 23, 25, 27}
    reason = {8: "quoting", 9: "quoting", 10: "quoting", 11: "columns", 12: "columns", 13: "component_name", 14: "component_name", 15: "ra_deg_cont", 18: "ra_deg_cont", 19: "ra_deg_cont", 20: "ra_deg_cont", 22: "dec_deg_cont", 24: "dec_deg_cont", 26: "dec_deg_cont", 28: "columns", 29: "quoting"}
    assert bad == reason
    assert run(spark, []) == (set(), {})


def test_repeated_rows_null_ids_and_values(spark):
    d = spark.createDataFrame([(1, line("a b"), None, 1), (1, line(), None, 1), (1, line(), None, 1), (None, line(n=3), None, 1), (None, line(), None, 1)], SCHEMA)
    clean, bad = load_selavy(d.drop("reason", "cells"))
    assert sorted(r["ra_deg_cont"] for r in clean.collect()) == [1.5, 1.5, 1.5]
    assert sorted(str(r["line_id"]) for r in bad.collect()) == ["1", "None"]
