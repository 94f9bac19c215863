"""Compatibility reference table, attachment and the directional co-pour rule."""

from pyspark.sql import functions as F

from castplan.operators import compat
from castplan.sources.files import load_compat_table


def cmap(spark, rows, cols="alloy_code string, astm_group string, compat_with_all string, specific_compatible_alloys string, active string, file_line long"):
    return compat.compat_map(spark.createDataFrame(rows, cols))


def test_aliases_defaults_and_last_row_wins(spark):
    m = cmap(spark, [(" wcb", "A216", "yes", "", None, 1), ("4140", "", "no", "", "", 2),
                     ("X1", "G", "Y", "", "N", 3), ("WCB", "A216-B", "no", "a, ,A", "y", 4)])
    got = {r["alloy_key"]: (r["compatibility_group"], r["compat_all"], r["specific_alloys"]) for r in m.collect()}
    assert got == {"WCB": ("A216-B", "NO", "A"), "4140": ("4140", "NO", "")}


def test_missing_required_column_raises(spark):
    df = spark.createDataFrame([("A", "G")], "alloy_code string, compatibility_group string")
    try:
        compat.compat_map(df)
        raise AssertionError("expected failure")
    except RuntimeError as exc:
        assert "Is_Compat_with_All" in str(exc)


def test_attach_unmapped_gets_own_group(spark):
    m = cmap(spark, [("WCB", "A216", "YES", "", None, 1)])
    jobs = spark.createDataFrame([("J1", "wcb "), ("J2", "4140"), ("J3", None)], "job_number string, alloy string")
    got = {r["job_number"]: (r["compatibility_group"], r["compat_all"]) for r in compat.attach_compat(jobs, m).collect()}
    assert got == {"J1": ("A216", "YES"), "J2": ("4140", "NO"), "J3": ("", "NO")}


def test_directional_co_pour(spark):
    m = cmap(spark, [("CF3M", "CF8M-G", "NO", "CF8M", None, 1), ("CF8M", "CF8M-G", "NO", "", None, 2),
                     ("A1", "G2", "YES", "", None, 3), ("A2", "G2", "YES", "", None, 4)])
    alloys = spark.createDataFrame([("CF3M",), ("CF8M",), ("A1",), ("A2",), ("ZZ",)], "alloy string")
    got = {r["anchor_alloy"]: r["accepted_alloys"] for r in compat.co_pour_candidates(alloys, m).collect()}
    assert got["CF3M"] == "CF3M, CF8M" and got["CF8M"] == "CF8M"
    assert got["A1"] == "A1, A2" and got["A2"] == "A1, A2" and got["ZZ"] == "ZZ"


def test_missing_csv_is_empty_and_csv_loads(spark, tmpdir_path):
    assert load_compat_table(spark, f"{tmpdir_path}/nope.csv").count() == 0
    p = f"{tmpdir_path}/compat.csv"
    with open(p, "w") as fh:
        fh.write(" alloy_code ,compatibility_group,Is_Compat_with_All\nWCB,A216,YES\n4140,4140,NO\nWCB,A216X,NO\n")
    m = compat.compat_map(load_compat_table(spark, p))
    got = {r["alloy_key"]: r["compatibility_group"] for r in m.collect()}
    assert got == {"WCB": "A216X", "4140": "4140"}
    assert m.where(F.col("alloy_key") == "WCB").first()["compat_all"] == "NO"
