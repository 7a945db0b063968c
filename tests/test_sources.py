"""Scans and sinks: headers, leading zeros, aliases, partition replacement."""

import pytest
from pyspark.sql import functions as F

from terrapanel.plans.silver import standardize_frame
from terrapanel.sources import files


def test_csv_keeps_leading_zeros_and_cleans_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Geo ID, Total-Units \n01001,5\n")
    df = files.read_csv_clean(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["geo_id", "total_units"] and df.first().geo_id == "01001"


def test_dated_files_take_years_from_the_path(spark, tmp_path):
    for y in ("1920", "2021"):
        (tmp_path / f"countyinflow{y}.csv").write_text("n1\n3\n")
    df = files.read_dated_files(spark, str(tmp_path / "*.csv"), r"inflow(\d{2})(\d{2})\.csv", "n1 int", {"a": 1, "b": 2})
    assert sorted((r.a, r.b, r.n1) for r in df.collect()) == [(19, 20, 3), (20, 21, 3)]


def test_aliases_numbers_and_missing_columns(frame):
    df = frame([("$1,200.50", "x", None), ("(7)", " ", "b"), ("n/a", None, "c")], "JV string, USE string, ALT string")
    out = files.read_with_aliases(df, {"value": ["just_value", "jv"], "use": ["use", "alt"], "gone": ["nope"]}, {"value": "number"})
    assert [tuple(r) for r in out.collect()] == [(1200.5, "x", None), (-7.0, "b", None), (None, "c", None)]


def test_replace_partition_leaves_the_others(spark, frame, tmp_path):
    root = str(tmp_path)
    files.publish(frame([("01", 1), ("02", 2)], "k string, v int"), root, "raw.t", ["k"])
    files.replace_partition(frame([("02", 9)], "k string, v int"), root, "raw.t", "k")
    got = files.table(spark, root, "raw.t", "v int, k string")
    assert sorted((r.k, r.v) for r in got.collect()) == [("01", 1), ("02", 9)]
    files.publish(frame([("03", 3)], "k string, v int"), root, "raw.t", ["k"])
    assert files.table(spark, root, "raw.t", "v int, k string").count() == 1


def test_standardize_drops_margins_and_suffix(frame):
    df = frame([("01", "A", 2020, 5.0, 1.0)], "GEOID string, NAME string, year int, popE double, popM double")
    out = standardize_frame(df, "county", drop_e=True)
    assert out.columns == ["geo_level", "geo_id", "geo_name", "year", "pop"] and out.first().geo_id == "01"


def test_build_metadata_and_literal_dimension(spark):
    df = files.with_build_metadata(files.dim_from_rows(spark, [("a", 1)], "k string, v int"), build_source="x")
    assert df.first().build_source == "x"
    levels = files.split_by_level(df.withColumn("geo_level", F.lit("us")), "geo_level", {"us": ["k"]})
    assert levels["us"].columns == ["k"]


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from terrapanel import session

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            session._checkpoint_dir_ready(Fake())
