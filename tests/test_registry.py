"""Registered queries against their SQL, on the smallest supplied data."""

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.registry import ORACLE, QUERIES
from check import TABLES, table

SF = "/root/testdata/sf0.001"
SAMPLE = ["io04_tolerant_aliases", "pr12_residual_reconciliation", "jn04_hierarchy_backfill", "jn16_point_in_polygon", "ag05_weighted_median",
          "ag18_correlation_spearman", "ag25_zone_boundary", "wn06_deterministic_ranks", "wn13_bivariate_class", "wn21_cumulative_share", "gr03_distance_clusters",
          "mt01_population_mart", "mt09_affordability_mart", "mt12_housing_theme", "mt26_cluster_seeds", "mt34_parcel_shortlist", "ch05_bump", "dq07_validation_suite",
          "bump_sweet_spot_overheating", "waterfall_q3_gdp_sector_change", "jn06_normalised_text_key", "mt22_metro_features", "mt30_parcel_validation",
          "mt31_parcel_cleanup", "mt40_variable_catalog", "gr04_kmeans_peer_groups", "mt10_school_district_mart", "mt37_overheat_gap", "mt42_top_districts",
          "io09_wkb_parts", "jn20_polygon_overlaps"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    df = entry.queries()["io06_table_scan"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan and "GreaterThan(l_quantity,25.0)" in plan
