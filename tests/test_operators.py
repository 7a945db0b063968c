"""Rollups, series, joins, selection and statistics on hand-computed frames."""

import pytest
from pyspark.sql import functions as F

from terrapanel.functions import columns as C
from terrapanel.operators import joins as J
from terrapanel.operators import quality as Q
from terrapanel.operators import rollup as R
from terrapanel.operators import select as L
from terrapanel.operators import series as T
from terrapanel.operators import stats


def test_row_lag_and_calendar_lag_differ_on_gaps(frame, values):
    df = frame([("a", 2000, 10.0), ("a", 2002, 12.0), ("a", 2003, 15.0)], "k string, y int, v double")
    row = T.growth(df, ["k"], "y", "v", (1,), prefix="g")
    cal = T.growth(df, ["k"], "y", "v", (1,), prefix="g", mode="calendar")
    assert values(row, "y", "g_growth_1yr") == [(2000, None), (2002, pytest.approx(0.2)), (2003, pytest.approx(0.25))]
    assert values(cal, "y", "g_growth_1yr") == [(2000, None), (2002, None), (2003, pytest.approx(0.25))]


def test_growth_is_null_for_non_positive_base(frame, values):
    df = frame([(2000, 0.0), (2001, 5.0), (2002, -5.0), (2003, 1.0)], "y int, v double").withColumn("k", F.lit("a"))
    assert values(T.growth(df, ["k"], "y", "v", (1,)), "y", "v_growth_1yr") == [(2000, None), (2001, None), (2002, -2.0), (2003, None)]


def test_rolling_mean_loose_and_strict(frame, values):
    df = frame([("a", y, float(y)) for y in range(1, 5)], "k string, y int, v double")
    out = T.rolling_mean(T.rolling_mean(df, ["k"], "y", "v", 3, "loose"), ["k"], "y", "v", 3, "strict", strict=True)
    assert values(out, "y", "loose", "strict") == [(1, 1.0, None), (2, 1.5, None), (3, 2.0, 2.0), (4, 3.0, 3.0)]


def test_index_with_zero_base_is_null(frame, values):
    df = frame([("a", 1, 0.0), ("a", 2, 4.0), ("b", 1, 2.0), ("b", 2, 3.0)], "k string, y int, v double")
    assert values(T.index_to_base(df, ["k"], "y", "v", 1, "i"), "k", "y", "i") == [("a", 1, None), ("a", 2, None), ("b", 1, 100.0), ("b", 2, 150.0)]


def test_waterfall_ends_in_total(frame, values):
    df = frame([("g", 1, "up", 5.0), ("g", 2, "down", -2.0)], "g string, o int, c string, v double")
    got = values(T.waterfall(df, ["g"], "o", "c", "v"), "o", "c", "start_value", "end_value", "is_total")
    assert got == [(1, "up", 0.0, 5.0, False), (2, "down", 5.0, 3.0, False), (3, "Total", 0.0, 3.0, True)]


def test_multi_level_rollup_skips_missing_parents(frame, values):
    df = frame([("t1", "c1", 1.0), ("t2", "c1", 2.0), ("t3", None, 4.0)], "t string, c string, v double")
    got = values(R.multi_level_rollup(df, {"tract": ("t", "t"), "county": ("c", "c"), "us": (F.lit("us"), F.lit("US"))}, [], [F.sum("v").alias("v")]), "geo_level", "geo_id", "v")
    assert got == [("county", "c1", 3.0), ("tract", "t1", 1.0), ("tract", "t2", 2.0), ("tract", "t3", 4.0), ("us", "us", 7.0)]


def test_weighted_median_crosses_half(frame):
    df = frame([("g", 1.0, 1.0), ("g", 2.0, 1.0), ("g", 9.0, 3.0), ("h", 1.0, 1.0), ("h", 2.0, 1.0)], "g string, x double, w double")
    assert {r.g: r.m for r in R.weighted_median(df, ["g"], "x", "w", "m").collect()} == {"g": 9.0, "h": 1.0}


def test_flow_balance(frame):
    e = frame([("a", "b", 1.0), ("a", "c", 2.0), ("c", "a", 4.0), ("b", "a", 8.0), ("x", "a", 16.0)], "o string, d string, n double")
    m = frame([("a", "G"), ("b", "G"), ("c", "H")], "p string, g string")
    got = {r.g: (r.inflow, r.outflow, r.internal) for r in R.flow_balance(e, m, "o", "d", "p", "g", "n").collect()}
    assert got == {"G": (20.0, 2.0, 9.0), "H": (2.0, 4.0, 0.0)}


def test_backfill_order_and_source(frame):
    df = frame([("both", "p1"), ("direct", "p2"), ("parent", "p1"), ("none", "p3")], "id string, up string")
    own, up = frame([("both", 1.0), ("direct", 2.0)], "id string, v double"), frame([("p1", 9.0)], "id string, v double")
    paths = {"own": (own, {"id": "id"}), "up": (up, {"up": "id"})}
    first = {r["id"]: (r.v, r.v_source) for r in J.hierarchy_backfill(df, paths, ["v"], ["own", "up"]).collect()}
    assert first == {"both": (1.0, "own"), "direct": (2.0, "own"), "parent": (9.0, "up"), "none": (None, None)}
    assert {r["id"]: r.v for r in J.hierarchy_backfill(df, paths, ["v"], ["up", "own"]).collect()}["both"] == 9.0


def test_prefix_assignment_status(frame):
    df = frame([("1-23-456",), ("12",), (None,), ("999-1",)], "k string")
    ref = frame([("123",)], "t string")
    got = {r.k: (r.assigned, r.match_status) for r in J.assign_by_prefix(df, ref, "k", "t", 3).collect()}
    assert got == {"1-23-456": ("123", "matched"), "12": (None, "no_key"), None: (None, "no_key"), "999-1": (None, "unmatched")}


def test_complete_periods_and_latest(frame, values):
    df = frame([("a", 2000, 1.0), ("a", 2002, 3.0), ("b", 2001, 5.0)], "k string, y int, v double")
    got = values(J.complete_periods(df, ["k"], "y"), "k", "y", "v")
    assert got == [("a", 2000, 1.0), ("a", 2001, None), ("a", 2002, 3.0), ("b", 2000, None), ("b", 2001, 5.0), ("b", 2002, None)]
    assert values(J.latest(df, "y"), "k") == [("a",)]
    assert values(J.latest_common([df, df.filter("y < 2002")], "y")[0], "k") == [("b",)]


def test_latest_per_key_and_top_k_with(frame, values):
    df = frame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", None, "q")], "k string, t int, v string")
    assert values(L.latest_per_key(df, ["k"], ["t"]), "k", "v") == [("a", "z"), ("b", "q")]
    n = frame([(i, float(i)) for i in range(6)], "id int, v double")
    out = L.top_k_with(n, "v", ["id"], 2, F.col("id") == 0)
    assert values(out, "id", "overall_rank", "truncated_flag") == [(0, 6, True), (4, 2, True), (5, 1, True)]


def test_select_entities_strategies(frame, values):
    df = frame([("a", 1, 1), ("b", 1, 2), ("a", 2, 2), ("b", 2, 1)], "e string, p int, r int")
    pick = lambda s, **k: {r[0] for r in values(L.select_entities(df, s, "e", "p", "r", **k), "e")}
    assert pick("fixed_top_n", k=1) == {"b"} and pick("fixed_top_n", k=1, at=1) == {"a"}
    assert pick("rolling_top_n", k=1) == {"a", "b"} and pick("peer_set", peers=["a"]) == {"a"}


def test_zscore_flat_group_is_zero(frame, values):
    df = frame([("flat", 3.0), ("flat", 3.0), ("one", 8.0), ("two", 1.0), ("two", 3.0)], "g string, v double")
    got = values(stats.zscore(df, ["g"], {"v": "z"}), "g", "z")
    assert got[:3] == [("flat", 0.0), ("flat", 0.0), ("one", 0.0)]
    assert got[3][1] == pytest.approx(-got[4][1])


def test_impute_and_winsorize(frame, values):
    df = frame([("a", 1.0), ("a", None), ("a", 3.0), (None, 5.0), (None, None)], "g string, v double")
    got = values(stats.impute_median(df, ["g"], {"v": "f"}), "g", "v", "f")
    assert ("a", None, 2.0) in got and (None, None, 5.0) in got
    w = frame([(float(i),) for i in range(11)], "v double")
    assert {r.v_w for r in stats.winsorize(w, "v", 0.1, 0.9).collect()} == {float(i) for i in range(1, 10)}
    assert stats.winsorize(w, "v", 0.1, 0.9, "trim").count() == 9


def test_spearman_ranks_again_after_deletion(frame):
    df = frame([(1, 1.0, 2.0), (2, 2.0, None), (3, 3.0, 1.0), (4, 3.0, 5.0)], "id int, a double, b double")
    got = {(r.metric_x, r.metric_y): r.correlation for r in stats.correlation_long(df, ["id"], ["a", "b"], "spearman").collect()}
    # ranks of the three complete rows: a = 1, 2.5, 2.5 and b = 2, 1, 3
    assert got[("a", "b")] == pytest.approx(0.0) and got[("a", "a")] == 1.0


def test_text_keys(frame):
    df = frame([("St. Johns County",)], "n string")
    assert df.select(C.text_key("n").alias("k")).first().k == "stjohnscounty"
    from terrapanel.plans.parcels import county_name_key
    assert df.select(county_name_key("n").alias("k")).first().k == "stjohns"


def test_residual_gates_and_tags(frame):
    df = frame([(10.0, 6.0, 3.0), (0.0, 1.0, 1.0)], "t double, a double, b double")
    got = C.residual(df, "t", ["a", "b"]).select("residual", "coverage_ratio", "coverage_flag").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.9, "ok"), (-2.0, None, None)]
    g = C.with_gates(df, {"x": F.col("t") > 5, "y": F.col("a") > 2})
    assert [r.eligible for r in g.collect()] == [1, 0]
    assert [r.v for r in df.select(C.reason_tags({"big": F.col("t") > 5, "odd": F.col("b") == 3}, "none").alias("v")).collect()] == ["big | odd", "none"]


def test_quality_operators(frame):
    df = frame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    stats_ = {r.key_columns: r for r in Q.key_stats(df, [["k"], ["k", "v"]]).collect()}
    assert (stats_["k"].distinct_keys, stats_["k"].is_key) == (2, False) and stats_["k + v"].null_key_rows == 1
    prof = {r.column_name: r for r in Q.profile(df, ["k", "v"]).collect()}
    assert (prof["v"].null_count, prof["v"].distinct_count, prof["k"].max_value) == (1, 1, 2.0)
    checks = {r.check_name: r["pass"] for r in Q.contract_check(df, ["k", "zz"], numeric=["k"], single=["k"]).collect()}
    assert checks == {"required_columns": False, "optional_columns_present": True, "non_empty": True, "single_k": False, "finite_k": True}


def test_first_per_key_takes_null_last(frame, values):
    df = frame([("a", None, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert values(L.first_per_key(df, ["k"], ["t"]), "k", "v") == [("a", "y"), ("b", "z")]


def test_match_names_reports_ambiguous_keys(frame):
    from terrapanel.operators.joins import match_names

    ref = frame([(1, "St. Johns County"), (2, "St Johns County"), (3, "Clay"), (3, "clay")], "id int, name string")
    got = match_names(frame([("st johns county",), ("CLAY",), ("none",), (None,)], "typed string"), ref, "typed", "name", ["id"])
    assert {r.typed: (r["id"], r.match_status) for r in got.collect()} == {
        "st johns county": (None, "ambiguous"), "CLAY": (3, "matched"), "none": (None, "none"), None: (None, "none")}


def test_backfill_never_multiplies_rows(frame):
    from terrapanel.operators.joins import hierarchy_backfill

    ref = frame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 2.0)], "k int, v double")
    got = hierarchy_backfill(frame([(1,), (2,), (3,)], "k int"), {"p": (ref, {"k": "k"})}, ["v"], ["p"])
    assert sorted((r.k, r.v or 0.0) for r in got.collect()) == [(1, 5.0), (2, 0.0), (3, 0.0)]


def test_long_codes_stay_whole(frame):
    from terrapanel.functions.columns import geoid
    from terrapanel.plans.parcels import land_use_code

    df = frame([("7",), ("1234",), (None,)], "c string").select(land_use_code("c").alias("u"), geoid("c", widths=(3,)).alias("g"))
    assert [(r.u, r.g) for r in df.collect()] == [("007", "007"), ("1234", "1234"), (None, None)]


def test_top_k_per_group_beyond_sparks_own_limit(frame):
    from terrapanel.operators.ordered import down
    from terrapanel.operators.ranking import top_k_per_group

    df = frame([("hot", i) for i in range(2500)] + [("b", 1)], "g string, i int")
    assert top_k_per_group(df, ["g"], [down("i")], 2000).count() == 2001
