"""One hand-computed frame per null, zero and weight rule."""

from pyspark.sql import functions as F

from terrapanel.functions import nulls as N


def test_ratios_guard_zero_negative_and_null(frame):
    df = frame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (1.0, None), (None, 2.0)], "a double, b double")
    got = df.select(N.safe_ratio("a", "b").alias("s"), N.ratio_or_null("a", "b").alias("r")).collect()
    assert [r.s for r in got] == [0.5, None, None, None, None]
    assert [r.r for r in got] == [0.5, None, -0.5, None, None]


def test_null_sorts_last_both_ways(frame):
    df = frame([(1,), (None,), (3,)], "v int")
    assert [r.v for r in df.orderBy(N.asc_last("v")).collect()] == [1, 3, None]
    assert [r.v for r in df.orderBy(N.desc_last("v")).collect()] == [3, 1, None]


def test_sums(frame):
    df = frame([(1.0, None)], "a double, b double")
    assert df.select(N.sum0("a", "b").alias("v")).first().v == 1.0
    assert df.select(N.add_cols("a", "b").alias("v")).first().v is None
    empty = frame([(None,), (None,)], "a double")
    assert empty.agg(N.sum_na0("a").alias("v")).first().v == 0.0
    assert empty.agg(F.sum("a").alias("v")).first().v is None


def test_weighted_means(frame):
    df = frame([("null x", None, 5.0), ("null x", 2.0, 1.0), ("null w", 4.0, None), ("null w", 2.0, 1.0),
                ("zero w", 4.0, 0.0), ("zero w", 2.0, 0.0), ("none", None, 1.0)], "g string, x double, w double")
    got = {r.g: r for r in df.groupBy("g").agg(N.weighted_mean("x", "w").alias("z"), N.weighted_mean("x", "w", "propagate").alias("p"),
                                               N.safe_weighted_mean("x", "w").alias("s")).collect()}
    assert (got["null x"].z, got["null x"].p, got["null x"].s) == (2.0, 2.0, 2.0)
    assert (got["null w"].z, got["null w"].p, got["null w"].s) == (2.0, None, 2.0)
    assert (got["zero w"].z, got["zero w"].s) == (None, 3.0)
    assert (got["none"].z, got["none"].s) == (None, None)


def test_null_safe_join_matches_null_keys(frame):
    a, b = frame([(None, 1), ("x", 2)], "k string, v int"), frame([(None, 10), ("y", 20)], "k string, w int")
    got = N.null_safe_join(a, b, ["k"], "left").collect()
    assert sorted((r.v, r.w) for r in got if r.w is not None) == [(1, 10)] and len(got) == 2


def test_finite(frame):
    df = frame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r.f for r in df.select(N.finite("v").alias("f")).collect()] == [True, False, False, False]
