"""Distributed ranks, running sums and quantiles against brute force.

The frames hold one group with most of the rows and one value shared by a
third of them, so both a group and a run of equal values cross partitions.
"""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import ordered as O
from terrapanel.operators import ranking as K
from terrapanel.operators import stats as S


def rows(n=1200, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 10 < 7 else rnd.choice(["a", "b", None])
        v = 5.0 if i % 3 == 0 else (None if i % 11 == 0 else float(rnd.randint(0, 60)))
        out.append((i, g, v))
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


def brute(data, keep_nulls, descending):
    out = {}
    for g in {r[1] for r in data}:
        group = [r for r in data if r[1] == g]
        known = [r for r in group if r[2] is not None]
        use = group if keep_nulls else known
        key = (lambda r: (r[2] is None, 0 if r[2] is None else (-r[2] if descending else r[2])))
        ordered = sorted(use, key=lambda r: (*key(r), r[0]))
        values = [key(r) for r in ordered]
        distinct = sorted(set(values))
        for i, r in enumerate(ordered):
            k = key(r)
            out[r[0]] = (i + 1, sum(v < k for v in values) + 1, values.count(k), len(use), distinct.index(k) + 1)
    return out


@pytest.mark.parametrize("keep_nulls", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_match_brute_force(frame, data, keep_nulls, descending):
    df = frame(data, "id int, g string, v double")
    out = ("rn", "rank", "ties", "n", "dense")
    r = O.ranks(df, ["g"], "v", ["id"], {c: lambda x, c=c: getattr(x, c) for c in out}, descending=descending, keep_nulls=keep_nulls, dense=True)
    got = {x["id"]: tuple(x[c] for c in out) for x in r.collect()}
    assert len(got) == len(data)
    want = brute(data, keep_nulls, descending)
    assert {i: t for i, t in got.items() if t[0] is not None} == want


def test_hot_group_and_hot_value_are_cut_small_groups_stay_whole(frame, data):
    more = data + [(10_000 + i, "small", float(i)) for i in range(5)]
    placed = O._place(frame(more, "id int, g string, v double"), [F.col("g")], [O.up("v"), O.up("id")]).rows.select("row.*", "piece", "piece.large", "piece.solid")
    sizes = {(r.g, r.piece): r["count"] for r in placed.groupBy("g", "piece").count().collect()}
    assert max(sizes.values()) <= 1200 / 6 * 1.5
    assert placed.filter("g = 'hot' AND v = 5").select("piece").distinct().count() >= 2 and placed.filter("v = 5 AND g = 'hot' AND NOT solid").count() == 0
    assert placed.filter("g = 'small'").select("piece").distinct().count() == 1 and placed.filter("g = 'small' AND large").count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "date", "timestamp", "decimal(12,2)", "boolean", "float"])
@pytest.mark.parametrize("descending", [True, False])
def test_every_type_orders_as_spark_does(spark, kind, descending):
    """Places of one group against a plain window, for values of both signs, ties, NULLs and texts that share prefixes."""
    value = {"long": "IF(id % 5 = 0, 7, (id * 7919) % 1009 * 9876543210 - 4000000000000)", "string": "IF(id % 4 = 0, 'same', repeat(char(97 + id % 3), CAST(id % 40 AS int)) || id % 7)",
             "date": "date_add(DATE '1960-01-01', CAST((id * 37) % 20000 AS int))", "timestamp": "timestamp_micros((id * 7919) % 100003 * 123456789)",
             "decimal(12,2)": "CAST((id * 31) % 777 / 7 - 30 AS decimal(12,2))", "boolean": "id % 3 = 0", "float": "IF(id % 9 = 0, CAST('NaN' AS float), CAST((id * 31) % 97 - 40 AS float))"}[kind]
    df = spark.range(900).selectExpr("id", f"IF(id % 11 = 0, NULL, {value}) AS v")
    got = O.row_numbers(df, [], [O.Order("v", descending), O.up("id")], "rn", "n")
    from pyspark.sql import Window
    want = df.withColumn("w", F.row_number().over(Window.orderBy(O.Order("v", descending).sort(), "id")))
    assert got.join(want.select("id", "w"), "id").filter("rn <> w OR n <> 900").count() == 0 and got.count() == 900


NAMES = "g0 piece row large major solid o0 l0 kl0 b0 s0 a0 r0 w0 before of_g at in all rank run dense __rn __rank __n __g __a __pos d.e".split()


def test_no_name_of_the_caller_clashes(frame, data):
    df = frame([(i, "hot", v, *[i + 7] * len(NAMES)) for i, _, v in data[:300]], "id int, g string, v double, " + ", ".join(f"`{c}` int" for c in NAMES))
    for out in (K.percent_rank(df, ["g"], "v", ["id"], "p"), O.running_sums(df, ["g"], [O.up("v"), O.up("id")], {"p": F.col("v")}, totals=False),
                K.ntile(df, ["g"], "v", ["id"], 4, "p"), K.top_k_per_group(df, ["g"], [O.down("v"), O.up("id")], 1500, "p")):
        assert out.columns == [*df.columns, "p"]
        rows = out.select("id", *[F.col(f"`{c}`") for c in NAMES]).collect()
        assert len(rows) == 300 and all(set(r[1:]) == {r[0] + 7} for r in rows)


def test_quantiles_shuffle_few_rows(spark):
    """Of a large group only the rows near the wanted places are counted by value."""
    df = spark.range(200_000).select(F.struct(F.lit("a").alias("g0")).alias("g"), ((F.col("id") * 7919) % 200_003).cast("double").alias("v"))
    assert O.region_counts(df, {"p": 0.5, "q": 0.9}).count() < 2000
    q = O.quantiles(df.select("g.g0", "v"), ["g0"], "v", {"p": 0.5, "q": 0.9}).first()
    known = sorted((i * 7919) % 200_003 for i in range(200_000))
    assert (q.p, q.q) == (pytest.approx(np.percentile(known, 50)), pytest.approx(np.percentile(known, 90)))


def test_top_k_keeps_at_most_k_of_a_group_from_each_task(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("id", "id % 2 AS g")
    plan = K.top_k_per_group(df, ["g"], [O.down("id")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[-1]
    assert {r.id for r in K.top_k_per_group(df, ["g"], [O.down("id")], 3).collect()} == set(range(3994, 4000))


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_thresholds_of_sums_do_not_flip(spark, parts):
    """Sums of doubles in any order: the row at the quantile always reaches it."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(0, 20_000, 1, 7).selectExpr("id % 101 AS k", "CAST(id AS double) * 0.1 AS x").groupBy("k").agg(F.sum("x").alias("v"), F.avg("x").alias("w"))
        tiers = {r.k: r.tier for r in S.quantile_tiers(df, "v", [(0.9, "high")], "rest").collect()}
        assert sum(t == "high" for t in tiers.values()) == 11
        assert K.quantile_flag(df, [], "v", 0.5).filter("is_high").count() == 51
        assert {r.b: r.n for r in K.quantile_bins(df, "v", [0.5], "b").groupBy("b").agg(F.count("k").alias("n")).collect()} == {1: 51, 2: 50}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 6)


def test_running_sums_and_totals(frame, data):
    df = frame([(i, g, v or 0.0) for i, g, v in data], "id int, g string, v double")
    got = {r["id"]: (r.s, r.s_total, r.rn) for r in O.running_sums(df, ["g"], [O.down("v"), O.up("id")], {"s": F.col("v")}, rn="rn").collect()}
    for g in {r[1] for r in data}:
        total, ordered = 0.0, sorted(((-(v or 0.0), i) for i, gg, v in data if gg == g))
        whole = -sum(v for v, _ in ordered)
        for k, (v, i) in enumerate(ordered, 1):
            total -= v
            assert got[i] == (total, whole, k)


def test_quantiles_interpolate_exactly(frame, data):
    df = frame(data, "id int, g string, v double")
    q = {r.g: r for r in O.quantiles(df, ["g"], "v", {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p93": 0.93, "p1": 1.0}).collect()}
    for g in {r[1] for r in data}:
        known = [v for _, gg, v in data if gg == g and v is not None]
        for name, p in (("p0", 0), ("p5", 5), ("p50", 50), ("p93", 93), ("p1", 100)):
            assert q[g][name] == pytest.approx(np.percentile(known, p))


def test_quantile_of_single_and_missing_values(frame):
    df = frame([("one", 4.0), ("none", None)], "g string, v double")
    assert [(r.g, r.m) for r in O.quantiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("one", 4.0)]


def test_percent_rank_variants(frame, values):
    df = frame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None)], "id int, v double")
    assert values(K.percent_rank(df, [], "v", ["id"], "p"), "id", "p") == [(1, 0.0), (2, 1 / 3), (3, 1 / 3), (4, 1.0)]
    assert values(K.percent_rank(df, [], "v", ["id"], "p", keep_nulls=False, fill=0.5), "id", "p") == [(1, 0.0), (2, 0.5), (3, 0.5), (4, 0.5)]
    one = frame([(1, 7.0)], "id int, v double")
    assert K.percent_rank(one, [], "v", ["id"], "p").first().p == 0.0
    assert K.percentile_0_100(one, [], "v", ["id"], "p").first().p == 50.0


def test_ntile_gives_extra_rows_to_first_buckets(frame, values):
    df = frame([(i, float(i)) for i in range(1, 11)] + [(11, None)], "id int, v double")
    got = [b for _, b in values(K.ntile(df, [], "v", ["id"], 4), "id", "bucket")]
    assert got == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, None]


def test_tie_stable_bins_keep_ties_together(frame, values):
    df = frame([(i, 1.0) for i in range(5)] + [(5, 2.0)], "id int, v double")
    got = values(K.tie_stable_bins(df, [], "v", ["id"], 3, "b"), "id", "b")
    assert len({b for i, b in got if i < 5}) == 1 and got[-1][1] == 3


def test_top_share_is_ceil(frame):
    df = frame([(i, "m" if i < 5 else "k", float(i)) for i in range(9)], "id int, g string, v double")
    got = {(r.g, r["id"]) for r in K.top_share(df, ["g"], "v", ["id"], 0.25).collect()}
    assert got == {("m", 4), ("m", 3), ("k", 8)}


def test_rank_metrics_equals_single_ranks(frame):
    rnd = random.Random(9)
    df = frame([(i, i % 3, float(rnd.randint(0, 9)), None if i % 7 == 0 else float(rnd.randint(0, 30))) for i in range(60)], "id int, g int, a double, b double")
    out = K.rank_metrics(df, ["id"], {"all": [], "own": ["g"]}, {"a": True, "b": False}).alias("x")
    ref = K.rank_by(df, ["g"], "b", ["id"], "r", descending=False)
    ref = K.percent_rank(ref.withColumn("nb", -F.col("b")), ["g"], "nb", ["id"], "p")
    got = {r["id"]: (r.own_b_rank, r.own_b_pctl) for r in out.collect()}
    assert got == {r["id"]: (r.r, r.p) for r in ref.collect()}


def test_cumulative_share_flags_rows_needed(frame, values):
    df = frame([(1, 5.0), (2, 3.0), (3, 2.0)], "id int, v double")
    got = values(K.cumulative_share(df, [], "v", ["id"], {"half": 0.5, "most": 0.7}), "id", "cumulative_share", "half", "most")
    assert got == [(1, 0.5, True, True), (2, 0.8, False, True), (3, 1.0, False, False)]
