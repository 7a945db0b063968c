"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import topk as K


def brute(rows, k, scale=256):
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(scale * c) for c in x])
    out = set()
    for q in v:
        if q % 5 == 0:
            for own in {tuple(x) for x in v[q]}:
                found = sorted(((-sum(a * b for a, b in zip(own, x)), i) for i, many in v.items() if i != q for x in many if len(x) == len(own)))[:k]
                out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.fixture
def rows():
    rnd = random.Random(4)
    own = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(150)]
    return [*own, (150, [0.0] * 6), (155, own[3][1]), (200, own[3][1]), (201, own[3][1]), (None, own[1][1]), (202, None), (203, []), (204, [float("nan")] * 6),
            (205, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (210, [float("inf")] + [0.0] * 5), (215, [1e7, -1e7, 1.0, 2.0, 3.0, 4.0]), (220, [1.0, 2.0]), (221, [0.5, 0.5]), (10, own[10][1])]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_equals_brute_force(spark, rows, block):
    df = spark.createDataFrame([(i, x, 1, "b") for i, x in rows], "vec_id long, embedding array<double>, rank int, block string")
    got = K.top_k(df, F.col("id") % 5 == 0, 5, block_rows=block, query_rows=9).collect()
    assert {tuple(r) for r in got} == brute(rows, 5)
    assert len(got) == len(brute(rows, 5))


def test_reading_stops_early_and_stays_exact():
    """On peaked vectors the bound ends the search long before all rows are seen."""
    rng = np.random.default_rng(2)
    cells = np.rint(rng.normal(0, 2, (4000, 3))).astype(np.int64)
    cells[17] = [900, 900, 900]
    lists = K.Lists(np.arange(4000), cells)
    seen = []
    floats = lists.floats

    class Counted(np.ndarray):
        def __getitem__(self, i):
            seen.append(len(i))
            return np.asarray(self).__getitem__(i)

    lists.floats = floats.view(Counted)
    ids, score = lists.search(np.array([5, 4, 3]), -1, 1)
    assert ids.tolist() == [17] and score.tolist() == [900 * 12] and sum(seen) < 400


def test_ties_go_to_the_smaller_id():
    lists = K.Lists(np.arange(100)[::-1].copy(), np.ones((100, 2), np.int64))
    ids, _ = lists.search(np.array([1, 1]), 3, 5)
    assert ids.tolist() == [0, 1, 2, 4, 5]


def test_empty_table(spark, rows):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.top_k(df, F.col("id") % 5 == 0, 5).count() == 0


def test_queries_do_not_go_through_the_driver(spark, rows):
    """However small the files of the queries are: a copy of all of them for each block of rows was broadcast."""
    df = spark.createDataFrame([(i, x) for i, x in rows], "vec_id long, embedding array<double>")
    got = K.top_k(df, F.col("id") % 5 == 0, 5, block_rows=7, query_rows=9)
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_every_row_is_a_query(spark, rows, monkeypatch):
    """Queries are dealt over groups, too."""
    monkeypatch.setattr(K, "HELD", 6000)
    rows = [(i and 5 * i, x) for i, x in rows]
    got = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 5 == 0, 5, block_rows=32, query_rows=8).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, 5))


@pytest.mark.parametrize("largest", [2, 300, 100_000, 10**9])
def test_blocks_met_in_turn_equal_brute_force(largest):
    """Few values give ties within and over blocks; large ones pass what floats and doubles hold."""
    rng = np.random.default_rng(largest)
    ids, cells = rng.permutation(700), rng.integers(-largest, largest + 1, (700, 4))
    cells[:300] = cells[0]  # a vector that is common
    best = K.Best(ids[::7], cells[::7], 6)
    for at in range(0, 700, 90):
        K.Lists(ids[at:at + 90], cells[at:at + 90]).meet(best, np.arange(100))
    for n, own in enumerate(ids[::7]):
        found = sorted((-int(s), int(i)) for i, s in zip(ids, cells @ cells[::7][n]) if i != own)[:6]
        assert list(zip((-best.score[n]).tolist(), best.ids[n].tolist())) == found


def test_grid():
    assert K.grid(0, 0, 0, 200, 2048, 1024) == (1, 1)
    assert K.grid(51_282, 1_026, 600_000, 12, 2048, 1024) == (12, 1)
    assert K.grid(15_000_000, 300_000, 60_000_000, 600, 2048, 1024) == (200, 3)
    assert K.grid(15_000_000, 300_000, 10 * K.HELD, 600, 2048, 1024) == (60, 10)
    assert K.grid(1_000_000, 1_000_000, K.HELD, 400, 2048, 1024) == (20, 20)
