"""Exact duplicates against grouping by text."""

from collections import defaultdict

import pytest
from hard_rows import HARD
from pyspark.sql import functions as F

from terrapanel.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, merge_runs, digest_rows


def groups(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[t or ""].append(i)
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_groups_sizes_and_kept_rows(hard, keep, fan_in):
    got = exact_duplicates(hard.repartition(5), keep=keep, fan_in=fan_in).collect()
    want = groups(HARD)
    assert len(got) == len(HARD) and sum(r.kept for r in got) == len(want)
    pick = min if keep == "smallest" else max
    best = {}
    for ids in want.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            best[i, len(ids)] = pick(known) if known else None
    assert all(r.keep_id == best[r.doc_id, r.group_size] for r in got)


def test_dropping_keeps_columns_and_one_row_of_each_text(hard):
    got = drop_exact_duplicates(hard, keep="largest")
    assert got.columns == hard.columns
    assert sorted(r.text or "" for r in got.collect()) == sorted(groups(HARD))


def test_hot_text_reaches_every_level_as_one_entry(spark):
    df = spark.range(0, 4000, 1, 16).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS text")
    first, last = merge_runs(digest_rows(df, "doc_id", "text"), fan_in=4)
    assert first.count() <= 4000 - 1334 + 16
    assert last.filter("n > 1").select("keep.id", "n").collect() == [(0, 1334)]


@pytest.mark.parametrize("runs,fan_in", [(16, 2), (16, 4), (11, 4), (3, 8)])
def test_the_last_run_lies_in_order_over_disjoint_partitions(spark, runs, fan_in):
    df = spark.range(0, 3000, 1, runs).selectExpr("id AS doc_id", "CAST(id % 1000 AS STRING) AS text")
    _, last = merge_runs(digest_rows(df, "doc_id", "text"), fan_in=fan_in)
    got = [(r.p, bytes(r.sha)) for r in last.select("*", F.spark_partition_id().alias("p")).collect()]
    assert len(got) == 1000 and got == sorted(got) and [s for _, s in got] == sorted(s for _, s in got)
    assert len({p for p, _ in got}) == runs
    last.collect()
    plan = last._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].lower()
    assert plan.count("exchange shufflepartitionidpassthrough") == len([k for k in range(9) if fan_in**k < runs])
    assert plan.count("hashpartitioning") == 1  # the first runs; no merge hashes again


def test_empty_table(empty):
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def test_unknown_choice_is_refused(hard):
    with pytest.raises(ValueError):
        exact_duplicates(hard, keep="any").count()


def test_no_plan_holds_the_sieve_itself(spark):
    """A description of a plan names the table of dropped rows, and stays small however many they are."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 1500) AS text")
    kept = drop_exact_duplicates(docs)
    assert len(kept._jdf.queryExecution().executedPlan().toString()) < 50_000
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(1500))
