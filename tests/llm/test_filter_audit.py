"""The audit against applying every order to every document."""

import re
from collections import Counter
from itertools import permutations

from hard_rows import HARD

from terrapanel.llm.filter_audit import audit


def fails(i, text, docs):
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    out = {"A"} if len(w) < 100 else set()
    out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set())


def brute(docs, good, toxic):
    rows = [(p or "", i, fails(i, t or "", docs)) for i, t, p in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[2] for r in own) - len(gone), sum(r[2] == {f} for r in own),
                                                   sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def compared(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(d, marks).collect()
    want = brute(docs, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    return want


def test_all_orders(spark):
    long = " ".join(f"word{k}" for k in range(120))
    docs = [(1, long, "en"), (2, long, "en"), (3, long, "fr"), (4, long + " #", "en"), (5, "A B C", "en"), (6, "short", "fr"), (7, "again " * 200, "en"),
            (8, long.upper(), "fr"), (9, None, None), (10, "", ""), (11, "A $ A", "en"), (12, "A $ A", "en"), (2, long, "en"), (1, "A $ A", "fr")]
    labels = [(2, 1, 0), (3, 0, 1), (3, 1, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (12, 1, 1)]
    want = compared(spark, docs, labels)
    assert len(want) == 3 * 600 and any(v[4] for v in want.values()) and any(v[5] for v in want.values())


def test_hot_group_makes_rows_not_pairs(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id) END AS text", "'x' AS lang")
    got = {r.step: r for r in audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD'").collect()}
    assert got[1].removed == 999 and got[1].unique_fails == 0 and got[2].redundant == 999


def test_hard_rows(spark, hard, empty):
    docs = [(i, t, "x" if k % 2 else None) for k, (i, t) in enumerate(HARD)]
    compared(spark, docs, [(1, 1, 0), (None, 1, 1)])
    labels = spark.createDataFrame([(1, 1, 1, "x")], "doc_id long, quality int, toxic int, n string")
    assert audit(hard, labels, part_col="source").count() == 600 and audit(empty, labels, part_col="source").count() == 0
