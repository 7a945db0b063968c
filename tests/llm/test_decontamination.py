"""Winnowing against comparing every window."""

import random
import re

import pytest
from pyspark.sql import functions as F
from hard_rows import HARD

from terrapanel.llm.decontamination import contamination, gram_hashes, shape, winnow, words_of
from terrapanel.llm.sieve import sieve

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, length):
    w, hit, names = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), length)
        there = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i:i + n]) in there:
                hit |= set(range(i, i + n))
                if item is not None:
                    names.add(str(item))
    return len(w), len(hit), sorted(names)


def compared(spark, docs, items, length):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b, length).select("doc_id", "n_words", "n_hit", "n_items", "items").collect()
    key = lambda r: tuple((x is None, x) for x in r[:4])
    want = [(i, *brute(t, items, length)) for i, t in docs]
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r.n_items == len(r["items"]) for r in got)
    return want


@pytest.mark.parametrize("length", [1, 2, 3, 10])
def test_random_texts_of_few_words(spark, length):
    """Two letters as words: windows overlap, repeat and lie in many items."""
    rnd = random.Random(length)
    text = lambda n: " ".join(rnd.choice(["a", "B", "é", "10"]) for _ in range(n))
    items = [(k, text(rnd.randint(0, 25))) for k in range(12)]
    docs = [(k, text(rnd.randint(0, 60))) for k in range(40)]
    assert any(w[2] for w in compared(spark, docs, items, length))


def test_shared_spans_of_every_length_and_place(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([9, 10, 11, 30, 3, 1, 0, 10])] + [(None, "Only here: no id, but TEXT that nobody else has got"), (3, "an id that is used twice " * 3)]
    docs = []
    for k in range(60):
        v = rnd.choice(items)[1].split()
        a = rnd.randrange(len(v) + 1)
        span = v[a:a + rnd.randint(8, 14)]
        own = [word() for _ in range(rnd.randint(0, 30))]
        at = rnd.randrange(len(own) + 1)
        docs.append((k, ", ".join([*own[:at], *span, *own[at:]]).upper()))
    want = compared(spark, docs, items, 10)
    assert any(w[2] for w in want) and any(not w[2] for w in want)


def test_every_window_holds_a_fingerprint(spark):
    text = " ".join(str(k * k % 97) for k in range(200))
    for n in (1, 2, 5, 9, 10, 13):
        h, f = spark.range(1).select(words_of(F.lit(text)).alias("w")).select(gram_hashes(F.col("w"), n).alias("h")).select("h", winnow(F.col("h"), n)).first()
        k, w = shape(n)
        assert k + w - 1 == n and all(set(h[i:i + w]) & set(f) for i in range(len(h) - w + 1)) and len(h) == 200 - k + 1


def test_sieve_passes_all_members_and_few_others(spark):
    inside, outside = spark.range(3000).select(F.xxhash64("id").alias("h")), spark.range(3000, 9000).select(F.xxhash64("id").alias("h"))
    test = sieve(inside, "h")
    assert inside.filter(test(F.col("h"))).count() == 3000 and outside.filter(test(F.col("h"))).count() < 60
    assert inside.filter(sieve(inside.limit(0), "h")(F.col("h"))).count() == 0


def test_sieve_of_bits_holds_more_hashes_than_one_of_bytes(spark, monkeypatch):
    """Outside of lambdas eight times as many fit; beyond that all rows pass."""
    monkeypatch.setattr("terrapanel.llm.sieve.MOST", 1 << 13)
    inside, outside = spark.range(6000).select(F.xxhash64("id").alias("h")), spark.range(6000, 12000).select(F.xxhash64("id").alias("h"))
    test = sieve(inside, "h", in_lambdas=False)
    assert inside.filter(test(F.col("h"))).count() == 6000 and outside.filter(test(F.col("h"))).count() < 600
    assert outside.filter(sieve(spark.range(40_000).select(F.xxhash64("id").alias("h")), "h", in_lambdas=False)(F.col("h"))).count() == 6000


def test_hard_rows(spark, hard, empty):
    items = [(1, "one two three four five six one two three four"), (2, None), (3, ""), (4, "a b c"), (5, "no id here, but a text")]
    b = spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, key int, words string")
    got = contamination(hard, b).select("doc_id", "n_words", "n_hit", "items").collect()
    want = [(i, *brute(t, items, 10)) for i, t in HARD]
    key = lambda r: tuple((x is None, x) for x in r[:3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert contamination(empty, b).count() == 0
    assert {r.n_hit for r in contamination(hard, b.limit(0)).collect()} == {0}
    assert {r.n_items for r in contamination(hard, b.filter("item_id IN (2, 3)")).collect()} == {0}
