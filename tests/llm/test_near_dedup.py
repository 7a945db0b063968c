"""Near duplicates against brute force over shingle sets; signatures against true similarity."""

import random
import re

import numpy as np
import pytest

from hard_rows import HARD
from terrapanel.llm import near_dedup as N

WORD = re.compile(r"\w+")


def shingle_set(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else frozenset()


def brute(rows, similarity=0.8):
    """Class (smallest id) of each row, by links between all pairs."""
    sets = [shingle_set(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both >= similarity * (len(sets[i]) + len(sets[j]) - both) if sets[i] and sets[j] else (rows[i][1] or "") == (rows[j][1] or "")
            if linked and find(i) != find(j):
                parent[find(i)] = find(j)
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(i)
    low = {c: min((i for i in ids if i is not None), default=None) for c, ids in classes.items()}
    return [(rows[k][0], low[find(k)], len(classes[find(k)])) for k in range(len(rows))]


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for base in range(6):  # chains of edits, whose ends are no longer alike
        words = [rnd.choice(vocab) for _ in range(150)]
        for _ in range(12):
            rows.append(" ".join(words))
            words = edited(rnd, words, rnd.choice([0, 1, 2, 3, 6]))
    passage = " ".join(rnd.choice(vocab) for _ in range(120))
    rows += [passage + " " + " ".join(rnd.choice(vocab) for _ in range(n)) for n in (10, 15, 20, 25, 40, 60, 100, 200)]
    rows += ["a b c", "a b c", "A, b; c!", "", "!!", "!!", "??"]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(k, rows[j]) for k, j in enumerate(order)]


def test_classes_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = N.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(brute(corpus))
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.class_id for r in kept) and len(kept) == len({r.class_id for r in got})


def test_hard_rows(hard):
    got = N.near_duplicates(hard).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key((r.doc_id, r.class_id, r.class_size)) for r in got) == sorted(map(key, brute(HARD)))
    kept = N.drop_near_duplicates(hard)
    assert kept.columns == hard.columns and kept.count() == sum(r.kept for r in got) == len({(r.class_id, r.class_size) for r in got})


def test_first_pairs_grow_with_the_members(spark):
    """One leader for each bucket, and the same one wherever it is a member."""
    members = spark.range(400).selectExpr("id AS uid", "id % 3 AS bucket").unionByName(spark.range(1, 400).selectExpr("id AS uid", "7L AS bucket")).unionByName(
        spark.range(1).selectExpr("5L AS uid", "8L AS bucket")).unionByName(spark.range(1).selectExpr("6L AS uid", "8L AS bucket"))
    assert N._first_pairs(members).count() <= 2 * 401


def test_only_what_can_be_alike_is_compared(spark):
    """Near copies with many edits of their own are not compared with each other; a pair that shares its edits is."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    pair = edited(rnd, base, 8)
    rows = [" ".join(edited(rnd, base, 5)) for _ in range(60)] + [" ".join(base), " ".join(pair), " ".join(edited(rnd, pair, 1))]
    elements = spark.createDataFrame([(k, N.shingles(t, 5)[0].view(np.int64).tolist()) for k, t in enumerate(rows)], "uid long, elements array<long>")
    open_ = spark.range(len(rows)).selectExpr("id AS uid", "1L AS bucket", "id AS class", "60L AS main")
    rare = N._rare_shingles(open_.select("uid"), elements)
    room = N._room(open_.select("uid"), elements, rare)
    pairs, most = N._further_pairs(open_, room, 0.8, 1000)
    pairs = pairs.unionByName(N._rare_pairs(rare, room, open_.select("uid", "class"), 0.8))
    sets = [shingle_set(t) for t in rows]
    alike = {(j, i) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(r.a, r.b) for r in pairs.collect()}
    assert alike <= got and (61, 62) in got and len(got) < 200


@pytest.mark.parametrize("counted", [False, True])
def test_signatures_estimate_weighted_similarity(counted):
    rng = np.random.default_rng(5)
    a = np.sort(rng.integers(1, 2**63, 300).astype(np.uint64))
    wa = rng.integers(1, 9, 300).astype(float) if counted else np.ones(300)
    wb = np.where(rng.random(300) < 0.3, rng.integers(1, 9, 300), wa) if counted else np.ones(300)
    keep = rng.random(300) < 0.85
    b, wb = a[keep], wb[keep]
    full = np.zeros(300)
    full[keep] = wb
    true = np.minimum(wa, full).sum() / np.maximum(wa, full).sum()
    n = 3000
    docs = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    sig = N.signatures(np.r_[a, b], np.r_[wa, wb], docs, 2, n)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / n) ** 0.5


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(1, 2**63, n).astype(np.uint64)) for n in (1, 3, 50, 4000)]
    docs = np.repeat(np.arange(4), [len(s) for s in sets])
    together = N.signatures(np.concatenate(sets), np.ones(len(docs)), docs, 4, 150)
    for k, s in enumerate(sets):
        alone = N.signatures(s, np.ones(len(s)), np.zeros(len(s), int), 1, 150)
        assert (alone[0] == together[k]).all()


def test_counted_shingles_tell_repeats_apart(spark):
    once, often = "one two three four five six seven eight nine ten", " ".join(["one two three four five six seven eight nine ten"] * 9)
    df = spark.createDataFrame([(1, often), (2, often + " " + often), (3, once)], "doc_id long, text string")
    sets = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    counted = {r.doc_id: r.class_id for r in N.near_duplicates(df, counted=True).collect()}
    assert sets[2] == 1 and counted[2] == 2


def test_only_texts_that_share_a_bucket_are_shuffled(spark, exchanged, monkeypatch):
    """Also where the table of them is too large for a broadcast; copies of one text are shuffled once for each partition."""
    rnd = random.Random(3)
    texts = [" ".join(f"word{rnd.randrange(10**8)}" for _ in range(2000)) for _ in range(60)]
    texts += [texts[0] + " more", *[texts[1] + " more"] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()
    sizes = []
    real = N.store
    monkeypatch.setattr(N, "store", lambda x: (sizes.append(exchanged(x)), real(x))[1])
    classes = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert classes == {k: 0 if k == 60 else 1 if k > 60 else k for k in range(91)}
    assert sizes and max(sizes) < sum(map(len, texts)) / 5


def test_shingles_are_shuffled_once(spark, exchanged, monkeypatch):
    """Those of documents that are compared further; no arrays of them, and a shingle of all documents RARE + 1 times a task at most."""
    rnd = random.Random(4)
    common = [rnd.getrandbits(62) for _ in range(800)]
    sets = [sorted(common + [rnd.getrandbits(62) for _ in range(800)] + [k // 2]) for k in range(60)]
    elements = spark.createDataFrame(list(enumerate(sets)), "uid long, elements array<long>").repartition(2).cache()
    docs = spark.range(40).withColumnRenamed("id", "uid").cache()
    sizes = []
    real = N.store
    monkeypatch.setattr(N, "store", lambda x: (sizes.append(exchanged(x)), real(x))[1])
    rare = N._rare_shingles(docs, elements)
    room = {r.uid: (r.own, r.shared) for r in N._room(docs, elements, rare).collect()}
    assert room == {k: (801, 800) for k in range(40)}
    assert sum(sizes) < 45 * 40 * 801
    pairs = N._rare_pairs(rare, spark.createDataFrame([(k, 801, 800) for k in range(40)], "uid long, own long, shared long"), docs.selectExpr("uid", "uid AS class"), 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {(k, k + 1) for k in range(0, 40, 2)}


def test_empty_table(empty):
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0
