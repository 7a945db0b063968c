"""The node table against a trie built turn by turn."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from terrapanel.llm.perfect_hash import PerfectHash
from terrapanel.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def compared(spark, rows, **options):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.fixture
def talks():
    rnd, rows = random.Random(3), []
    for c in [*range(40), *range(180, 230), 405, 406, -3, -104, -100]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["yes", "no", "ünïcödé 😀"]), "d", 1))
    return rows


@pytest.mark.parametrize("options", [{}, {"segment": 3, "shard_rows": 40}, {"segment": 1, "shard_rows": 25}])
def test_pieces_and_shards_change_nothing(spark, talks, options):
    want = compared(spark, talks, **options)
    assert any(w[3] > 20 for w in want) and any(w[5] > 3 for w in want)


def test_hard_rows(spark):
    """NULLs in every column, ties, repeated rows, a very long text, conversations that become empty."""
    rows = [(0, None, "user", "first", "d", 1), (0, 0, None, None, "d", 1), (0, 0, "user", "tie", "d", 1), (0, 0, "user", "tie", "d", 1), (None, 1, "user", "nobody", "d", 1),
            (7, 5, "user", "x" * 200_000, None, None), (8, None, None, None, "d", 1), (250, 1, "a", "bc", "d", 1), (251, 1, "ab", "c", "d", 1), (300, 1, "", "", "d", 1)]
    rows += [(k, 1, "user", "own", "d", 1) for k in range(501, 530)]  # no conversation 500 to begin with
    want = compared(spark, rows)
    assert compared(spark, rows, segment=2, shard_rows=3) == want
    got = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(got).count() == 0


def test_long_and_common_conversations(spark):
    """One conversation of 900 turns, and one that 60 others repeat."""
    rows = [(200, k, "user", f"turn {k}", "d", 1) for k in range(900)]
    rows += [(c, k, "user", "same", "d", 1) for c in range(100, 161) for k in range(8)]
    compared(spark, rows, segment=64, shard_rows=100)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rnd = np.random.default_rng(n)
    keys = rnd.integers(0, 2**63, (n, 2)).astype(np.uint64)
    keys[:, 0] %= 7  # halves that repeat
    table = PerfectHash(keys)
    assert sorted(table.slots(keys)) == list(range(n))
    other = keys.copy()
    other[:, 1] += np.uint64(1)
    known = {tuple(k) for k in keys.tolist()}
    assert all((s >= 0) == (tuple(k) in known) for s, k in zip(table.slots(other), other.tolist()))


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError):
        PerfectHash(np.zeros((2, 2), np.uint64))
