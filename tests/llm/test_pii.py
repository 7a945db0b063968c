"""Personal data against the same base patterns in Python, and the label model on known reliabilities."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hard_rows import HARD
from terrapanel.llm import pii as P
from terrapanel.llm import spans as S


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda s: (s[0], P.KINDS.index(s[1]))))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    bits = ["a", "1", "2", "33", ".", " ", "-", "@", "+", "(", ")", "é", "😀", "x.y", "@b.c", "1.2.3.4", "\n", "%", "_", "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "256.1.1.1", "00001.2.3.004"]
    own = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    return [*own, None, "", "1" * 20000, "a" * 20000, "1.2" * 5000, "a@b.c " * 3000, "+1 " + " " * 5000, "a@b.c_d@e.f", "1 2" * 4000]


def test_base_spans_equal_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = P.find_pii(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", P.spans_text(F.col("base")).alias("b"), P.spans_text(F.col("spans")).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id] or "")
        assert r.b == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in P.KINDS]
        assert not want or set(want.split(",")) <= set(r.s.split(","))


def test_running_sums_over_blocks(spark):
    n = [0, 1, 127, 128, 129, 1000]
    df = spark.createDataFrame([(list(range(k)),) for k in n], "a array<int>")
    for r in df.select("a", S.running_sums(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:k + 1]) for k in range(len(r.a))]


@pytest.mark.parametrize("seed", range(1, 7))
def test_em_finds_the_reliable_labelers(seed):
    """Three informative labelers and a coin: the estimate is as good as knowing how reliable each is."""
    rnd, good = random.Random(seed), (0.95, 0.9, 0.8, 0.5)
    counts, cases = {}, []
    for _ in range(4000):
        truth = rnd.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if rnd.random() < p else -1) for p in good)
        counts[0, votes] = counts.get((0, votes), 0) + 1
        cases.append((truth, votes))
    p = P.estimate_votes(counts)
    log_odds = lambda v: math.log(0.4 / 0.6) + sum(x * math.log(q / (1 - q)) for x, q in zip(v, good))
    right, best = (sum(f(v) == t for t, v in cases) / len(cases) for f in (lambda v: p[0, v] >= 0.5, lambda v: log_odds(v) >= 0))
    assert right > best - 0.005 and all(0 <= x <= 1 for x in p.values())
    with pytest.raises(RuntimeError):
        P.estimate_votes(counts, rounds=3)


def test_classifier_adds_what_context_supports(spark):
    good = [f"please call my phone {a}{b} today" for a in ("743-555-", "212 555 ") for b in range(1000, 1040)]
    mail = [f"contact: joe{k} [at] mail [dot] com" for k in range(30)]
    base_rows = [f"write to joe{k}@mail.com or call +1 743 555 {k + 1000}" for k in range(60)]
    bad = [f"order 1{k:03d}#123 456 {k + 1000} x" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(good + mail + base_rows + bad)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.find_pii(df).collect()}
    assert sum(r.n_added for i, r in got.items() if i < 80) >= 70
    assert all(not any(s in r.base for s in r.spans if s not in r.base) and set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got.values())


def test_hard_rows_and_empty_table(hard, empty):
    got = P.find_pii(hard)
    assert got.count() == len(HARD) and got.filter("size(spans) > 0").count() == 0
    assert P.find_pii(empty).count() == 0
