"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier decides.

Patterns propose spans. Four labelers vote on each for, against or not at all:
its form, a gazetteer (top-level domains, issuer and area prefixes), the words
before it and the character before it. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is and how likely each
pattern is to be personal data, without any labels. These probabilities train a
logistic classifier on votes and form, which decides on spans that the base
patterns do not settle; base spans always stay. Texts are only ever handled by
Spark's own functions; the driver sees counts of vote patterns, at most 3^4 for
each kind.
"""

from __future__ import annotations

import math

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import let, store, text_or_empty
from terrapanel.llm.spans import find_all, joined, only_where

KINDS = ["email", "ip", "card", "phone"]

# Base patterns. Runs are taken whole (++), as nothing shorter could match, so that no text is gone through again from the middle.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Wider patterns, whose spans only the classifier can add
HIDDEN_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]++)++"
NATIONAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"

BEFORE = 24  # characters before a span that the context labeler sees
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp|cn|in|br|ru|example|test"
_CUES = ["e-?mail|mailto|contact|write|reach", r"\bip\b|host|server|address|client|from", "card|visa|master|amex|credit|pay", "phone|call|tel|mobile|fax|dial|contact|ring"]
_AGAINST = ["@|version", r"version|\bv\.?\s*$|release|section|chapter", r"isbn|order|serial|\bid\b|\bno\b|#", r"isbn|order|serial|\bid\b|total|price"]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def total(rev: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            d = F.substring(rev, i, F.lit(1)).cast("int") * (F.lit(1) + (i + 1) % 2)
            return s + d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), step)

    return let(F.reverse(digits), lambda r: total(r) % 10 == 0)


def valid(kind: int, v: Column) -> Column:
    """The base checks of a match."""
    n = F.length(_digits(v))
    if kind == 1:
        return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == 2:
        return F.when((n >= 14) & (n <= 19), luhn(_digits(v))).otherwise(F.lit(False))
    return (n >= 10) & (n <= 15) if kind == 3 else F.lit(True)


def _gazetteer(kind: int, v: Column) -> Column:
    good = [v.rlike(rf"(?i)(?:\.|dot[\])}}] ?)(?:{_DOMAINS})$"), ~v.rlike(r"^0|^(?:[0-9]\.){3}[0-9]$"),
            v.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), v.rlike(r"^(?:\+[1-9]|\(?[2-9])")][kind]
    return F.when(good, F.lit(1)).otherwise(F.lit(-1))


def _context(kind: int, before: Column) -> Column:
    low = F.lower(before)
    return F.when(low.rlike(_AGAINST[kind]), F.lit(-1)).when(low.rlike(_CUES[kind]), F.lit(1)).otherwise(F.lit(0))


def _neighbour(before: Column) -> Column:
    return F.when(before.rlike(r"[\p{L}\p{N}#$=/_%-]$"), F.lit(-1)).when(before.rlike(r"[\s(\[\"':,;<]$") | (before == ""), F.lit(1)).otherwise(F.lit(0))


def _candidates(text: Column) -> Column:
    """Array of (start, kind, end, base, votes, form) of all proposed spans."""
    def made(found: Column, kind: int, wide: bool) -> Column:
        def one(m: Column) -> Column:
            v, n = m["value"], F.length(m["value"])
            ok = F.lit(False) if wide else valid(kind, v)
            shape = F.lit(0) if wide else F.when(ok, F.lit(1)).otherwise(F.lit(-1))
            votes = F.array(shape, _gazetteer(kind, v), _context(kind, m["before"]), _neighbour(m["before"]))
            share = F.length(_digits(v)) / n
            form = F.array(*[c.cast("int") for c in (n < 12, n >= 20, share < 0.3, share >= 0.8, v.contains(" "))])
            return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), ok.alias("base"), votes.alias("votes"), form.alias("form"))

        return F.transform(found, one)

    at, plus = F.instr(text, "@") > 0, F.instr(text, "+") > 0
    return F.concat(
        made(only_where(at, lambda: find_all(text, EMAIL, BEFORE)), 0, False),
        made(only_where(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), lambda: find_all(text, IP, BEFORE)), 1, False),
        made(only_where(text.rlike("[0-9](?:[ -]?[0-9]){13}"), lambda: find_all(text, CARD, BEFORE)), 2, False),
        made(only_where(plus, lambda: find_all(text, PHONE, BEFORE)), 3, False),
        made(only_where(text.rlike(r"(?i)[\[({]at[\])}]"), lambda: find_all(text, HIDDEN_EMAIL, BEFORE)), 0, True),
        made(only_where(text.rlike("[0-9]{3}[ .-][0-9]{4}"), lambda: find_all(text, NATIONAL_PHONE, BEFORE)), 3, True))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, found: a stored row for each document, with its proposed spans but no text.

    A chain of digits counts as a proposal for a card from 14 digits on.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    found = own.select("id", _candidates(F.col("text")).alias("found"))
    chain = lambda c: (c["kind"] != 2) | (c["end"] - c["start"] >= 14)
    return store(found.select("id", F.filter("found", chain).alias("found")))


def estimate_votes(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 100_000) -> dict[tuple[int, tuple[int, ...]], float]:
    """Probability of each (kind, votes) that the span is personal data, from how often each occurs.

    Expectation-maximisation of a two-class model for each kind, in which
    labelers vote independently given the class. It starts from labelers that
    are right more often than not, which fixes which class is which, and goes on
    until a round adds less than 1e-10 to the log likelihood of a span; not
    getting there within `rounds` is an error.
    """
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in {k for k, _ in counts}:
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        labelers = range(len(rows[0][0]))
        prior = 0.5
        chance = [[{-1: 0.2, 0: 0.2, 1: 0.6}, {-1: 0.6, 0: 0.2, 1: 0.2}] for _ in labelers]
        post: list[float] = []
        total, likely = sum(n for _, n in rows), -math.inf
        for _ in range(rounds):
            post, before, likely = [], likely, 0.0
            for votes, n in rows:
                a, b = prior, 1 - prior
                for j in labelers:
                    a, b = a * chance[j][0][votes[j]], b * chance[j][1][votes[j]]
                post.append(a / (a + b))
                likely += n * math.log(a + b)
            if abs(likely - before) < 1e-10 * total:
                break
            yes = sum(p * n for p, (_, n) in zip(post, rows))
            prior = (yes + 1) / (total + 2)
            for j in labelers:
                for vote in (-1, 0, 1):
                    hit = [(p * n, (1 - p) * n) for p, (v, n) in zip(post, rows) if v[j] == vote]
                    chance[j][0][vote] = (sum(h[0] for h in hit) + 0.5) / (yes + 1.5)
                    chance[j][1][vote] = (sum(h[1] for h in hit) + 0.5) / (total - yes + 1.5)
        else:
            raise RuntimeError(f"the estimate has not settled after {rounds} rounds")
        out.update({(kind, v): p for p, (v, _) in zip(post, rows)})
    return out


def _features(c: Column) -> Column:
    """0/1 features of a span: its kind, each vote and its form, votes also by kind."""
    kind = [(c["kind"] == k) for k in range(len(KINDS))]
    votes = [(c["votes"][j] == v) for j in range(4) for v in (-1, 1)]
    both = [k & v for k in kind for v in votes]
    return F.concat(F.array(*[x.cast("double") for x in [*kind, *votes, *both]]), c["form"].cast("array<double>"))


@dataclass
class Classifier:
    """Weights of the span classifier."""

    weights: list[float]
    bias: float

    def accepts(self, c: Column) -> Column:
        total = F.aggregate(F.zip_with(_features(c), F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w), F.lit(self.bias), lambda s, x: s + x)
        return total >= 0


def fit(found: DataFrame, ridge: float = 0.01) -> Classifier:
    """Estimate the labelers on all proposed spans, then train the classifier on the estimates."""
    spans = found.select(F.explode("found").alias("c"))
    groups = store(spans.groupBy("c.kind", "c.votes", "c.form").agg(F.count(F.lit(1)).alias("n")))
    rows = groups.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in rows}
    if not counts:
        return Classifier([0.0] * (4 + 8 + 32 + 5), -1.0)
    key = F.concat_ws(",", "kind", F.array_join("votes", ","))
    table = F.create_map(*[x for (k, v), p in estimate_votes(counts).items() for x in (F.lit(",".join(map(str, (k, *v)))), F.lit(p))])
    own = groups.withColumn("p", table[key])
    both = own.withColumn("case", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("n")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("n")).alias("weight"))))).filter("case.weight > 0")
    c = F.struct("kind", "votes", "form")
    train = both.select(array_to_vector(_features(c)).alias("features"), "case.label", "case.weight")
    model = LogisticRegression(weightCol="weight", regParam=ridge, standardization=False, maxIter=50).fit(train)
    return Classifier([float(x) for x in model.coefficients], float(model.intercept))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_email, n_ip, n_card, n_phone, base, spans, n_added.

    The counts and `base` are of spans that pass the base patterns and checks;
    `spans` adds those that the classifier accepts and that overlap no base
    span. Both are arrays of (start, kind, end), places in code points, end
    exclusive, kind a place in KINDS. NULL counts as empty and has no spans;
    repeated rows each have theirs. Other columns are not read.
    """
    found = candidates(docs, id_col, text_col)
    classifier = fit(found)
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), plain))
    own = found.select("id", "found", base.alias("base"))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.transform(F.filter("found", lambda c: ~c["base"] & classifier.accepts(c) & free(c)), plain)
    own = own.select("id", "base", F.array_sort(F.array_distinct(added)).alias("added"))
    of_kind = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return own.select(F.col("id").alias(id_col), *counts, "base", F.array_sort(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def base_digest(base: Column) -> Column:
    """SHA-256 of the spans as text."""
    return F.sha2(joined(base, KINDS), 256)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return joined(spans, KINDS)
