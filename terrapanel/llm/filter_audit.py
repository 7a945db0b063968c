"""How quality filters interact: what each removes at every place of every order.

Filters (a document fails where the condition holds):
A under 100 words, B under 80 distinct words in 100, C over 10 capitals in 100
code points, D any of a few symbols, E the same text under a smaller id.

A to D come from one pass over the texts. E is an existential self-join: a
left-semi join on the text's hash, the exact text and a smaller id. Its right
side holds one row for each text, the one with the smallest id, so a group of n
copies gives n rows, not pairs. Only rows whose hash occurs more than once can
fail E; a sieve keeps the texts of most others out of the shuffle.

The ids of E's failures are united with those of the others, one set of filter
bits for each document, and counted for each part and combination of bits.
Orders and steps are then worked out on at most 32 counts of a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import let, store, text_key, text_or_empty
from terrapanel.llm.sieve import sieve

FILTERS = "ABCDE"
_COMBINATIONS = 1 << len(FILTERS)
# fixed values of the filters
_LEAST_WORDS, _LEAST_DISTINCT, _MOST_CAPITALS, _SYMBOLS = 100, 80, 10, "[#$%&*|]"
_BLANKS = r"[\x20\x09-\x0D]+"


def own_bits(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    few = let(words, lambda w: F.when(F.size(w) < _LEAST_WORDS, 1).otherwise(0)
              + F.when(F.lit(100).cast("bigint") * F.size(F.array_distinct(w)) < F.lit(_LEAST_DISTINCT).cast("bigint") * F.size(w), 2).otherwise(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return few + F.when(F.lit(100).cast("bigint") * capitals > F.lit(_MOST_CAPITALS).cast("bigint") * F.length(text), 4).otherwise(0) + F.when(
        F.regexp_like(text, F.lit(_SYMBOLS)), 8).otherwise(0)


def copies(docs: DataFrame, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """`keep` of each row whose text also stands under a smaller id; a row without an id has no smaller one, nor is it one."""
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text_or_empty(f"`{text_col}`").alias("__text"), *keep).withColumn("__hash", F.xxhash64("__text"))
    often = store(rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash"))
    suspects = rows.filter(sieve(often, "__hash")(F.col("__hash")))
    first = suspects.groupBy(F.col("__hash").alias("h"), F.col("__text").alias("t")).agg(F.min("__id").alias("smallest"))
    same = (suspects["__hash"] == first["h"]) & (suspects["__text"] == first["t"]) & (first["smallest"] < suspects["__id"])
    return suspects.join(first, same, "left_semi").drop("__id", "__text", "__hash")


def filter_bits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Distinct (id, key, part) with `n` rows and `bits` of failed filters; key is 128 bits of the text's SHA-256."""
    who = [F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("key"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part")]
    all_rows = docs.select(*who, F.lit(1).alias("n"), own_bits(text_or_empty(f"`{text_col}`")).alias("bits"))
    marked = copies(docs, id_col, text_col, who).select("id", "key", "part", F.lit(0).alias("n"), F.lit(16).alias("bits"))
    # rows alike in id, text and part fail the same filters
    return all_rows.unionAll(marked).groupBy("id", "key", "part").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))


def _counts(value: str) -> Column:
    """An array of the sums of `value` for each combination of bits, within a group."""
    return F.array(*[F.sum(F.when(F.col("bits") == b, F.col(value)).otherwise(0)).cast("bigint") for b in range(_COMBINATIONS)])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          label_id: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    NULL texts count as empty, NULL parts as the part with the empty name. A
    document is good, or toxic, where any label row of its id says 1. Documents
    that share an id are documents of their own. An empty table gives no rows.
    Other columns are not read.
    """
    marks = labels.filter(F.col(f"`{label_id}`").isNotNull()).groupBy(F.col(f"`{label_id}`").alias("id")).agg(
        F.max(F.when(F.col(f"`{good_col}`") == 1, 1).otherwise(0)).alias("is_good"), F.max(F.when(F.col(f"`{toxic_col}`") == 1, 1).otherwise(0)).alias("is_toxic"))
    rows = filter_bits(docs, id_col, text_col, part_col).join(marks, "id", "left").select(
        "part", "bits", "n", (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"))
    parts = rows.groupBy("part").agg(_counts("n").alias("n"), _counts("good").alias("good"), _counts("toxic").alias("toxic"))

    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    steps = parts.select("part", orders, "n", "good", "toxic").select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before = F.expr("substring(filter_order, 1, step - 1)")
    prior = sum((F.when(F.instr(before, f) > 0, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    own = F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")
    steps = steps.withColumns({"prior": prior, "own": own})

    def total(value: str, holds) -> Column:
        each = F.transform(F.col(value), lambda x, b: F.when(holds(b), x).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x)

    fails = lambda b: b.bitwiseAND(F.col("own")) != 0
    gone = lambda b: b.bitwiseAND(F.col("prior")) != 0
    here = lambda b: fails(b) & ~gone(b)
    # of all orders, a filter comes first among a document's m failed ones in one m-th
    share = F.transform(F.col("n"), lambda x, b: F.when(fails(b), (x * F.lit(120) / F.bit_count(b)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda b: b.bitwiseAND(F.col("prior").bitwiseOR(F.col("own"))) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda b: fails(b) & gone(b)).alias("redundant"),
        total("n", lambda b: b == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("shapley"))
