"""Benchmark decontamination by winnowing.

A window is `length` consecutive words of an item (a shorter item is one window
of its own length). Of every run of w consecutive k-gram hashes the smallest
is a fingerprint; with w + k - 1 = window length, any span that a document and
an item share and that is at least a window long holds a fingerprint of both.

Documents are fingerprinted row by row. A sieve built from the items'
fingerprints tells which of a document's fingerprints can matter, and only
those leave the row, each with the few words around it that a window through
it can cover: texts are never shuffled. They are joined exactly with the items'
fingerprints; the hits left are extended to all windows through them, which are
compared word by word with the items' windows.

Texts that are equal have equal results, so copies are examined once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import let, store, text_key, text_or_empty
from terrapanel.llm.sieve import sieve

# the bytes that are not part of a word, once A-Z are lower case
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z as a-z and other letters unchanged."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BREAK), "")


def shape(window: int) -> tuple[int, int]:
    """(k, w) of windows of so many words: k-gram length and hashes in each winnowing run."""
    k = (window + 1) // 2
    return k, window - k + 1


def _each(first: int, count: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """`body` of each of `count` numbers from `first` on; empty where the count is not positive."""
    last = count + (first - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(first), last), body)).otherwise(F.array().cast(f"array<{kind}>"))


def gram_hashes(words: Column, window: int) -> Column:
    """Hash of the k words from each place on; empty for texts shorter than a window."""
    k, _ = shape(window)
    count = F.when(F.size(words) >= window, F.size(words) - (k - 1)).otherwise(0)
    return _each(1, count, lambda i: F.xxhash64(F.slice(words, i, k), F.lit(window)), "bigint")


def winnow(hashes: Column, window: int) -> Column:
    """The distinct fingerprints: the smallest hash of every w consecutive ones."""
    _, w = shape(window)
    return F.array_distinct(_each(1, F.size(hashes) - (w - 1), lambda i: F.array_min(F.slice(hashes, i, w)), "bigint"))


def _seeds(words: Column, window: int, test: Callable[[Column], Column]) -> Column:
    """Places of the fingerprints that pass the test: hash, first word kept (from 0) and the words a window through it can cover."""
    k, _ = shape(window)
    reach = window - k

    def placed(h: Column, kept: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_contains(kept, F.element_at(h, i)))
        return F.transform(at, lambda i: let(F.greatest(i - reach, F.lit(1)), lambda a: F.struct(
            F.lit(window).alias("length"), F.element_at(h, i).alias("hash"), (a - 1).alias("first"), F.slice(words, a, i + (k - 1 + reach) - a + 1).alias("words"))))

    none = F.array().cast("array<struct<length:int,hash:bigint,first:int,words:array<string>>>")
    return let(gram_hashes(words, window), lambda h: let(F.filter(winnow(h, window), test), lambda kept: F.when(
        F.size(kept) > 0, placed(h, kept)).otherwise(none)))


def _windows(words: Column, length: Column | int, first: Column | int = 0) -> Column:
    """All runs of `length` words as (first word, words)."""
    size = F.lit(length) if isinstance(length, int) else length
    count = F.size(words) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(
        (i - 1 + first).alias("first"), F.array_join(F.slice(words, i, size), " ").alias("window")))).otherwise(
        F.array().cast("array<struct<first:int,window:string>>"))


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items (sorted as strings), spans (first word, end).

    NULL and empty texts have no words. An item without an id marks words but is
    not listed; items that share an id count once. Rows with equal texts get
    equal results whatever their ids. Spans are the windows found, in order;
    they may overlap. Without items, or without documents, nothing is hit.
    Other columns are not read.
    """
    item = store(items.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(text_or_empty(f"`{item_text_col}`")).alias("words")).filter(
        F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(length))))
    lengths = [r[0] for r in item.select("length").distinct().orderBy("length").collect()]  # `length` values at most

    marks = [item.filter(F.col("length") == n).select(F.explode(winnow(gram_hashes(F.col("words"), n), n)).alias("hash")) for n in lengths]
    prints = marks[0] if marks else item.select(F.lit(0).cast("bigint").alias("hash")).limit(0)
    for m in marks[1:]:
        prints = prints.unionByName(m)
    prints = store(prints.distinct())
    test = sieve(prints, "hash")

    text = text_or_empty(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("key"), words_of(text).alias("words"))
    found = [_seeds(F.col("words"), n, test) for n in lengths]
    none = F.array().cast("array<struct<length:int,hash:bigint,first:int,words:array<string>>>")
    rows = store(rows.select("id", "key", F.size("words").cast("bigint").alias("n_words"), F.concat(*found, none).alias("seeds")))

    seeds = rows.filter(F.size("seeds") > 0).groupBy("key").agg(F.first("seeds").alias("seeds")).select("key", F.explode("seeds").alias("s")).select("key", "s.*")
    shared = seeds.join(prints, "hash", "left_semi")
    reached = shared.select("key", "length", F.explode(_windows(F.col("words"), F.col("length"), F.col("first"))).alias("w")).select(
        "key", "length", "w.first", "w.window").distinct()

    # which items hold a window; windows of the same items share one set
    held = item.select("item", F.explode(_windows(F.col("words"), F.col("length"))).alias("w")).groupBy("w.window").agg(
        F.sort_array(F.collect_set("item")).alias("items")).withColumn("set", F.unhex(F.substring(F.sha2(F.to_json("items"), 256), 1, 32)))
    held = store(held)
    hits = reached.join(held.select("window", "set"), "window").select("key", "first", (F.col("first") + F.col("length")).alias("end"), "set")

    covered = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")))["n"]
    texts = store(hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"), F.sort_array(F.collect_set("set")).alias("sets")))
    # items are listed once for each combination of sets, however many texts have it
    named = texts.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(held.select("set", "items").dropDuplicates(["set"]), "set")
    named = named.groupBy("sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    texts = texts.join(named, "sets").select("key", covered.cast("bigint").alias("n_hit"), "items", "spans")
    return rows.drop("seeds").join(texts, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"))
