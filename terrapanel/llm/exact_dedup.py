"""Exact duplicates by merging sorted digest runs in a tree.

Every input partition makes one run: its distinct digests with the row to keep
and a count. Runs then meet in binomial rounds: round k joins `fan_in` groups
of runs to one group, in which as many partitions as it has runs hold one range
of digests each. So a partition hands `fan_in` - 1 of `fan_in` parts of its range
to its partners, gets theirs for the part that it keeps, and after
log(partitions) rounds the one run that is left lies in order over all
partitions. Each partition is sorted by digest and merged in one ordered pass.
Ranges are fixed shares of the digests' space, which hashes fill evenly; nothing
is sampled.

A merge keeps one row for each digest at every level, so a text with any number
of copies costs at most one entry for each run, and the answer goes back to the
rows over the same entries: no task ever meets all copies of a text.

Two texts count as equal when SHA-256, byte length and a second 64-bit hash all
agree; the three are compared at every level. The texts themselves are not
compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import keep_decided, store, text_or_empty

_KEY = ["sha", "bytes", "check"]


def digest_rows(docs: DataFrame, id_col: str, text_col: str, text: Column | None = None) -> DataFrame:
    """One small stored row for each document: run (its partition), uid, id and the digest of the whole text."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), (text_or_empty(f"`{text_col}`") if text is None else text).alias("t"))
    return store(d.select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("uid"), "id",
        F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("bytes"), F.xxhash64("t").alias("check")))


def merge_runs(rows: DataFrame, keep: str = "smallest", fan_in: int = 8) -> tuple[DataFrame, DataFrame]:
    """(first runs, last run): for each digest the kept row (struct `keep`) and the number of rows `n`.

    `keep` names which id stays, "smallest" or "largest"; a NULL id stays only
    where its group has no other, and of rows with the same id the earliest.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    if keep == "largest":
        candidate, best = F.struct("id", (-F.col("uid")).alias("rank"), "uid"), F.max
    else:
        candidate, best = F.struct(F.col("id").isNull().alias("last"), "id", F.col("uid").alias("rank"), "uid"), F.min
    first = rows.groupBy("run", *_KEY).agg(best(candidate).alias("keep"), F.count(F.lit(1)).alias("n"))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level, width = first, 1
    while width < runs:
        width *= fan_in
        ranges = min(width, runs)
        level = (level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                 .withColumn("part", F.col("run") * ranges + _range(F.col("sha"), ranges))
                 .repartitionById(-(-runs // width) * ranges, F.col("part")).sortWithinPartitions("part", "run", *_KEY)
                 .groupBy("part", "run", *_KEY).agg(best("keep").alias("keep"), F.sum("n").alias("n")).drop("part"))
    return first, level


def _range(sha: Column, ranges: int) -> Column:
    """Which of `ranges` equal shares of all digests one belongs to, in digest order."""
    head = F.conv(F.substring(F.hex(sha), 1, 8), 16, 10).cast("bigint")
    return F.shiftright(head * F.lit(ranges).cast("bigint"), 32).cast("int")


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int) -> DataFrame:
    rows = digest_rows(docs, id_col, text_col)
    first, last = merge_runs(rows, keep, fan_in)
    back = first.select("run", *_KEY).join(last.select(*_KEY, F.col("keep").alias("best"), "n"), _KEY)
    return rows.join(back, ["run", *_KEY]).select("id", "sha", "n", F.col("best.id").alias("keep_id"), (F.col("uid") == F.col("best.uid")).alias("kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     fan_in: int = 8) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    A NULL text counts as empty, so all empty and NULL texts form one group.
    Exactly one row of each group has `kept`, also where rows repeat an id.
    Other columns of `docs` are not read. An empty table gives no rows.
    """
    return _decided(docs, id_col, text_col, keep, fan_in).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                          fan_in: int = 8) -> DataFrame:
    """`docs` with one row of each group of equal texts, all its columns unchanged."""
    decided = _decided(docs, id_col, text_col, keep, fan_in)
    return keep_decided(docs, id_col, text_col, decided.select("id", F.substring("sha", 1, 16).alias("key"), "kept"))
