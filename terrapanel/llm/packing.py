"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Whatever the corpus holds, a piece's length is one of `capacity` numbers. The
packing is therefore planned on the histogram of lengths, at most `capacity`
counts, and the plan is a list of runs: pieces number f to t of one length go to
the bins from b on, k to a bin, from an offset on. Spark counts the lengths,
numbers the pieces within each length and looks every piece's run up. The plan's
size follows the number of distinct lengths, not the number of documents.

Plan: pieces above a third of the capacity fit at most twice in a bin; the
largest is matched with the largest that still fits beside it. Smaller pieces,
largest first, go to the bin with the smallest gap that takes them.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from terrapanel.llm.byte_bpe import byte_characters
from terrapanel.llm.common import Recent, map_arrow, slices, store, text_or_empty

CACHE = 200_000  # words a worker remembers, twice as many at most; any number gives the same ids
RUNS_BROADCAST = 200_000  # a plan of at most so many runs (about 10 MB) is broadcast, a longer one is joined by shuffle

PLAN_SCHEMA = "length int, first long, last long, each long, bin long, at long"


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(runs, number of bins) for so many pieces of each length.

    A run (length, first, last, each, bin, at) puts pieces first..last-1 of its
    length into bins from `bin` on, `each` to a bin, one after the other from
    offset `at`.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    placed = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap: (first bin, bins, filled so far)
    order: list[int] = []  # gaps that have bins, ascending
    bins = 0

    def put(length: int, n: int, each: int, first_bin: int, at: int) -> None:
        runs.append((length, placed[length], placed[length] + n, each, first_bin, at))
        placed[length] += n

    def free(first_bin: int, n: int, filled: int) -> None:
        gap = capacity - filled
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first_bin, n, filled))

    left = {length: n for length, n in counts.items() if n}
    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k >= 0 and large[k] == a and left[a] == 1:
            k -= 1
        b = large[k] if k >= 0 else None
        if b is None:
            n, filled = left[a], a
            put(a, n, 1, bins, 0)
            left[a] = 0
        elif b == a:
            n, filled = left[a] // 2, 2 * a
            put(a, 2 * n, 2, bins, 0)
            left[a] -= 2 * n
        else:
            n, filled = min(left[a], left[b]), a + b
            put(a, n, 1, bins, 0)
            put(b, n, 1, bins, a)
            left[a] -= n
            left[b] -= n
            if not left[b]:
                del large[k]
        free(bins, n, filled)
        bins += n
        if not left[a]:
            large.remove(a)

    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect.bisect_left(order, s)
            if k == len(order):
                each = capacity // s
                full, rest = divmod(n, each)
                if full:
                    put(s, full * each, each, bins, 0)
                    free(bins, full, each * s)
                if rest:
                    put(s, rest, rest, bins + full, 0)
                    free(bins + full, 1, rest * s)
                bins += full + (rest > 0)
                break
            gap = order[k]
            first_bin, have, filled = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            each = min(gap // s, n)
            full = min(have, n // each)
            put(s, full * each, each, first_bin, filled)
            free(first_bin, full, filled + each * s)
            free(first_bin + full, have - full, filled)
            n -= full * each
    return runs, bins


# the normaliser and splitter that `_Words` takes apart itself, as a tokenizer file states them; fixed values
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# the same split for texts of these characters, which normalisation only turns to lower case
_PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
_PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class _Words(Recent):
    """Packed ids of words, filled as they are met.

    A word of plain characters is split here and each new part, remembered as a
    word too, given to the model, where the tokenizer file has the splitter
    above; other words, and all words of other tokenizers, are encoded as they are.
    """

    def __init__(self, path: str):
        super().__init__(self.word, CACHE)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their spelling in a text is ordinary text
        stated = json.loads(self.tokenizer.to_str())
        steps = (stated["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = (stated["normalizer"] == _NORMALIZER and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("invert") is True
                      and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"])

    def part(self, text: str) -> bytes:
        spelled = text if text.isascii() else "".join(map(byte_characters().__getitem__, text.encode()))
        ids = [x.id for x in self.tokenizer.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        if self.plain and _PLAIN.fullmatch(word):
            parts = _PLAIN_SPLIT.findall(word.lower())
            return self.part(word) if parts == [word] else b"".join(map(self.__getitem__, parts))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts, packed little-endian unsigned 32-bit, for a tokenizer that splits at white space.

    Its ids of a text are those of the parts between spaces and line feeds, one
    after the other, so each distinct part is tokenised once.
    """
    known = _words(path).__getitem__
    return [b"".join(map(known, text.replace("\n", " ").split(" "))) for text in texts]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for batch in batches:
        for part in slices(batch, 1):
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(encode_words(part.column(1).to_pylist(), path)):
                ids += end
                for k, b in enumerate(range(0, len(ids), step)):
                    own = ids[b:b + step]
                    row.append(r)
                    piece.append(k)
                    start.append(b // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int32()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: each document's ids and `end_id`, cut only where longer than `capacity`."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())])
    return map_arrow(own, partial(_pieces, path=tokenizer_path, capacity=capacity, end_id=end_id), schema)


def assign_bins(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """`pieces` (stored; with a column `length` of 1 to `capacity`) with sequence_id and offset.

    Pieces of one length are numbered in `order` within salted groups, whose
    counts, one row for each length and salt, give each group's first number.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_bins(counts, capacity)
    plan = spark.createDataFrame(runs, PLAN_SCHEMA)
    if len(runs) <= RUNS_BROADCAST:
        plan = F.broadcast(plan)
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    number = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1
    numbered = salted.withColumn("__n", number).join(firsts, ["length", "__salt"]).withColumn("__n", F.col("__n") + F.col("__first"))
    plan = plan.withColumnRenamed("length", "__length")
    out = numbered.join(plan, (F.col("length") == F.col("__length")) & (F.col("__n") >= F.col("first")) & (F.col("__n") < F.col("last")))
    nth = F.col("__n") - F.col("first")
    return out.select(
        *pieces.columns, (F.col("bin") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with `end_id`, so an empty or NULL text is a piece of
    one token. Repeated rows are packed as often as they occur. Other columns
    are not read; an empty table gives no rows.
    """
    pieces = store(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    packed = assign_bins(pieces, capacity, ["id", "piece", "ids_crc32"])
    return packed.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"),
                         "ids_crc32", "sequence_id", "offset")
