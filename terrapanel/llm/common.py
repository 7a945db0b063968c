"""Small helpers that several of the operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.sieve import sieve
from terrapanel.session import store


_shipped: set[str] = set()
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application.

    Workers go through texts in slices of SLICE bytes, so Arrow batches need not be
    much larger; Spark's default of 64 MB is in memory several times for each core.
    A limit that the caller has set stays.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="terrapanel-")) / "terrapanel.zip"  # Spark's file server hands it out
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """`df.mapInArrow`, for functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_or_empty(col: str) -> Column:
    """The text as a string, NULL as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once for each row, also where `body` names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def same(left: str, right: str) -> Column:
    """Equality that also pairs NULL with NULL."""
    return F.col(left).eqNullSafe(F.col(right))


def packed(df: DataFrame, *cols: Column) -> DataFrame:
    """Each row as one struct `__row` beside `cols`, so that no name can clash with the row's own."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"), *cols)


def text_key(col: str) -> Column:
    """128 bits of the whole text's SHA-256; NULL counts as empty."""
    return F.unhex(F.substring(F.sha2(text_or_empty(f"`{col}`"), 256), 1, 32))


def keep_decided(docs: DataFrame, id_col: str, text_col: str, decided: DataFrame) -> DataFrame:
    """The rows of `docs` that `decided` (id, key, kept; a row for each of them) keeps.

    Rows are found by id and text. Of rows that repeat both, as many stay as
    were kept, one at most; they differ in nothing that was compared.
    """
    gone = store(decided.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(
        F.min("kept").alias("__all"), F.max("kept").alias("__one")).filter("NOT __all").select("__id", "__key", "__one", F.xxhash64("__key").alias("__hash")))
    rows = packed(docs, docs[f"`{id_col}`"].alias("__doc"), text_key(text_col).alias("__own"))
    # only rows whose text may have lost a row are shuffled
    test = sieve(gone, "__hash", in_lambdas=False)(F.xxhash64("__own"))
    near = rows.filter(test).join(gone, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    near = store(near.filter("__one IS NULL OR __one").select("__doc", "__own", "__row", "__one"))
    once = near.filter("__one").groupBy("__doc", "__own").agg(F.first("__row").alias("__row"))
    return rows.filter(~test).select("__row.*").unionByName(near.filter("__one IS NULL").select("__row.*")).unionByName(once.select("__row.*"))


class Recent(dict):
    """What `make` gives for each key, remembered for the keys used lately.

    It holds `most` of them and as many that were full before; of those, the
    ones that are used again stay. Frequent keys are kept and rare ones go.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        out = self.before.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = out
        return out


SLICE = 1_000_000  # bytes of text a worker handles at a time


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of `batch` with about SLICE bytes in column `text`; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        most = (size[at - 1] if at else 0) + SLICE
        end = max(at + 1, int(np.searchsorted(size, most, "right")))
        yield batch.slice(at, end - at)
        at = end


__all__ = ["Recent", "keep_decided", "let", "map_arrow", "packed", "same", "ship", "sieve", "slices", "store", "text_key", "text_or_empty"]
