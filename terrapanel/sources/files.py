"""Reading delimited files with explicit schemas, and writing tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(name: str) -> str:
    """Lower-case words joined by underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower())).strip("_")


def read_csv_clean(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV with cleaned headers. Without a schema every column stays text, so
    identifiers keep their leading zeros and nothing is scanned twice."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[clean_name(c) for c in df.columns])


def read_delim(spark: SparkSession, path: str, sep: str = "|", schema: T.StructType | None = None) -> DataFrame:
    """Delimited code table."""
    return read_csv_clean(spark, path, schema, sep)


def read_dated_files(spark: SparkSession, glob: str, pattern: str, schema: T.StructType | str, parts: Mapping[str, int],
                     sep: str = ",") -> DataFrame:
    """Many files in one scan; groups of `pattern` in the file's path become integer columns."""
    df = spark.read.option("header", True).option("sep", sep).schema(schema).csv(glob)
    return df.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), pattern, g).try_cast("int").alias(c) for c, g in parts.items()])


def number(c: Column | str) -> Column:
    """Number from text such as '$1,234.50' or '(7)'; NULL when there is none."""
    x = F.col(c) if isinstance(c, str) else c
    negative = F.trim(x).rlike(r"^\(.*\)$")
    n = F.regexp_replace(x, r"[$,%()\s]", "").try_cast("double")
    return F.when(negative, -n).otherwise(n)


def read_with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]], casts: Mapping[str, str] | None = None) -> DataFrame:
    """Pick each target from the first source column that exists and is filled.

    `casts` gives 'number', 'integer' or 'text' (default; trimmed, blank as NULL).
    """
    casts = casts or {}
    have = {c.lower(): c for c in df.columns}
    out = []
    for target, names in aliases.items():
        found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
        kind = casts.get(target, "text")
        texts = [F.nullif(F.trim(c.cast("string")), F.lit("")) for c in found]
        c = F.coalesce(*texts) if texts else F.lit(None).cast("string")
        if kind == "number":
            c = number(c)
        elif kind == "integer":
            c = number(c).cast("bigint")
        out.append(c.alias(target))
    return df.select(*out)


def split_by_level(df: DataFrame, level: str, keep: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One frame per level with the columns that make sense there."""
    return {lv: df.filter(F.col(level) == lv).select(*cols) for lv, cols in keep.items()}


def dim_from_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small dimension written out in code."""
    return spark.createDataFrame(list(rows), schema)


def with_build_metadata(df: DataFrame, **kv: str) -> DataFrame:
    """Build labels as columns; pass `run_timestamp` so that reruns agree."""
    return df.withColumns({k: F.lit(v) for k, v in kv.items()})


def table(spark: SparkSession, root: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Warehouse table: layer.name under a root folder.

    Pass a schema when a partition column holds identifiers with leading zeros
    and the session infers partition types (`build_session` turns that off).
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/{name.replace('.', '/')}")


def publish(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Replace a warehouse table as a whole."""
    path = f"{root}/{name.replace('.', '/')}"
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)
    return path


def replace_partition(df: DataFrame, root: str, name: str, key: str) -> str:
    """Replace only the partitions of `key` present in `df`, keep the others."""
    path = f"{root}/{name.replace('.', '/')}"
    # rebalancing keeps the number of files per key small and still splits a
    # key that is too large for one writer
    df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return path


def write_levels(df: DataFrame, root: str, name: str, level: str = "geo_level") -> str:
    """All levels in one write, each in its own partition folder."""
    return publish(df, root, name, [level])
