"""Long and wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_wide(df: DataFrame, keys: Sequence[str], name: str, values: Mapping[str, str], agg: Column) -> DataFrame:
    """One column per listed value ({value: column}); listing them saves a pass over the data."""
    wide = df.groupBy(*keys).pivot(name, list(values)).agg(agg)
    return wide.withColumnsRenamed({v: c for v, c in values.items()})


def longer(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "metric_key", value: str = "value") -> DataFrame:
    """Stack columns into (keys, name, value) rows in one scan."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), list(cols), name, value)


def metric_rows(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, tuple], fields: Sequence[str] = ("metric_label",),
                value: str = "metric_value") -> DataFrame:
    """Long rows with a descriptive record per metric.

    `metrics` maps column -> tuple of attributes named by `fields`. Attributes are
    looked up from a literal, so no join is needed.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric_id"), *[F.lit(a).alias(f) for f, a in zip(fields, attrs, strict=True)],
                 F.col(c).cast("double").alias(value)) for c, attrs in metrics.items()])
    return df.select(*keys, F.explode(cells).alias("__m")).select(*keys, "__m.*")
