"""Profiles, contracts and validation results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.nulls import finite
from terrapanel.operators.joins import coverage_full
from terrapanel.operators.ordered import down, up
from terrapanel.operators.ranking import top_k_per_group

_NUM = (T.IntegerType, T.LongType, T.ShortType, T.DoubleType, T.FloatType, T.DecimalType)


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: rows, NULLs, distinct values, min / max or text lengths.

    Values are stacked as text once; counts and bounds come from one grouped
    aggregation and distinct values from a second grouping by value, so no
    task holds the set of values of a column.
    """
    stacked = _stacked(df, cols)
    per_value = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    is_num = F.col("column_name").isin([c for c in cols if isinstance(df.schema[c].dataType, _NUM)] or [""])
    as_num = F.when(is_num, F.col("value").try_cast("double"))
    out = per_value.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min(as_num).alias("min_value"), F.max(as_num).alias("max_value"),
        F.min(F.when(~is_num, F.length("value"))).cast("bigint").alias("min_length"),
        F.max(F.when(~is_num, F.length("value"))).cast("bigint").alias("max_length"))
    return out.withColumn("null_pct", F.col("null_count") * 100.0 / F.col("row_count"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent known values of each column."""
    counts = _stacked(df, cols).filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, ["column_name"], [down("n"), up("value")], k, "value_rank")


def _stacked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot([], list(cols), "column_name", "value")


def key_stats(df: DataFrame, combos: Sequence[Sequence[str]]) -> DataFrame:
    """For each candidate key: rows, distinct keys, duplicate rows, whether it is a key."""
    parts = []
    for cols in combos:
        per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        parts.append(per.agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("distinct_keys"),
                             F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_key_rows")).select(
            F.lit(" + ".join(cols)).alias("key_columns"), "row_count", "distinct_keys",
            (F.col("row_count") - F.col("distinct_keys")).alias("duplicate_rows"), "null_key_rows",
            ((F.col("row_count") == F.col("distinct_keys")) & (F.col("null_key_rows") == 0)).alias("is_key")))
    return reduce(DataFrame.unionByName, parts)


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows left after each cumulative gate, in one aggregation."""
    total, aggs, cond = [F.count(F.lit(1)).alias("s0")], [], F.lit(True)
    for i, c in enumerate(steps.values(), 1):
        cond = cond & c
        aggs.append(F.count(F.when(cond, 1)).alias(f"s{i}"))
    wide = df.agg(*total, *aggs)
    names = ["All rows", *steps]
    cells = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step_order"), F.lit(n).alias("step"),
                               F.col(f"s{i}").alias("rows_remaining")) for i, n in enumerate(names)])
    return wide.select(F.explode(cells).alias("f")).select("f.*")


def null_rates(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Share of NULLs per column, long."""
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]
    wide = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
    return wide.unpivot(list(group), list(cols), "column_name", "null_rate")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and duplicate rows of one key."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_keys")).withColumn(
        "duplicate_rows", F.col("row_count") - F.col("distinct_keys")).withColumn("pass", F.col("duplicate_rows") == 0)


def contract_check(df: DataFrame, required: Sequence[str], optional: Sequence[str] = (), numeric: Sequence[str] = (),
                   single: Sequence[str] = ()) -> DataFrame:
    """One row per check: required columns, rows, single-valued columns, finite numbers."""
    missing = [c for c in required if c not in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    # two distinct values are enough to fail, so min and max decide
    aggs += [F.coalesce(F.min(F.col(c)) == F.max(F.col(c)), F.lit(False)).alias(f"one_{c}") for c in single if c in df.columns]
    aggs += [F.count(F.when(~finite(F.col(c).try_cast("double")), 1)).alias(f"bad_{c}") for c in numeric if c in df.columns]
    wide = df.agg(*aggs)
    cells = [_check("required_columns", F.lit(float(len(missing))), F.lit(not missing), ", ".join(missing)),
             _check("optional_columns_present", F.lit(float(len([c for c in optional if c in df.columns]))), F.lit(True), ""),
             _check("non_empty", F.col("rows").cast("double"), F.col("rows") > 0, "")]
    cells += [_check(f"single_{c}", F.when(F.col(f"one_{c}"), 0.0).otherwise(1.0), F.col(f"one_{c}"), "")
              for c in single if c in df.columns]
    cells += [_check(f"finite_{c}", F.col(f"bad_{c}").cast("double"), F.col(f"bad_{c}") == 0, "")
              for c in numeric if c in df.columns]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _check(name: str, value: Column, ok: Column, details: str) -> Column:
    return F.struct(F.lit(name).alias("check_name"), value.alias("metric_value"), ok.alias("pass"), F.lit(details).alias("details"))


def pattern_check(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Rows whose value is NULL or does not match the pattern, per column."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(F.when(~F.coalesce(F.col(c).rlike(rx), F.lit(False)), 1)).alias(f"b_{c}") for c, rx in cols.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), F.col(f"b_{c}").alias("bad_rows"),
                               (F.col(f"b_{c}") == 0).alias("pass")) for c in cols])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def component_sum_check(df: DataFrame, total: Column, parts: Sequence[Column], tol: float, group: Sequence[str] = ()) -> DataFrame:
    """Rows where the parts do not add up to the total within `tol`."""
    gap = F.abs(reduce(lambda a, b: a + b, parts) - total)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("row_count"), F.count(F.when(gap > tol, 1)).alias("bad_rows"),
                                  F.max(gap).alias("max_gap"))


def coverage_gap(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Column, names: tuple[str, str]) -> DataFrame:
    """Per group: keys in both tables, and in only one of them."""
    j = coverage_full(a, b, keys, names)
    ia, ib = F.col(f"in_{names[0]}"), F.col(f"in_{names[1]}")
    return j.groupBy(by.alias("coverage_group")).agg(
        F.count(F.when(ia & ib, 1)).alias("in_both"), F.count(F.when(ia & ~ib, 1)).alias(f"only_{names[0]}"),
        F.count(F.when(~ia & ib, 1)).alias(f"only_{names[1]}"))


def validation_row(df: DataFrame, name: str, severity: str, dataset: str, metric: Column, ok: Column, details: str) -> DataFrame:
    """One check as (check_name, severity, dataset, metric_value, pass, details)."""
    one = df.agg(metric.cast("double").alias("metric_value"))
    return one.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.lit(dataset).alias("dataset"),
                      "metric_value", ok.alias("pass"),
                      F.concat(F.lit(details + ": "), F.col("metric_value").cast("bigint").cast("string")).alias("details"))


def validation_rows(df: DataFrame, checks: Sequence[tuple[str, str, str, Column, Column, str]]) -> list[DataFrame]:
    """Several checks (name, severity, dataset, metric, ok, details) of one frame in one pass, as a list of one frame."""
    one = df.agg(*[metric.cast("double").alias(f"m{k}") for k, (*_, metric, _ok, _d) in enumerate(checks)])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.lit(dataset).alias("dataset"), F.col(f"m{k}").alias("metric_value"), F.lit(details).alias("d"))
        for k, (name, severity, dataset, _m, _ok, details) in enumerate(checks)])).alias("r")).select("r.*")
    ok = reduce(lambda rest, c: F.when(F.col("check_name") == c[0], c[4]).otherwise(rest), checks, F.lit(None).cast("boolean"))
    return [rows.select("check_name", "severity", "dataset", "metric_value", ok.alias("pass"),
                        F.concat("d", F.lit(": "), F.col("metric_value").cast("bigint").cast("string")).alias("details"))]


def validation_suite(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def table_agreement(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Row and key counts per table, and keys missing from the first table."""
    names = list(tables)
    base = tables[names[0]].select(*keys).distinct()
    parts = []
    for n in names:
        per = tables[n].groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        j = per.join(base.withColumn("__in", F.lit(1)), list(keys), "left")
        parts.append(j.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_keys"),
                           F.count(F.when(F.col("__in").isNull(), 1)).alias("keys_not_in_base")).select(
            F.lit(n).alias("table_name"), "row_count", "distinct_keys", "keys_not_in_base"))
    return reduce(DataFrame.unionByName, parts)


def assignment_rate(df: DataFrame, assigned: Column, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.when(assigned, 1)).alias("assigned_rows"),
        F.avg(F.when(assigned, 1.0).otherwise(0.0)).alias("assignment_rate"))
