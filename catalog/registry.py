"""Register a Spark query together with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrapanel.session import mark_settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _round(name: str, digits: int) -> str:
    """SQL text rounding half away from zero in binary arithmetic.

    Spark's `round` works on the decimal text of a double; the SQL side rounds
    the scaled binary value. They differ where the text ends in an exact 5.
    """
    c, one = f"CAST({name} AS DOUBLE)", f"1e{digits}"
    y = f"(abs({c}) * {one})"
    up = f"(floor({y}) + CASE WHEN {y} - floor({y}) >= 5e-1 THEN 1e0 ELSE 0e0 END)"
    return f"CASE WHEN {y} < 4e15 THEN signum({c}) * {up} / {one} + 0e0 ELSE {c} END"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles and widen integers so results compare across engines."""
    out = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            name = _round(name, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            name = f"CAST({name} AS BIGINT)"
        out.append(f"{name} AS `{f.name}`")
    return df.selectExpr(*out)


def query(name: str, sql: str | None = None, real: str = "", ints: str = "", digits: int = 6):
    """Decorator. `real` names the floating-point columns, `ints` the integer
    columns of the SQL, which are rounded / widened as on the Spark side."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: rounded(fn(Tables(spark, sf)), digits)
        if sql is not None:
            swaps = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in real.split()]
            swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            text = sql.strip().rstrip(";")
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{text}\n) AS result" if swaps else text
        return fn

    return register


class Tables:
    """Lazy access to the supplied tables: `t.orders`, `t.lineitem`, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.seen = spark, sf_dir, {}

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        if table not in self.seen:
            self.seen[table] = mark_settled(self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet"))
        return self.seen[table]
