"""Order-dependent operators that hold up when one group has most of the rows.

A Spark window puts each group in one task. Here a large group is cut into
pieces along its order: a piece is a pure function of the row, made of literal
boundaries, so no row is placed by sampling and any task can be run again.
Windows work inside (group, piece); a small table with one row for each piece
of a large group supplies what lies before it. Groups that fit one piece need
no offsets and stay whole.

Rows that are the outcome of a plan are stored first (`settled`): it is run once
however many ordered steps follow each other, and sums of doubles cannot differ
between the passes. Rows that come from storage are read where they are.

One aggregation over the rows finds the boundaries (approximate quantiles of
each ordering column, encoded as doubles) and the large groups (frequent
items). A value that takes a boundary's share of the rows or more is a piece of
its own, cut further by the next ordering column, so equal values and NULLs can
be spread as well. Numbers, dates, times, booleans and texts (by their first 24
bytes) can be cut; a group ordered by another type first stays whole. Boundaries that are off by a little only make pieces uneven.

`order` must be total: end it with columns that identify a row. NULL comes last
in both directions. The caller's row travels as one struct, so its column names
cannot clash with names used here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.session import settled, spread

_INF = float("inf")
_GROUP_PIECE = ("g", "piece")


class Order(NamedTuple):
    """An ordering column; NULL comes last in both directions."""

    col: str
    descending: bool = False

    def sort(self) -> Column:
        c = F.col(f"`{self.col}`")
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def up(col: str) -> Order:
    return Order(col)


def down(col: str) -> Order:
    return Order(col, True)


def _levels(name: str, kind: T.DataType, descending: bool) -> tuple[list[Column], bool]:
    """Doubles whose order, one after the other, is that of the column; whether equal doubles mean equal values."""
    c, exact = F.col(name), True
    if isinstance(kind, T.TimestampType):
        c, kind = F.unix_micros(c), T.LongType()
    if isinstance(kind, T.LongType):
        out = [F.shiftright(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))]
    elif isinstance(kind, T.DateType):
        out = [F.unix_date(c)]
    elif isinstance(kind, T.BooleanType):
        out = [c.cast("int")]
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        out = [c]
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = [F.when(F.isnan(c), F.lit(_INF)).otherwise(c)]  # the boundaries are finite, so this level never ends at it
    elif isinstance(kind, T.DecimalType):
        out, exact = [c], False
    elif isinstance(kind, T.StringType):
        out, exact = [F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1 + 6 * k, 6)), 12, "0"), 16, 10) for k in range(4)], False
    else:
        return [], False
    doubles = [x.cast("double") for x in out]
    return [-x if descending else x for x in doubles], exact


def _below(v: float) -> float:
    """A boundary a little under a value that was seen, so that sums which differ in their last bits from one
    evaluation of a plan to the next stay on one side of it."""
    return v - (abs(v) * 1e-9 + 1e-12)


class _Placed(NamedTuple):
    """Rows as columns row, g (group), o0.. (ordering columns), s0.. (carried values) and piece.

    A piece holds `large` (it belongs to a large group), `major` (the part that the
    first ordering column decides), `solid` (all rows of one major have the same
    value in that column) and the codes in order. `cut` says whether any group is large.
    """

    rows: DataFrame
    order: list[Column]
    cut: bool

    def dealt(self) -> DataFrame:
        """The rows with each piece in one task, pieces of large groups over all tasks, however well they compress."""
        return spread(self.rows, *_GROUP_PIECE) if self.cut else self.rows

    def window(self, by: int | None = None) -> WindowSpec:
        return Window.partitionBy(*_GROUP_PIECE).orderBy(*self.order[:by])


def _place(df: DataFrame, group: Sequence[Column], order: Sequence[Order], carried: Sequence[Column] = ()) -> _Placed:
    """Cut large groups into pieces along the order; see the module's text."""
    spark, df = df.sparkSession, settled(df)
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.struct(*[c.alias(f"g{k}") for k, c in enumerate(group)] or [F.lit(0).alias("g0")]).alias("g"),
        *[F.col(f"`{o.col}`").alias(f"o{k}") for k, o in enumerate(order)], *[c.alias(f"s{k}") for k, c in enumerate(carried)])
    sort = [Order(f"o{k}", o.descending).sort() for k, o in enumerate(order)]

    # a column is looked at only where values of the one before it are too many for a piece
    levels, cuts, heavy, often_null, first_exact, of_first, large = [], [], [], [], False, 0, None
    probs = F.array(*[F.lit(k / n) for k in range(1, n)])
    for k, o in enumerate(order):
        more, exact = _levels(f"o{k}", rows.schema[f"o{k}"].dataType, o.descending)
        names = [f"l{j}" for j in range(len(more))]
        groups = [F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {2 * n}, {16 * n})").alias("often")] if k == 0 else [F.count(F.lit(1)).alias("n")]
        seen = rows.select(F.xxhash64("g").alias("h"), *[c.alias(x) for c, x in zip(more, names)]).agg(
            *groups, *[F.percentile_approx(x, probs, 8 * n).alias(x) for x in names], *[F.count(x).alias(f"known_{x}") for x in names]).first()
        if k == 0:
            large = [x["item"] for x in seen["often"] or [] if x["count"] > seen["n"] / (2 * n)] if seen["n"] else []
            first_exact, of_first = exact, len(more)
        if not large or not more:
            break
        for c, x in zip(more, names):
            found = [v for v in seen[x] or [] if abs(v) != _INF]
            often = {a for a, b in zip(found, found[1:]) if a == b}
            levels.append(c)
            heavy.append(sorted(often))
            cuts.append(sorted(often | {_below(v) for v in found if v not in often}))
            often_null.append(seen["n"] - seen[f"known_{x}"] > seen["n"] / n)
        if not exact or not (heavy[-1] or often_null[-1]):
            break
    names, fields = [f"l{k}" for k in range(len(levels))], list(rows.columns)
    if not levels:
        no = F.lit(False)
        return _Placed(rows.withColumn("piece", F.struct(no.alias("large"), F.struct(F.lit(0).alias("p0")).alias("major"), no.alias("solid"))), sort, False)

    rows = rows.withColumns({x: c for c, x in zip(levels, names)}).withColumns({f"k{x}": F.coalesce(x, F.lit(0.0)) for x in names})
    cut = [k for k, c in enumerate(cuts) if c]
    if cut:
        rows = Bucketizer(splitsArray=[[-_INF, *cuts[k], _INF] for k in cut], inputCols=[f"kl{k}" for k in cut], outputCols=[f"b{k}" for k in cut]).transform(rows)
    codes, whole, within = [], [], F.col("large")
    for k, x in enumerate(names):
        bucket = F.col(f"b{k}").cast("int") if cuts[k] else F.lit(0)
        full = F.col(x).isin(heavy[k]) if heavy[k] else F.lit(False)
        code = F.when(F.col(x).isNull(), 2 * len(cuts[k]) + 2).when(full, 2 * bucket - 1).otherwise(2 * bucket)
        codes.append(F.when(within, code).otherwise(0).alias(f"p{k}"))
        whole.append(within)
        within = within & (F.col(x).isNull() | full)
    solid = (whole + [within])[of_first] if first_exact else F.col("large") & F.col("o0").isNull()
    rows = rows.withColumn("large", F.xxhash64("g").isin(large))
    piece = F.struct("large", F.struct(*codes[:of_first]).alias("major"), solid.alias("solid"), *codes[of_first:])
    return _Placed(rows.select(*fields, piece.alias("piece")), sort, True)


def _offsets(placed: _Placed, sums: int = 0, distinct: bool = False) -> DataFrame:
    """For each piece of a large group: rows and sums before it and in all the group, and the same for its major."""
    part = placed.rows.filter("piece.large")
    adds = [F.sum(f"s{k}").alias(f"t{k}") for k in range(sums)]
    if distinct:
        part = part.groupBy(*_GROUP_PIECE, "o0").agg(F.count(F.lit(1)).alias("c")).groupBy(*_GROUP_PIECE).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"))
    else:
        part = part.groupBy(*_GROUP_PIECE).agg(F.count(F.lit(1)).alias("c"), F.lit(0).cast("bigint").alias("d"), *adds)
    part = part.select("*", "piece.major", "piece.solid")
    # at most one row for each piece: bounded windows
    whole, major = Window.partitionBy("g"), Window.partitionBy("g", "major")
    prior = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("d", F.when(F.col("solid") & (F.row_number().over(major.orderBy("piece")) > 1), 0).otherwise(F.col("d")))
    out = {"before": F.coalesce(F.sum("c").over(prior), F.lit(0)), "all": F.sum("c").over(whole), "d_before": F.coalesce(F.sum("d").over(prior), F.lit(0))}
    for k in range(sums):
        out |= {f"b{k}": F.coalesce(F.sum(f"t{k}").over(prior), F.lit(0)), f"a{k}": F.sum(f"t{k}").over(whole)}
    part = part.withColumns(out).withColumns({
        "m_before": F.min("before").over(major), "m_all": F.sum("c").over(major), "m_d": F.min("d_before").over(major)})
    return part.select(*[F.col(k).alias(f"of_{k}") for k in _GROUP_PIECE], "before", "all", "d_before", "m_before", "m_all", "m_d",
                       *[f"{x}{k}" for k in range(sums) for x in "ba"])


def _with_offsets(placed: _Placed, rows: DataFrame, sums: int = 0, distinct: bool = False) -> DataFrame:
    """`rows` with the offsets of their pieces, NULL in groups that are not cut."""
    if not placed.cut:
        none = F.lit(None).cast("bigint")
        return rows.withColumns({c: none for c in ("before", "all", "d_before", "m_before", "m_all", "m_d")} | {
            f"{x}{k}": F.lit(None).cast("double") for k in range(sums) for x in "ba"})
    offsets = _offsets(placed, sums, distinct)
    return rows.join(offsets, (rows["g"] == offsets["of_g"]) & (rows["piece"] == offsets["of_piece"]), "left")


def _result(rows: DataFrame, names: Sequence[str], out: Mapping[str, Column]) -> DataFrame:
    """The caller's columns, those in `out` replaced or added."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in names if c not in out]
    return rows.select(*kept, *[c.alias(name) for name, c in out.items()])


def _groups(group: Sequence[str]) -> list[Column]:
    return [F.col(f"`{g}`") for g in group]


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Order], rn: str = "rn", n: str | None = "n") -> DataFrame:
    """`row_number()` and, unless `n` is None, group size for groups of any size (`group` may be empty)."""
    placed = _place(df, _groups(group), order)
    rows = placed.dealt().withColumns({"at": F.row_number().over(placed.window()), "in": F.count(F.lit(1)).over(Window.partitionBy(*_GROUP_PIECE))})
    rows = _with_offsets(placed, rows)
    out = {rn: (F.coalesce("before", F.lit(0)) + F.col("at")).cast("bigint")}
    return _result(rows, df.columns, out | ({n: F.coalesce("all", "in").cast("bigint")} if n else {}))


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Order], sums: Mapping[str, Column],
                 rn: str | None = None, totals: bool = True) -> DataFrame:
    """Running sum of each expression up to and including the row.

    Adds `<name>` and, with `totals`, `<name>_total` (the group's whole sum).
    """
    placed = _place(df, _groups(group), order, list(sums.values()))
    so_far, piece = placed.window().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*_GROUP_PIECE)
    local = {"at": F.row_number().over(placed.window())}
    for k in range(len(sums)):
        local |= {f"r{k}": F.sum(f"s{k}").over(so_far), f"w{k}": F.sum(f"s{k}").over(piece)}
    rows = _with_offsets(placed, placed.dealt().withColumns(local), len(sums))
    out = {rn: (F.coalesce("before", F.lit(0)) + F.col("at")).cast("bigint")} if rn else {}
    for k, name in enumerate(sums):
        out[name] = F.when(F.col(f"b{k}").isNull(), F.col(f"r{k}")).otherwise(F.col(f"b{k}") + F.col(f"r{k}"))
        if totals:
            out[f"{name}_total"] = F.when(F.col("all").isNull(), F.col(f"w{k}")).otherwise(F.col(f"a{k}"))
    return _result(rows, df.columns, out)


class Ranks(NamedTuple):
    """Places of a row within its group, as columns; NULL for rows left out."""

    rn: Column  # position, ties in the order of the ids
    rank: Column  # 1 + number of values before
    ties: Column  # rows that share the value
    n: Column  # ranked rows
    dense: Column  # 1 + number of distinct values before
    value: Column


def ranks(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], out: Mapping[str, Callable[[Ranks], Column]], *,
          descending: bool = False, keep_nulls: bool = False, dense: bool = False) -> DataFrame:
    """Tie-aware ranks of `value` within `group`, exact for groups of any size.

    `out` maps each new column to a function of the row's `Ranks`. NULL values
    are left out; with `keep_nulls` they rank last and count, as in SQL.
    `dense` has to be asked for, it costs one more aggregation.
    """
    parts = _groups(group) + ([] if keep_nulls else [F.col(f"`{value}`").isNotNull()])
    placed = _place(df, parts, [Order(value, descending), *[Order(i) for i in ids]])
    by_value = placed.window(1)
    rows = placed.dealt().withColumns({
        "at": F.row_number().over(placed.window()), "rank": F.rank().over(by_value),
        "run": F.count(F.lit(1)).over(by_value.rangeBetween(Window.currentRow, Window.currentRow)), "in": F.count(F.lit(1)).over(Window.partitionBy(*_GROUP_PIECE)),
        "dense": F.dense_rank().over(by_value) if dense else F.lit(0)})
    rows = _with_offsets(placed, rows, distinct=dense)
    before, zero = F.coalesce("before", F.lit(0)), F.lit(0)
    found = {
        "rn": before + F.col("at"), "rank": F.when(F.col("piece.solid"), F.col("m_before") + 1).otherwise(before + F.col("rank")),
        "ties": F.when(F.col("piece.solid"), F.col("m_all")).otherwise(F.col("run")), "n": F.coalesce("all", "in"),
        "dense": F.when(F.col("piece.solid"), F.col("m_d") + 1).otherwise(F.coalesce("d_before", zero) + F.col("dense"))}
    known = F.lit(True) if keep_nulls else F.col("o0").isNotNull()
    r = Ranks(**{k: F.when(known, c.cast("bigint")) for k, c in found.items()}, value=F.col("o0"))
    return _result(rows, df.columns, {name: make(r) for name, make in out.items()})


# Of each wanted place the share of rows on either side that is looked at, and the sketch's own error.
_BRACKET, _SKETCH = 6e-4, 10_000


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles (linear between order statistics), one row per group.

    `probs` maps output column to probability. NULLs are ignored; groups without
    a known value are absent. Approximate quantiles bracket every wanted place;
    rows inside a bracket are counted by value, all others only by the region
    between brackets they lie in, before anything is shuffled. A bracket that
    should miss its place stops the job.
    """
    return _quantiles(df.select(F.struct(*[F.col(f"`{g}`").alias(f"g{k}") for k, g in enumerate(group)] or [F.lit(0).alias("g0")]).alias("g"),
                                F.col(f"`{value}`").cast("double").alias("v")), probs).select(
        *[F.col(f"g.g{k}").alias(g) for k, g in enumerate(group)], *probs)


def region_counts(rows: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """For each group `g`, region between brackets `r` and, within brackets, value `w`: the number of rows `c`."""
    known = rows.filter("v IS NOT NULL")
    low = [p - _BRACKET for p in probs.values()]
    high = [p + _BRACKET for p in probs.values()]
    inner = sorted({p for p in low + high if 0 < p < 1})
    bounds = known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*[F.lit(p) for p in inner]), _SKETCH).alias("q"))
    # in a small group a bracket holds fewer rows than a place and its neighbours: count every value
    small = F.col("n") <= 4 / _BRACKET

    def bound(p: float, end: float) -> Column:
        return F.when(small, F.lit(end)).otherwise(F.col("q")[inner.index(p)]) if p in inner else F.lit(end)

    bounds = bounds.select(F.col("g").alias("of"), F.array(*[bound(p, -_INF) for p in low]).alias("lows"), F.array(*[bound(p, _INF) for p in high]).alias("highs"))
    both = known.join(bounds, known["g"] == bounds["of"])
    k = range(len(low))
    region = reduce(lambda a, b: a + b, [(F.col("v") >= F.col("lows")[i]).cast("int") + (F.col("v") > F.col("highs")[i]).cast("int") for i in k])
    inside = reduce(lambda a, b: a | b, [F.col("v").between(F.col("lows")[i], F.col("highs")[i]) for i in k])
    return both.select("g", region.alias("r"), F.when(inside, F.col("v")).alias("w")).groupBy("g", "r", "w").agg(F.count(F.lit(1)).alias("c"))


def _quantiles(rows: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    so_far = Window.partitionBy("g").orderBy("r", "w")
    upto = region_counts(rows, probs).withColumns({"upto": F.sum("c").over(so_far.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy("g"))})
    # rounded, so that a place that is a whole number stays one in binary arithmetic
    at = {name: F.round((F.col("n") - 1) * F.lit(float(p)), 9) for name, p in probs.items()}

    def holds(k: Column) -> Column:
        return (F.col("upto") - F.col("c") <= k) & (k < F.col("upto"))

    parts = []
    for name, p in at.items():
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        for end, k in (("lo", F.floor(p)), ("hi", F.ceil(p))):
            parts.append(F.max(F.when(holds(k), F.coalesce(F.col("w"), missed))).alias(f"{end}_{name}"))
        parts.append(F.max(p - F.floor(p)).alias(f"f_{name}"))
    return upto.groupBy("g").agg(*parts).select("g", *[
        (F.col(f"lo_{m}") + (F.col(f"hi_{m}") - F.col(f"lo_{m}")) * F.col(f"f_{m}")).alias(m) for m in probs])


def column_quantiles(df: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of several columns in one pass; `wanted` is {out: (column, p)}.

    Columns are stacked as groups of their own, so one count serves all of them.
    """
    cols = sorted({c for c, _ in wanted.values()})
    probs = {f"p{i}": p for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    name_of = {p: k for k, p in probs.items()}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(cols)])).alias("x")
    keys = [f"g{k}" for k in range(len(group))]
    long = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys)], cells).select(F.struct(*keys, F.col("x.m").alias("m")).alias("g"), F.col("x.v").alias("v"))
    q = _quantiles(long, probs)
    picks = [F.max(F.when(F.col("g.m") == cols.index(c), F.col(name_of[p]))).alias(out) for out, (c, p) in wanted.items()]
    place = [F.col(f"g.{k}").alias(g) for k, g in zip(keys, group)]
    return q.groupBy(*place).agg(*picks) if group else q.agg(*picks)
