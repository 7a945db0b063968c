"""Column expressions: keys, shares, concentration, labels, text, dates, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.nulls import as_col, ratio_or_null, sum0

# ---- geography keys -------------------------------------------------------


def pad_zeros(c: Column, width: int) -> Column:
    """Text filled with zeros on the left to `width`; longer text stays whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def geoid(*parts: Column | str, widths: Sequence[int]) -> Column:
    """Zero-padded parts joined into one identifier (state 2 + county 3 ...).

    A part longer than its width stays whole, so that it matches nothing rather
    than another place.
    """
    return F.concat(*[pad_zeros(as_col(p).cast("string"), w) for p, w in zip(parts, widths, strict=True)])


def normal_level(level: Column | str) -> Column:
    """Lower-case, trimmed level name; 'zip code' is the ZCTA level."""
    lv = F.lower(F.trim(as_col(level)))
    return F.when(lv == "zip code", F.lit("zcta")).otherwise(lv)


def normalize_geo_key(df: DataFrame, level: str = "geo_level", geo: str = "geo_id") -> DataFrame:
    """One spelling per place: '00000' is the nation, 'SS000' at state level is 'SS'."""
    nation = F.col(geo) == "00000"
    lv = F.when(nation, F.lit("us")).otherwise(normal_level(level))
    state5 = (normal_level(level) == "state") & (F.length(geo) == 5) & (F.substring(geo, 3, 3) == "000")
    gid = F.when(nation, F.lit("1")).when(state5, F.substring(geo, 1, 2)).otherwise(F.col(geo))
    return df.withColumns({level: lv, geo: gid})


def parent_key(c: Column | str, n: int) -> Column:
    """First `n` digits of an identifier after dropping everything else."""
    return F.substring(F.regexp_replace(as_col(c), "[^0-9]", ""), 1, n)


# ---- buckets, shares, concentration --------------------------------------


def bucket_columns(df: DataFrame, buckets: Mapping[str, Sequence[str]], null_as_zero: bool = False) -> DataFrame:
    """Add one column per bucket, the sum of its source columns."""
    fold = sum0 if null_as_zero else (lambda *cs: reduce(add, [as_col(c) for c in cs]))
    return df.withColumns({b: fold(*cols) for b, cols in buckets.items()})


def add_shares(df: DataFrame, cols: Sequence[str], total: str, prefix: str = "pct_") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": ratio_or_null(c, total) for c in cols})


def hhi(*shares: Column | str) -> Column:
    """Concentration: sum of squared shares."""
    return reduce(add, [as_col(s) * as_col(s) for s in shares])


def diversity(*shares: Column | str) -> Column:
    return F.lit(1.0) - hhi(*shares)


def residual(df: DataFrame, total: str, parts: Sequence[str], high: float = 1.05) -> DataFrame:
    """Sum of parts, what is left of the total, coverage ratio and its flag."""
    s = reduce(add, [as_col(p) for p in parts])
    out = df.withColumn("part_sum", s)
    out = out.withColumns({
        "residual": F.col(total) - F.col("part_sum"),
        "coverage_ratio": ratio_or_null("part_sum", total)})
    flag = F.when(F.col("coverage_ratio") > high, "over").when(F.col("coverage_ratio").isNotNull(), "ok")
    return out.withColumns({"pct_residual": ratio_or_null("residual", total), "coverage_flag": flag})


def age_bands(bands: Mapping[str, Sequence[str]], denom: str) -> dict[str, Column]:
    """Band totals and shares; a missing denominator falls back to the bands' sum."""
    totals = {b: sum0(*cols) for b, cols in bands.items()}
    base = F.when(F.col(denom) > 0, F.col(denom)).otherwise(reduce(add, totals.values()))
    out = dict(totals)
    out["band_denominator"] = base
    out |= {f"pct_{b}": F.when(base > 0, t / base) for b, t in totals.items()}
    return out


# ---- labels and flags -----------------------------------------------------


def classify(cases: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Label of the first case that holds."""
    chain = reduce(lambda w, c: w.when(c[0], F.lit(c[1])), cases[1:], F.when(cases[0][0], F.lit(cases[0][1])))
    return chain.otherwise(F.lit(default)) if default is not None else chain


def gate(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def with_gates(df: DataFrame, gates: Mapping[str, Column], all_of: str = "eligible") -> DataFrame:
    out = df.withColumns({g: gate(c) for g, c in gates.items()})
    return out.withColumn(all_of, gate(reduce(lambda a, b: a & b, [F.col(g) == 1 for g in gates])))


def reason_tags(tags: Mapping[str, Column], default: str, sep: str = " | ") -> Column:
    text = F.concat_ws(sep, *[F.when(cond, F.lit(label)) for label, cond in tags.items()])
    return F.when(text == "", F.lit(default)).otherwise(text)


# ---- scores ---------------------------------------------------------------


def weighted_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum; NULL if any term is NULL."""
    return reduce(add, [F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def reweighted_score(weights: Mapping[str, float], scale: float = 1.0) -> Column:
    """Weighted mean over the terms that are known; NULL if none is."""
    num = reduce(add, [F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()])
    den = reduce(add, [F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()])
    return F.when(den > 0, F.lit(float(scale)) * num / den)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    x = as_col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


# ---- text -----------------------------------------------------------------


def in_brackets(c: Column | str) -> Column:
    """Text inside the first square brackets, NULL when there are none."""
    return F.nullif(F.regexp_extract(as_col(c), r"\[([^\]]*)\]", 1), F.lit(""))


def in_parentheses(c: Column | str) -> Column:
    """Text inside the last parentheses, NULL when there are none."""
    return F.nullif(F.regexp_extract(as_col(c), r"\(([^()]*)\)[^()]*$", 1), F.lit(""))


def strip_apostrophe(c: Column | str) -> Column:
    """Drop the leading apostrophe spreadsheets use to keep text as text."""
    return F.regexp_replace(as_col(c), r"^'+", "")


def snake_case(c: Column | str) -> Column:
    words = F.regexp_replace(F.lower(as_col(c)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(words, r"^_+|_+$", "")


def text_key(c: Column | str) -> Column:
    """Letters and digits only, lower case: a join key for names."""
    return F.regexp_replace(F.lower(as_col(c)), r"[^a-z0-9]", "")


def state_of_title(c: Column | str) -> Column:
    """First state code after the comma in 'City-City, ST-ST'."""
    return F.nullif(F.regexp_extract(as_col(c), r",\s*([A-Z]{2})", 1), F.lit(""))


def scrub_utf8(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace malformed bytes in string columns."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.make_valid_utf8(F.col(c)) for c in cols})


# ---- dates ----------------------------------------------------------------


def month_start(year: Column | str, month: Column | str) -> Column:
    """First day of the month; NULL for an impossible month or missing year."""
    y, m = as_col(year).cast("int"), as_col(month).cast("int")
    return F.when(m.between(1, 12) & y.isNotNull(), F.make_date(y, m, F.lit(1)))


def days_since(date: Column | str, as_of: str) -> Column:
    """Days from `date` to the fixed date `as_of` (never the clock)."""
    return F.datediff(F.lit(as_of).cast("date"), as_col(date).cast("date")).cast("bigint")


def window_label(start: Column | str, end: Column | str) -> Column:
    return F.concat_ws("_to_", as_col(start).cast("string"), as_col(end).cast("string"))
