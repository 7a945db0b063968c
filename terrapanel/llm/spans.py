"""Places of regular-expression matches in texts, with Spark's own functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel.llm.common import let

BLOCK = 128


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def running_sums(lengths: Column) -> Column:
    """Running sums of an array of ints: within blocks, and over the blocks before."""
    def whole(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(blocks, lambda s: F.transform(s, lambda _, j: _total(F.slice(s, F.lit(1), j))))
        return let(before, lambda p: F.transform(a, lambda _, i: p[F.floor(i / BLOCK).cast("int")] + _total(
            F.slice(a, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))

    return let(lengths, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.array().cast("array<int>")))


def find_all(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, value, before), in code points, end exclusive.

    `before` holds up to so many characters in front of the match, back to the
    match before it. With `after`, a further field of that name holds up to so
    many characters behind the match, as far as the next one. The text between matches is taken with them, from the end
    of the last one on, so a text is gone through once for each of two
    extractions and never again from the middle.
    """
    gaps = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)(?:{pattern})"), F.lit(1))
    gaps = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), (F.right(g, F.lit(before)) if before else F.lit("")).alias("before"),
                                            *([F.left(g, F.lit(after)).alias("head")] if after else [])))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(g: Column, h: Column) -> Column:
        both = F.zip_with(g, h, lambda x, y: x["n"] + F.length(y))
        return let(running_sums(both), lambda ends: F.transform(h, lambda v, i: F.struct(
            (ends[i] - F.length(v)).alias("start"), ends[i].alias("end"), v.alias("value"), g[i]["before"].alias("before"),
            *([F.when(i + 1 < F.size(g), g[i + 1]["head"]).otherwise(F.substring(text, ends[i] + 1, F.lit(after))).alias("after")] if after else []))))

    # most texts hold no match and need no second extraction
    none = lambda h: F.transform(h, lambda v: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), v.alias("value"), v.alias("before"),
                                                       *([v.alias("after")] if after else [])))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(gaps, lambda g: placed(g, h))).otherwise(none(h)))


def only_where(condition: Column, found: Callable[[], Column]) -> Column:
    """`found()` where `condition` holds, else an empty array: for conditions that are cheap to test."""
    out = found()
    return F.when(condition, out).otherwise(F.slice(F.array(F.lit(None)), F.lit(1), F.lit(0)).cast("array<struct<start: int, end: int, value: string, before: string>>"))


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of an array with fields start, kind (a number) and end, in that order, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
