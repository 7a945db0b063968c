"""Exact top-k inner products with Fagin's threshold algorithm, in blocks.

Rows are packed into blocks of at most `block_rows`. Within a block every
dimension has a list of the rows in order of its component. The lists are read
from both ends, some ranks deeper in each step; rows seen in any list are scored
in full. For a query the sum over dimensions of its component times the component
reached bounds every row not yet seen; reading stops once that bound is below
the k-th best score the task has met. The best k of every task are then ranked
for each query.

Blocks of rows and of queries meet on a grid: a task gets one group of rows and
one of queries, holds the queries and meets the rows block by block. Rows are
sent to each group of queries and queries to each group of rows, in the smallest
integers that hold them; nothing is joined, broadcast or brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.common import map_arrow, store

FIRST_DEPTH, DEEPER = 16, 4  # ranks read in the first step; how many times deeper each further step goes
AT_ONCE = 256  # queries scored by one product of matrices
HELD = 64_000_000  # bytes of queries and of their best rows that a task holds

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BLOCK = "part int, dim int, n int, ids binary, cells binary"


def _packed(cells: np.ndarray) -> bytes:
    """The components in the smallest integers that hold them and their negatives."""
    most = _largest(cells)
    return cells.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8").tobytes()


def _unpacked(cells: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(cells, f"<i{len(cells) // (n * dim)}").reshape(n, dim)


def _largest(cells: np.ndarray) -> int:
    return max(int(cells.max(initial=0)), -int(cells.min(initial=0)))


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, components) as blocks of one dimension and at most `most` rows; `part` counts from the task's partition."""
    part = TaskContext.get().partitionId()
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def blocks(dim: int, least: int) -> Iterator[pa.RecordBatch]:
        """Full blocks of what is held; the rest, if it has `least` rows, too."""
        nonlocal part
        ids, cells = (np.concatenate(x) for x in zip(*held.pop(dim)))
        at = 0
        while len(ids) - at >= least:
            i, c = ids[at:at + most], cells[at:at + most]
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([len(i)], pa.int32()),
                pa.array([i.tobytes()], pa.binary()), pa.array([_packed(c)], pa.binary())], ["part", "dim", "n", "ids", "cells"])
            part, at = part + 1, at + most
        if at < len(ids):
            held[dim] = [(ids[at:], cells[at:])]

    for batch in batches:
        ids = batch.column(0).to_numpy().astype("<i8")
        dims = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
        flat, starts = batch.column(1).flatten().to_numpy(), np.cumsum(dims) - dims
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            held.setdefault(dim, []).append((ids[own], flat[starts[own][:, None] + np.arange(dim)]))
            if sum(len(x) for x, _ in held[dim]) >= most:
                yield from blocks(dim, most)
    for dim in list(held):
        yield from blocks(dim, 1)


class Best:
    """Queries of one dimension, each with the best k rows it has met, best first; equal scores by smaller id."""

    def __init__(self, own: np.ndarray, cells: np.ndarray, k: int):
        self.own, self.cells, self.k = own, cells, k  # own: the queries' ids
        self.met = np.zeros(len(own), np.int64)  # rows held, k at most
        self.score, self.ids = np.full((len(own), k), _LEAST), np.full((len(own), k), _MOST)

    def least(self, at: np.ndarray, first_id: int) -> np.ndarray:
        """The score from which a row is among the best of queries `at`, if no row has an id below `first_id`."""
        kth, worst = self.score[at, -1], self.ids[at, -1]
        return np.where(self.met[at] < self.k, _LEAST, kth + ((worst <= first_id) & (kth < _MOST)))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows that queries `at` have met, a row for each."""
        old = np.unique(at)
        there = np.arange(self.k) < self.met[old][:, None]
        at = np.concatenate([np.repeat(old, self.k)[there.ravel()], at])
        score, ids = np.concatenate([self.score[old][there], score]), np.concatenate([self.ids[old][there], ids])
        order = np.lexsort((ids, ~score, at))  # ~x falls as x rises, without overflow
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        fine = place < self.k
        at, place = at[fine], place[fine]
        self.score[at, place], self.ids[at, place] = score[fine], ids[fine]
        self.met[old] = np.unique(at, return_counts=True)[1]


class Lists:
    """A block's rows, by id, with its sorted lists."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.cells, n = ids[by_id], cells[by_id], len(ids)
        self.most = _largest(cells)
        columns = np.ascontiguousarray(self.cells.T)
        order = np.argsort(-columns, axis=1, kind="stable")  # best first, for each dimension
        self.sorted = np.take_along_axis(columns, order, 1)
        from_end = np.empty_like(order)
        np.put_along_axis(from_end, order, np.minimum(np.arange(n), np.arange(n)[::-1])[None], 1)
        self.level = from_end.min(axis=0) + 1  # the depth at which a row is first seen from either end of a list
        self.floats = self.cells.astype(np.float32 if float(self.most) ** 2 * len(columns) < 2.0**24 else np.float64)
        self.steps: dict[tuple[type, int], tuple[np.ndarray, np.ndarray]] = {}  # serve all queries that follow

    def step(self, kind: type, before: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows first seen below `before` and down to `depth`, and their components."""
        if (kind, depth) not in self.steps:
            new = np.flatnonzero((self.level > before) & (self.level <= depth))
            table = self.cells if kind is np.int64 else self.floats
            self.steps[kind, depth] = new, table[new].astype(kind, copy=False)
        return self.steps[kind, depth]

    def meet(self, best: Best, at: np.ndarray) -> None:
        """The block's rows go to queries `at` of `best`, if they are among their best."""
        n, q, first = len(self.ids), best.cells[at], int(self.ids[0])
        # sums of whole numbers are exact in floats below 2^24 and in doubles below 2^53, whose products are faster
        reach = float(self.most) * float(np.abs(q.astype(np.float64)).sum(axis=1).max())
        kind = np.float32 if reach < 2.0**24 else np.float64 if reach < 2.0**52 else np.int64
        q = q.astype(kind)
        own = np.searchsorted(self.ids, best.own[at]), np.searchsorted(self.ids, best.own[at], "right")
        depth = 0
        while len(at) and depth < n:
            least = best.least(at, first)
            if kind is not np.int64:  # there a sum may pass the largest integer and bounds nothing
                top, bottom = self.sorted[:, max(depth - 1, 0)].astype(kind), self.sorted[:, min(n - depth, n - 1)].astype(kind)
                still = np.flatnonzero(np.maximum(q, 0) @ top + np.minimum(q, 0) @ bottom >= least.astype(kind))
                if len(still) < len(at):
                    at, q, least, own = at[still], q[still], least[still], (own[0][still], own[1][still])
            before, depth = depth, min(depth * DEEPER or FIRST_DEPTH, n)
            if len(at):
                self._score(best, at, q, least.astype(kind), own, *self.step(kind, before, depth))

    def _score(self, best: Best, at: np.ndarray, q: np.ndarray, least: np.ndarray, own: tuple[np.ndarray, np.ndarray], new: np.ndarray, rows: np.ndarray) -> None:
        """`rows`, at the places `new`, go to queries `at` but those in their range of `own`."""
        if not len(new):
            return
        score = q @ rows.T
        hit = score >= least[:, None]
        for i in np.flatnonzero(own[0] < own[1]):
            hit[i, np.searchsorted(new, own[0][i]):np.searchsorted(new, own[1][i])] = False
        found = np.flatnonzero(hit)
        many = np.flatnonzero(np.bincount(found // len(new), minlength=len(at)) > best.k)
        if len(many):  # of a query's hits its best k, of equal ones the first
            s = np.where(hit[many], score[many], score.dtype.type(_LEAST))
            kth = np.partition(s, len(new) - best.k, axis=1)[:, [len(new) - best.k]]
            keep = hit[many] & (s >= kth)
            for i in np.flatnonzero(np.count_nonzero(keep, axis=1) > best.k):
                equal = np.flatnonzero(keep[i] & (s[i] == kth[i]))
                keep[i, equal[best.k - np.count_nonzero(keep[i]):]] = False
            hit[many] = keep
            found = np.flatnonzero(hit)
        if len(found):
            i, row = np.divmod(found, len(new))
            best.add(at[i], score[i, row].astype(np.int64), self.ids[new[row]])

    def search(self, q: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows but those with `own_id`; equal scores by smaller id."""
        best = Best(np.array([own_id]), q[None], k)
        self.meet(best, np.array([0]))
        return best.ids[0, :best.met[0]], best.score[0, :best.met[0]]


def _search(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each query in a cell; rows are (cell, kind, dim, n, first, ids, cells) by cell and kind, 0 for queries, 1 for rows."""
    asked: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    bests: dict[int, tuple[np.ndarray, Best]] = {}  # with the queries' numbers
    rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # small blocks wait for others

    def meet(dim: int) -> None:
        ids, cells = (np.concatenate(x) for x in zip(*rows.pop(dim)))
        if dim in asked:
            number, own, queries = (np.concatenate(x) for x in zip(*asked.pop(dim)))
            bests[dim] = number, Best(own, queries, k)
        if dim in bests:
            lists = Lists(ids, cells)
            for at in range(0, len(bests[dim][0]), AT_ONCE):
                lists.meet(bests[dim][1], np.arange(at, min(at + AT_ONCE, len(bests[dim][0]))))

    def ended() -> Iterator[pa.RecordBatch]:
        for dim in list(rows):
            meet(dim)
        for number, best in bests.values():
            for at in range(0, len(number), 16 * AT_ONCE):
                part = slice(at, at + 16 * AT_ONCE)
                there = np.arange(k) < best.met[part][:, None]
                out = [np.repeat(number[part], best.met[part]), np.repeat(best.own[part], best.met[part]), best.ids[part][there], best.score[part][there]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query", "query_id", "vec_id", "score"])
        for held in (asked, bests, rows):
            held.clear()

    cell = None
    for batch in batches:
        for c, kind, dim, n, first, ids, cells in zip(*batch.columns):
            if c.as_py() != cell:
                yield from ended()
                cell = c.as_py()
            d, own = dim.as_py(), np.frombuffer(ids.as_py(), "<i8")
            block = own, _unpacked(cells.as_py(), n.as_py(), d)
            if kind.as_py() == 0:
                asked.setdefault(d, []).append((first.as_py() + np.arange(len(own)), *block))
            else:
                rows.setdefault(d, []).append(block)
                if sum(len(x) for x, _ in rows[d]) >= most:
                    meet(d)
    yield from ended()


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, cells: floor(scale * x) of each component; rows with a NULL id, or no, NULL or non-finite components are left out."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.filter(F.col("id").isNotNull() & (F.size("v") > 0) & fine).select(
        "id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("cells"))


def grid(n_rows: int, n_asked: int, held: int, tasks: int, block_rows: int, query_rows: int) -> tuple[int, int]:
    """(groups of rows, groups of queries): about `tasks` cells, none of which holds much more than HELD of the `held` bytes of queries.

    Rows are sent to each group of queries, queries to each group of rows. With
    a given number of cells fewest are sent when groups of either kind are as large.
    """
    most_across, most_down = max(1, -(-n_rows // block_rows)), max(1, -(-n_asked // query_rows))
    tasks = min(tasks, most_across * most_down)
    even = round((tasks * n_asked / max(1, n_rows)) ** 0.5)
    down = min(max(1, even, -(-tasks // most_across), -(-held // HELD)), most_down)
    return min(-(-tasks // down), most_across), down


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
          block_rows: int = 2048, query_rows: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that meets `queries` its k best other rows.

    `queries` is a condition on `id`. The score is the inner product of the
    components times `scale`, rounded down; equal scores go by smaller vec_id.
    A row that repeats the query's id is no candidate of it; a repeated query is
    answered once. Vectors of different length are not compared. Fewer than k
    candidates give fewer rows.
    """
    spark = vectors.sparkSession
    rows = store(integer_vectors(vectors, id_col, vec_col, scale))
    asked = rows.filter(queries).distinct()
    asked = store(map_arrow(asked, partial(_pack, most=query_rows), _BLOCK).withColumn("first", F.monotonically_increasing_id() * query_rows))
    n_asked, held = asked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("ids") + F.length("cells") + F.col("n") * (16 * k)), F.lit(0))).first()
    across, down = grid(rows.count(), n_asked, held, int(spark.conf.get("spark.sql.shuffle.partitions")), block_rows, query_rows)
    blocks = map_arrow(rows, partial(_pack, most=block_rows), _BLOCK).withColumn("first", F.lit(None).cast("long"))

    def sent(df: DataFrame, copies: int, cell: Column, kind: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
        return df.select("*", each).select(cell.alias("cell"), F.lit(kind).alias("kind"), "dim", "n", "first", "ids", "cells")

    # a cell of the grid is a task; its queries come first
    cells = sent(asked, across, F.col("copy") * down + F.col("part") % down, 0).unionByName(
        sent(blocks, down, F.col("part") % across * down + F.col("copy"), 1)).repartitionById(across * down, "cell").sortWithinPartitions("cell", "kind")
    found = map_arrow(cells, partial(_search, k=k, most=block_rows), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
