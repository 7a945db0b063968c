"""The trie of conversation prefixes as a node table with minimal perfect hashing.

A conversation is a path of prefixes; a prefix is known by a 128-bit digest,
the exclusive-or of one hash for each (place, role, text), so digests of any
depth come from running aggregates and a parent's digest from one more xor.
Nodes are the distinct digests. Every member of a node must agree on the
SHA-256 of its last turn, its depth and its parent, else the job stops: by
induction from the root that proves the node to be one sequence of turns.

Subtree figures need no walk over the whole trie. Each node belongs to one
conversation, its smallest member, and thereby to one shard, in which the whole
path above it lies too. A shard numbers the digests of its conversations by a
minimal perfect hash, scatters its counts into flat arrays by slot, and adds
them up through an array of parent slots from the deepest nodes to the root.
What the shards found for a node is then summed. A shard holds about
`shard_rows` turns; a conversation longer than `segment` turns is cut into
pieces in different shards, the totals of later pieces being scattered at a
piece's last node. A node of very many conversations is one row of each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.common import map_arrow, ship, store
from terrapanel.llm.perfect_hash import PerfectHash
from terrapanel.operators.ordered import row_numbers, up

_SUMS = ["ends", "turn_chars", "own_chars", "own_leaves"]
_CHUNK = 1 << 16  # bytes of ids that are written as one piece of a list


def conversation_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), n (turns of the conversation), x (SHA-256 of role and text), chars of each turn, stored.

    Turns are ordered by number, NULL first, then by role and text. NULL roles
    and texts count as empty; rows without a conversation are left out.
    """
    t = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                     F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    t = t.select("conv", "turn", "role", "text", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("x"),
                 F.length("text").cast("bigint").alias("chars"))
    t = t.withColumn("known", F.col("turn").isNotNull())
    order = [up("known"), up("turn"), up("role"), up("text")]
    return store(row_numbers(t, ["conv"], order, "pos", "n").select("conv", "pos", "n", "x", "chars"))


def rebuild(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations with their length, rebuilt turns): the first h turns of the block's first conversation, then the own ones after h.

    h is crc32 of the conversation's number in decimal, modulo `most`.
    """
    h, base = F.crc32(F.col("conv").cast("string").cast("binary")) % most, F.col("conv") - F.col("conv") % block
    convs = turns.filter("pos = 1").select("conv", h.alias("h"), base.alias("base"), F.col("n").alias("own"))
    bases = turns.filter((F.col("conv") % block == 0) & (F.col("pos") < most)).select(
        F.col("conv").alias("base"), F.col("n").alias("there"), "pos", "x", "chars")
    sizes = bases.filter("pos = 1").select("base", "there")
    convs = convs.join(sizes, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("used"), F.greatest(F.lit(0), F.col("own") - F.col("h")).alias("rest"))
    convs = store(convs.withColumn("length", F.col("used") + F.col("rest")))
    taken = convs.select("conv", "base", "used", "length").join(bases, "base").filter("pos <= used").select("conv", F.col("pos").alias("d"), "length", "x", "chars")
    kept = turns.withColumns({"h": h, "base": base}).filter("pos > h").join(sizes, "base", "left").select(
        "conv", (F.least("h", F.coalesce("there", F.lit(0))) + F.col("pos") - F.col("h")).alias("d"),
        (F.least("h", F.coalesce("there", F.lit(0))) + F.col("n") - F.col("h")).alias("length"), "x", "chars")
    return convs, taken.unionByName(kept)


def prefixes(convs: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """Rows of all prefixes, the empty one included: conv, d, length, digest (a, b), parent (pa, pb), x, chars, seg; stored."""
    own = turns.withColumns({"ha": F.xxhash64(F.lit(1), "d", "x"), "hb": F.xxhash64(F.lit(2), "d", "x"), "seg": F.floor(F.col("d") / segment).cast("bigint")})
    so_far = Window.partitionBy("conv", "seg").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"la": F.bit_xor("ha").over(so_far), "lb": F.bit_xor("hb").over(so_far)})
    # what the pieces before add; only conversations longer than a piece have any
    pieces = own.filter(F.col("length") >= segment).groupBy("conv", "seg").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"))
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv", "seg", F.bit_xor("sa").over(before).alias("oa"), F.bit_xor("sb").over(before).alias("ob"))
    own = own.join(pieces, ["conv", "seg"], "left")
    zero = F.lit(0).cast("bigint")
    own = own.withColumns({"a": F.col("la").bitwiseXOR(F.coalesce("oa", zero)), "b": F.col("lb").bitwiseXOR(F.coalesce("ob", zero))})
    own = own.select("conv", F.col("d").cast("bigint").alias("d"), F.col("length").cast("bigint").alias("length"), "a", "b",
                     F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "x", "chars", "seg")
    none = F.lit(None).cast("bigint")
    roots = convs.select("conv", zero.alias("d"), F.col("length").cast("bigint").alias("length"), zero.alias("a"), zero.alias("b"),
                         none.alias("pa"), none.alias("pb"), F.lit(None).cast("binary").alias("x"), zero.alias("chars"), zero.alias("seg"))
    return store(own.unionByName(roots))


def _one(col: str) -> Column:
    """Whether all rows of a group agree on a column."""
    return F.min(col).eqNullSafe(F.max(col)) & (F.count(col).isin(0) | (F.count(col) == F.count(F.lit(1))))


def node_table(paths: DataFrame) -> DataFrame:
    """The distinct digests: depth, parent, smallest member and characters of the last turn."""
    agreed = _one("d") & _one("pa") & _one("pb") & _one("x")
    nodes = paths.groupBy("a", "b").agg(
        F.min("d").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv").alias("conv_id"),
        F.min("chars").alias("chars"), agreed.alias("agreed"))
    sure = F.when(F.col("agreed"), F.lit(True)).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("boolean"))
    return nodes.filter(sure).drop("agreed")


def _shard(conv: str, seg: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col(conv), seg), F.lit(shards)).cast("int")


def _sum_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of one shard's part of the trie."""
    keys = rows[["a", "b"]].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    first = np.ones(len(keys), bool)
    first[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    distinct = keys[order][first]
    table = PerfectHash(distinct)
    slot = table.slots(keys)
    depth, parent = np.full(table.n, -1, np.int64), np.full(table.n, -1, np.int64)
    path = (rows["depth"] >= 0).to_numpy()
    at = slot[path]
    depth[at] = rows["depth"].to_numpy()[path]
    above = rows["has_parent"].to_numpy(bool) & path
    parent[slot[above]] = table.slots(rows.loc[above, ["pa", "pb"]].to_numpy(np.int64).view(np.uint64))
    sums = np.zeros((table.n, len(_SUMS)), np.int64)
    np.add.at(sums, slot, rows[_SUMS].to_numpy(np.int64))
    by_depth = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, ends):
        up = parent[level]
        np.add.at(sums, up[up >= 0], sums[level[up >= 0]])
    digests = table.digests.view(np.int64)
    return pd.DataFrame({"a": digests[:, 0], "b": digests[:, 1], **{c: sums[:, k] for k, c in enumerate(_SUMS)}})


def _subtree_sums(paths: DataFrame, nodes: DataFrame, segment: int, shard_rows: int) -> DataFrame:
    """For each digest the members, their characters from here on, and the characters and leaves of the subtree's own nodes."""
    zero = F.lit(0).cast("bigint")
    shards = max(1, -(-paths.count() // shard_rows))
    # a piece's first node has its parent in another piece, which gets what is below it as a carried row

    def rows(df: DataFrame, conv: str, seg: Column, depth: Column, parent: bool, **sums: Column) -> DataFrame:
        return df.select(_shard(conv, seg, shards).alias("shard"), "a", "b", *([F.coalesce("pa", zero).alias("pa"), F.coalesce("pb", zero).alias("pb"), (F.col("pa").isNotNull() & (depth % segment != 0)).alias("has_parent")] if parent else
                         [zero.alias("pa"), zero.alias("pb"), F.lit(False).alias("has_parent")]), depth.alias("depth"),
                         *[sums.get(c, zero).cast("bigint").alias(c) for c in _SUMS])

    end = F.when(F.col("d") == F.col("length"), 1).otherwise(0)
    own = rows(paths, "conv", F.col("seg"), F.col("d"), True, ends=end, turn_chars=F.col("chars"))
    of_node = F.floor(F.col("depth") / segment).cast("bigint")
    owned = rows(nodes, "conv_id", of_node, F.lit(-1).cast("bigint"), False, own_chars=F.col("chars"), own_leaves=F.col("leaf"))
    # for conversations of several pieces: at each piece's last node, what the later pieces hold
    cut = paths.filter((F.col("d") % segment == segment - 1) & (F.col("d") < F.col("length"))).select("conv", "seg", "a", "b")
    long = paths.filter(F.col("length") >= segment).groupBy("conv", "seg").agg(F.sum("chars").alias("turn_chars"))
    held = nodes.filter(F.col("depth") >= segment).groupBy(F.col("conv_id").alias("conv"), of_node.alias("seg")).agg(
        F.sum("chars").alias("own_chars"), F.sum("leaf").alias("own_leaves"))
    later = Window.partitionBy("conv").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = long.join(held, ["conv", "seg"], "left").select("conv", "seg", *[F.coalesce(F.sum(c).over(later), zero).alias(c) for c in _SUMS[1:]])
    carried = rows(cut.join(after, ["conv", "seg"]), "conv", F.col("seg"), F.lit(-1).cast("bigint"), False,
                   ends=F.lit(1), **{c: F.col(c) for c in _SUMS[1:]})
    ship(paths.sparkSession)
    parts = own.unionByName(owned).unionByName(carried).groupBy("shard").applyInPandas(
        _sum_up, "a bigint, b bigint, " + ", ".join(f"{c} bigint" for c in _SUMS))
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the ascending list of ids of each node: (a, b, first id, comma-joined ids)."""
    node, first, ids, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": [node[0]], "b": [node[1]], "first": [first], "ids": [",".join(ids)]})

    for batch in batches:
        for a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if ids and (node != (a, b) or size > _CHUNK):
                yield piece()
                ids, size = [], 0
            if not ids:
                node, first = (a, b), conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list, from its pieces in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if node == (a, b):
                state.update(b",")
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "ends_sha256"), map(list, zip(*out)))))
    if node is not None:
        yield pa.RecordBatch.from_pydict({"a": [node[0]], "b": [node[1]], "ends_sha256": [state.hexdigest()]})


def list_digests(paths: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at a node.

    Lists are written in pieces by tasks that share a node's ids among them;
    one task then hashes a node's pieces as they pass, without holding them.
    """
    ends = paths.filter("d = length").select("a", "b", "conv")
    parts = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    pieces = map_arrow(parts, _listed, "a bigint, b bigint, first bigint, ids string")
    pieces = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids")
    return map_arrow(pieces, _hashed, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                segment: int = 50_000, shard_rows: int = 200_000) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (NULL at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Rows without a conversation
    are left out; a table without any gives no rows. Turns with equal numbers are
    ordered by role and text. Other columns are not read. A list of ids is hashed
    in one task for each node, as SHA-256 has to be; all else is spread.
    """
    convs, rebuilt = rebuild(conversation_turns(turns, conv_col, turn_col, role_col, text_col))
    paths = prefixes(convs, rebuilt, segment)
    nodes = node_table(paths)
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn(
        "leaf", F.when(F.col("n_children") == 0, 1).otherwise(0)))
    sums = _subtree_sums(paths, nodes, segment, shard_rows)
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["a", "b"]).join(list_digests(paths), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", F.col("ends").alias("n_convs"), "n_children", F.col("own_leaves").alias("n_leaves"),
                      (F.col("turn_chars") - F.col("own_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
