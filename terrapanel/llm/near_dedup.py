"""Near duplicates with DartMinHash signatures, banded joining and exact verification.

A document is a weighted set of hashed word shingles. Every shingle has an
endless supply of darts, a function of its hash alone: each dart falls at some
weight, at some time and on one of `coordinates` coordinates. A document is hit
by the darts that fall below its shingles' weights; per coordinate the earliest
hit is its signature. Two documents agree on a coordinate with the probability
of their weighted Jaccard similarity. Time is cut into doubling intervals, and
only so many are thrown as the document's total weight needs to fill every
coordinate, so a long document throws few darts at each shingle.

Documents whose signatures agree on all coordinates of a band meet in a bucket.
Within a bucket members are not compared pair by pair. First one leader, the
member with most company in all its buckets, is compared with the others;
links that hold are merged into classes, which settles groups of near copies.
Where buckets still hold several classes, the shingles of their documents are
split into rare ones, which a few of them have, and common ones. Documents of
different classes that share a rare shingle are compared. Any others can only
be alike if their common shingles alone reach: rare ones then count in the
union and not in the overlap. The pairs of a bucket that this bound leaves are
compared in rounds of growing size. So no link between different texts of a
bucket is lost. Similarity is exact, from the shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import keep_decided, map_arrow, sieve, slices, store, text_key, text_or_empty
from terrapanel.operators.graph import connected_components

CACHE = 100_000  # words a worker remembers; it starts again when full, which changes no result
FIRST_TIME = 2.0**-12  # end of the first interval of time
RARE = 8  # a shingle of at most so many open documents is rare; any number gives the same classes
MOST_DARTS = 24  # no cell is expected to hold more than 1 dart; more than this has probability below 1e-24

_WORD = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # public mixing constants of SplitMix64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of each number."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _words() -> dict[str, int]:
    return {}


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, from their UTF-8 bytes."""
    known = _words()
    if len(known) > CACHE:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = int.from_bytes(_blake(w.encode("utf-8", "surrogatepass")), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _blake(data: bytes, size: int = 8) -> bytes:
    return blake2b(data, digest_size=size).digest()


def shingles(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in ascending order, how often each occurs).

    Words are runs of letters, digits and underscores in lower case. A text of
    fewer words is one shingle of all of them; one without words has none.
    """
    found = _WORD.findall(text.lower())
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _word_hashes(found)
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, len(h) if len(h) < words else words, np.uint64)
        for k in range(min(words, len(h))):
            out = mix(out ^ h[k:k + n])
    return np.unique(out, return_counts=True)


@lru_cache(4)
def _poisson_steps(mean: float) -> np.ndarray:
    """Thresholds of a 64-bit uniform number for 1, 2, ... darts in a cell."""
    p, total, out = np.exp(-mean), 0.0, []
    for k in range(MOST_DARTS):
        total += p
        out.append(min(total, 1.0 - 2.0**-53))
        p *= mean / (k + 1)
    return np.array(out)


def signatures(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, coordinates: int) -> np.ndarray:
    """Time of the earliest dart on each coordinate, a row for each of `n_docs` weighted sets.

    `elements`, `weights` and `docs` (the set, ascending) run in parallel; every
    set needs an element. Weight is cut at 1, 2, 4, ... and time at FIRST_TIME
    and its doubles. In a cell of both an element has a Poisson number of darts,
    one on average for each unit of area and coordinate; cells with a mean
    above one are cut along time. A set drops out when all its coordinates are
    filled: later intervals hold no earlier dart. Times differ between darts,
    so equal times mean the same dart.
    """
    best = np.full(n_docs * coordinates, np.inf)
    low, high, level = 0.0, FIRST_TIME, 0
    with np.errstate(over="ignore"):
        while len(elements):
            w_low, w_high, w_level = 0.0, 1.0, 0
            while w_low < weights.max():
                area = coordinates * (high - low) * (w_high - w_low)
                parts = max(1, int(np.ceil(area)))
                here = np.flatnonzero(weights > w_low) if w_low else np.arange(len(weights))
                part = np.tile(np.arange(parts, dtype=np.uint64), len(here))
                here = np.repeat(here, parts)
                seed = mix(elements[here] ^ mix(part + np.uint64((level << 48) + (w_level << 40))))
                uniform = seed.astype(np.float64) * 2.0**-64
                steps, nth = _poisson_steps(area / parts), 0
                hit = np.flatnonzero(uniform >= steps[0])
                while len(hit):
                    dart = mix(seed[hit] + np.uint64(nth + 1) * _M3)
                    when = mix(dart).astype(np.float64) * 2.0**-64
                    time = low + (part[hit] + when) * ((high - low) / parts)
                    key = docs[here[hit]] * coordinates + (dart % np.uint64(coordinates)).astype(np.int64)
                    if w_low or weights.min() < 1:
                        where = w_low + mix(dart ^ _M1).astype(np.float64) * 2.0**-64 * (w_high - w_low)
                        inside = where < weights[here[hit]]
                        key, time = key[inside], time[inside]
                    np.minimum.at(best, key, time)
                    nth += 1
                    hit = hit[uniform[hit] >= steps[nth]] if nth < MOST_DARTS else hit[:0]
                w_low, w_high, w_level = w_high, w_high * 2, w_level + 1
            left = np.isinf(best.reshape(n_docs, coordinates)).any(1)[docs]
            elements, weights, docs = elements[left], weights[left], docs[left]
            low, high, level = high, high * 2, level + 1
    return best.reshape(n_docs, coordinates)


def band_hashes(times: np.ndarray, rows: int) -> np.ndarray:
    """For each signature one hash for each band of `rows` coordinates."""
    table = times.view(np.uint64).reshape(len(times), -1, rows)
    with np.errstate(over="ignore"):
        out = np.arange(1, table.shape[1] + 1, dtype=np.uint64) * _M2
        for k in range(rows):
            out = mix(out ^ table[:, :, k])
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """(uid, id, key, text) to (uid, id, key, set, bands); a text without words has no bands and is its own set."""
    for part in (p for batch in batches for p in slices(batch, 3)):
        found = [shingles(t, words) for t in part.column(3).to_pylist()]
        sets = [_blake(own.tobytes() + (times.tobytes() if counted else b""), 16) if len(own) else key
                for (own, times), key in zip(found, part.column(2).to_pylist())]
        full = [k for k, (own, _) in enumerate(found) if len(own)]
        hashes: list[np.ndarray | None] = [None] * len(found)
        if full:
            weights = np.concatenate([found[k][1] if counted else np.ones(len(found[k][1])) for k in full]).astype(np.float64)
            docs = np.repeat(np.arange(len(full)), [len(found[k][0]) for k in full])
            times = signatures(np.concatenate([found[k][0] for k in full]), weights, docs, len(full), bands * rows)
            for k, h in zip(full, band_hashes(times, rows)):
                hashes[k] = h
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                                         ["uid", "id", "key", "set", "bands"])


def _elements(batches: Iterator[pa.RecordBatch], words: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """(uid, text) to (uid, shingle hashes); with `counted` the n-th occurrence of a shingle is an element of its own."""
    for part in (p for batch in batches for p in slices(batch, 1)):
        out = []
        for text in part.column(1).to_pylist():
            own, times = shingles(text, words)
            if counted:
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                with np.errstate(over="ignore"):
                    own = mix(np.repeat(own, times) + nth.astype(np.uint64) * _M2)
            out.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], ["uid", "elements"])


def _wanted_texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(uid, text) for each of `wanted` (uid, key; no key twice): only texts that may be wanted are shuffled, copies of one combined before."""
    wanted = store(wanted.withColumn("hash", F.xxhash64("key")))
    texts = docs.select(text_key(text_col).alias("key"), text_or_empty(f"`{text_col}`").alias("text"))
    texts = texts.filter(sieve(wanted, "hash", in_lambdas=False)(F.xxhash64("key"))).groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(wanted, "key").select("uid", "text")


def _first_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each bucket's leader, the member whose buckets have most members, with every other member."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    company = members.join(sizes, "bucket").groupBy("uid").agg(F.sum("n").alias("company"))
    lead = members.join(company, "uid").groupBy("bucket").agg(F.max_by(F.col("uid"), F.struct("company", -F.col("uid"))).alias("lead"))
    pairs = members.join(lead, "bucket").filter("uid <> lead")
    return pairs.select(F.least("lead", "uid").alias("a"), F.greatest("lead", "uid").alias("b")).distinct()


def _open_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(uid, bucket, class, main): members of buckets with several classes; `main` is the class with most members there."""
    rows = members.join(classes, "uid")
    sizes = rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "class")).alias("top")).filter("classes > 1")
    return rows.join(buckets.select("bucket", F.col("top.class").alias("main")), "bucket")


def _rare_shingles(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """(uids): for each shingle that at most RARE documents have, those documents in order.

    Counted are `docs` (uid) and the few others that pass a sieve of them.
    """
    known = sieve(docs.select(F.xxhash64("uid").alias("hash")), "hash", in_lambdas=False)
    own = elements.filter(known(F.xxhash64("uid"))).select("uid", F.explode("elements").alias("e"))
    by_shingle = Window.partitionBy("e")
    # one document more than RARE tells a common shingle; each task hands on no more of it
    some = own.withColumn("nth", F.row_number().over(by_shingle.orderBy("uid"))).filter(F.col("nth") <= RARE + 1)
    found = some.withColumn("uids", F.collect_list("uid").over(by_shingle)).filter((F.col("nth") == 1) & (F.size("uids") <= RARE))
    return store(found.select(F.array_sort("uids").alias("uids")))


def _room(docs: DataFrame, elements: DataFrame, rare: DataFrame) -> DataFrame:
    """(uid, own, shared): how many rare and how many common shingles a document has."""
    own = rare.select(F.explode("uids").alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("own"))
    sized = elements.select("uid", F.size("elements").alias("size")).join(docs, "uid", "left_semi").join(own, "uid", "left")
    return store(sized.select("uid", F.coalesce("own", F.lit(0)).alias("own"), (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared")))


def _rare_pairs(rare: DataFrame, room: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): documents of different classes that share a rare shingle and are not too different in size."""
    # at most (RARE - 1) / 2 pairs for each document of a shingle
    pairs = F.flatten(F.transform("uids", lambda b, k: F.transform(F.slice("uids", 1, k), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    shared = rare.filter(F.size("uids") > 1).select(F.inline(pairs)).distinct()
    docs = room.join(classes, "uid").select("uid", "class", (F.col("own") + F.col("shared")).alias("size"))
    a = docs.withColumnsRenamed({"uid": "a", "class": "class_a", "size": "size_a"})
    b = docs.withColumnsRenamed({"uid": "b", "class": "class_b", "size": "size_b"})
    fits = (F.col("class_a") != F.col("class_b")) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
    return shared.join(a, "a").join(b, "b").filter(fits).select("a", "b")


def _further_pairs(open_: DataFrame, room: DataFrame, similarity: float, leaders: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, most): pairs of a leader and a member of another class that can be alike though they share no rare shingle.

    Leaders are the smallest `leaders` members of a bucket outside its main
    class that could be linked with anything; `most` is how many it has at most.
    """
    rows = open_.join(room, "uid")
    able = F.col("shared") >= similarity * (F.col("shared") + F.col("own"))
    rows = rows.filter(able)
    outside = rows.filter("class <> main")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("uid"))
    lead = outside.withColumn("nth", nth).filter(F.col("nth") <= leaders).select(
        "bucket", F.col("uid").alias("lead"), F.col("class").alias("lead_class"), F.col("own").alias("lead_own"), F.col("shared").alias("lead_shared"))
    union = F.col("own") + F.col("lead_own") + F.greatest("shared", "lead_shared")
    fits = (rows["class"] != F.col("lead_class")) & (F.least("shared", "lead_shared") >= similarity * union)
    pairs = rows.join(lead, (rows["bucket"] == lead["bucket"]) & fits).select(F.least("lead", "uid").alias("a"), F.greatest("lead", "uid").alias("b"))
    most = outside.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    return pairs.distinct(), most


def _merge(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` (uid, class) with the classes that `links` (a, b) connect made one, named by the smallest."""
    a, b = classes.withColumnsRenamed({"uid": "a", "class": "class_a"}), classes.withColumnsRenamed({"uid": "b", "class": "class_b"})
    edges = store(links.join(a, "a").join(b, "b").filter("class_a <> class_b").select("class_a", "class_b").distinct())
    ends = edges.select(F.col("class_a").alias("class")).unionByName(edges.select(F.col("class_b").alias("class"))).distinct()
    whole = connected_components(ends, edges, "class", "class_a", "class_b", "whole")
    return store(classes.join(whole, "class", "left").select("uid", F.coalesce("whole", "class").alias("class")))


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are similar enough, by their exact Jaccard similarity."""
    a = sets.select(F.col("uid").alias("a"), F.col("elements").alias("x"))
    b = sets.select(F.col("uid").alias("b"), F.col("elements").alias("y"))
    n, m = F.size("x"), F.size("y")
    close = F.least(n, m) >= similarity * F.greatest(n, m)
    both = F.when(close, F.size(F.array_intersect("x", "y")))
    return pairs.join(b, "b").join(a, "a").withColumn("both", both).filter(F.col("both") >= similarity * (n + m - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
                    bands: int = 30, rows: int = 5, counted: bool = False) -> DataFrame:
    """One row for each document: id, class_id, class_size, kept.

    Documents are linked when the Jaccard similarity of their shingles is at
    least `similarity`; a class is what links connect, its id the smallest id
    in it, and exactly one row of it, with that id, is kept. With `counted`
    shingles weigh as often as they occur, else each weighs one. Texts with
    equal shingles are one class; texts without words are alike only where they
    are equal. With 30 bands of 5, a pair at 0.8 misses all buckets with
    probability 7e-6. A NULL text counts as empty, a NULL id comes last. Other
    columns are not read; an empty table gives no rows.
    """
    return _classes(docs, id_col, text_col, words, similarity, bands, rows, counted).select(
        F.col("id").alias(id_col), "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with one row of each class of near duplicates, all its columns unchanged."""
    return keep_decided(docs, id_col, text_col, _classes(docs, id_col, text_col, **how))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, bands: int = 30, rows: int = 5,
             counted: bool = False) -> DataFrame:
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"),
                      text_key(text_col).alias("key"), text_or_empty(f"`{text_col}`").alias("text"))
    schema = T.StructType([*own.schema.fields[:3], T.StructField("set", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = store(map_arrow(own, partial(_sign, words=words, bands=bands, rows=rows, counted=counted), schema))
    best = F.struct(F.col("id").isNull().alias("last"), "id", "uid")
    sets = signed.groupBy("set").agg(F.min("uid").alias("rep"), F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    one = store(signed.join(sets.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "key", "bands"))
    spread = one.select("uid", F.explode("bands").alias("bucket"))
    shared = store(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
    # a document has no bucket twice; only those that may be shared are shuffled with their documents
    members = store(spread.filter(sieve(shared, "bucket", in_lambdas=False)(F.col("bucket"))).join(shared, "bucket", "left_semi"))

    # the shingles of documents that share a bucket, found again by their text's key
    texts = _wanted_texts(docs, text_col, one.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "key"))
    elements = store(map_arrow(texts, partial(_elements, words=words, counted=counted), "uid long, elements array<long>"))

    classes = elements.select("uid", F.col("uid").alias("class"))
    done = store(_first_pairs(members))
    found = store(_links(done, elements, similarity))
    classes = _merge(classes, found)
    leaders, room = 64, None
    while True:
        open_ = store(_open_members(members, classes))
        if open_.isEmpty():
            break
        first = room is None
        if first:
            ids = store(open_.select("uid").distinct())
            rare = _rare_shingles(ids, elements)
            room = _room(ids, elements, rare)
        pairs, most = _further_pairs(open_, room, similarity, leaders)
        if first:
            pairs = pairs.unionByName(_rare_pairs(rare, room, classes, similarity)).distinct()
        pairs = store(pairs.join(done, ["a", "b"], "left_anti"))
        found = store(_links(pairs, elements, similarity))
        if not found.isEmpty():
            classes = _merge(classes, found)
        if (most.first()[0] or 0) <= leaders:  # all pairs that can be alike have been compared
            break
        done = done.unionByName(pairs)
        leaders *= 16
    labelled = sets.join(classes.withColumnRenamed("uid", "rep"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    whole = labelled.groupBy("class").agg(F.min("best").alias("keep"), F.sum("n").alias("class_size"))
    by_set = labelled.select("set", "class").join(whole, "class").select("set", "keep", "class_size")
    return signed.join(by_set, "set").select(
        "id", "key", F.col("keep.id").alias("class_id"), "class_size", (F.col("uid") == F.col("keep.uid")).alias("kept"))
