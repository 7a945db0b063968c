"""Toxicity by multiple-instance learning: documents carry labels, sentences are scored.

A sentence's probability is logistic in its words and word beginnings. A
document is toxic unless all its sentences are clean (noisy-or), so the labels
of documents train the scores of sentences, which then show where the offence
lies. Counts of features per class are made over the training documents in
Spark; the features that tell the classes apart best make a bounded vocabulary,
and the model is fitted on a bounded sample of each label, of which only
sentences that hold such features are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import map_arrow, ship, slices, store, text_or_empty

BEGINNINGS = (4, 5, 6, 7)  # lengths of word beginnings that are features besides whole words
MOST_COUNTS = 200_000  # counts a task holds before it hands them on
CACHE = 100_000  # words a worker remembers; it starts again when full, which changes no result

_TOKEN = re.compile(r"\w+|[.!?\n]+")


def word_features(word: str) -> list[str]:
    """The whole word and its beginnings; `word` is in lower case."""
    return ["=" + word, *[word[:n] for n in BEGINNINGS if len(word) > n]]


def sentences(text: str) -> Iterator[list[str]]:
    """Words of each sentence that has some; sentences end at full stops, exclamation and question marks and line ends."""
    own: list[str] = []
    for token in _TOKEN.findall(text.lower()):
        if token[0] in ".!?\n":
            if own:
                yield own
            own = []
        else:
            own.append(token)
    if own:
        yield own


@dataclass
class Model:
    """Weights of features and the constant of the sentence score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0

    def words(self) -> dict[str, float]:
        """A table of word weights that fills itself."""
        return _WordWeights(self.weights)


class _WordWeights(dict):
    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        # a sentence end counts nothing and is told apart by NaN
        out = float("nan") if word[0] in ".!?\n" else sum(self.weights.get(f, 0.0) for f in word_features(word))
        self[word] = out
        return out


def sentence_scores(text: str, words: dict[str, float], bias: float) -> np.ndarray:
    """Probability of each sentence that has words, in order."""
    tokens = _TOKEN.findall(text.lower())
    w = np.fromiter(map(words.__getitem__, tokens), np.float64, len(tokens))
    end = np.isnan(w)
    number = np.cumsum(end)
    own = number[~end]
    if not len(own):
        return np.empty(0)
    total = np.bincount(own, w[~end])[np.flatnonzero(np.bincount(own))]
    return 1.0 / (1.0 + np.exp(-np.clip(bias + total, -40, 40)))


def noisy_or(p: np.ndarray) -> float:
    """Probability that at least one sentence is toxic; 0 for none."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to counts of documents by feature, added up in part."""
    def made(counts: list[Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()),
            pa.array([counts[0][n] for n in names], pa.int64())], ["feature", "toxic", "clean"])

    counts = [Counter(), Counter()]
    for batch in batches:
        for part in slices(batch, 1):
            for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = {w for s in sentences(text) for w in s}
                counts[toxic].update({f for w in found for f in word_features(w)})
                if len(counts[0]) + len(counts[1]) > MOST_COUNTS:
                    yield made(counts)
                    counts = [Counter(), Counter()]
    yield made(counts)


def _chosen(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(uid, toxic, text) to (uid, toxic, sentences without features, features, sizes of the others)."""
    for batch in batches:
        for part in slices(batch, 2):
            plain, features, sizes = [], [], []
            for text in part.column(2).to_pylist():
                none, own, size = 0, [], []
                for s in sentences(text):
                    found = [vocabulary[f] for w in s for f in word_features(w) if f in vocabulary]
                    if found:
                        own += found
                        size.append(len(found))
                    else:
                        none += 1
                plain.append(none)
                features.append(own)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(plain, pa.int64()), pa.array(features, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))],
                ["uid", "toxic", "plain", "features", "sizes"])


def fit_noisy_or(toxic: np.ndarray, plain: np.ndarray, features: list[np.ndarray], sizes: list[np.ndarray], n_features: int,
                 steps: int = 500, rate: float = 0.1, ridge: float = 0.02, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the documents' log loss plus a ridge penalty, by full-batch Adam steps.

    `weight` says for how many documents each stands, one if it is left out.
    """
    if not len(toxic):
        return np.zeros(n_features), Model.bias
    f = np.concatenate([np.asarray(x, np.int64) for x in features])
    size = np.concatenate([np.asarray(x, np.int64) for x in sizes])
    sentence_of = np.repeat(np.arange(len(size)), size)
    doc_of = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
    n, y = len(toxic), toxic.astype(bool)
    x = np.append(np.zeros(n_features), -6.0)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, b = x[:-1], x[-1]
        z = b + np.bincount(sentence_of, w[f], len(size))
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        p0 = 1.0 / (1.0 + np.exp(-b))
        all_clean = np.bincount(doc_of, -np.logaddexp(0.0, z), n) - plain * np.logaddexp(0.0, b)  # log probability
        # slope of the loss by each sentence's z is pull * p
        pull = np.where(y, -1.0 / np.maximum(np.expm1(np.clip(-all_clean, 1e-9, 600.0)), 1e-9), 1.0)
        pull = pull if weight is None else pull * weight
        slope = pull[doc_of] * p
        g = np.append(np.bincount(f, slope[sentence_of], n_features) + ridge * w, slope.sum() + (pull * plain).sum() * p0) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return x[:-1], float(x[-1])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each list of a column as a view of its values."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    values, ends = whole.values.to_numpy(), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


LABELS_BROADCAST = 1_000_000  # labelled ids, about 30 MB


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_train: int = 12_000, max_features: int = 4096, least_docs: int = 3) -> Model:
    """Fit on the documents that `labels` (id, label 0 or 1) names.

    Features are counted over all of them; at most `max_features` are used, those
    with the largest chi-square that occur in `least_docs` documents. The fit
    uses at most `max_train` ids, chosen by a hash: half of each label, more of
    one where the other has fewer, and each document stands for its share of its
    label. A feature that none of these holds has the log odds of its counts. An id with several labels is toxic if any
    says so; NULL ids and labels are left out. No labels give a model that
    calls nothing toxic.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    own = own.filter("label_id IS NOT NULL AND toxic IN (0, 1)").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    # texts stay where they are while the labels fit a broadcast; beyond that, both sides are shuffled by id
    near = F.broadcast(own) if own.count() <= LABELS_BROADCAST else own
    labelled = texts.join(near, F.col("id") == F.col("label_id"))
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model()
    ids = own.join(texts, F.col("id") == F.col("label_id"), "left_semi")
    n_ids = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = [ids.filter(F.col("toxic") == x).orderBy(F.xxhash64(F.col("label_id").cast("string")), "label_id").limit(max(max_train // 2, max_train - n_ids[1 - x]))
            for x in (0, 1)]
    # at most max_train ids, so the texts need not be shuffled to find theirs
    rows = store(texts.join(F.broadcast(half[0].unionByName(half[1])), F.col("id") == F.col("label_id")).select(F.col("id").cast("string").alias("uid"), "toxic", "text"))
    counts = map_arrow(labelled.select("toxic", "text"), _count, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("t"), F.sum("clean").cast("double").alias("c"))
    a, b, t, c = F.lit(float(n[1])), F.lit(float(n[0])), F.col("t"), F.col("c")
    chi = F.pow(t * (b - c) - c * (a - t), F.lit(2.0)) / ((t + c) * (a + b - t - c) + 1)
    best = counts.filter(t + c >= least_docs).orderBy(chi.desc(), "feature").limit(max_features)
    chosen = best.select("feature", "t", "c").collect()
    vocabulary = {r["feature"]: k for k, r in enumerate(chosen)}
    kept = map_arrow(rows, partial(_chosen, vocabulary=vocabulary),
                     "uid string, toxic int, plain long, features array<int>, sizes array<int>")
    # at most max_train rows, as Arrow buffers; in a fixed order, so that sums come out the same
    table = kept.orderBy("uid", "toxic", "plain", "features").toArrow()
    toxic, plain = table["toxic"].to_numpy(), table["plain"].to_numpy().astype(float)
    features, sizes = _lists(table["features"]), _lists(table["sizes"])
    stands_for = np.where(toxic == 1, n[1] / max(1, (toxic == 1).sum()), n[0] / max(1, (toxic == 0).sum()))
    w, bias = fit_noisy_or(toxic, plain, features, sizes, len(vocabulary), weight=stands_for)
    held = set(np.unique(np.concatenate([np.empty(0, np.int32), *features])).tolist())
    for k, r in enumerate(chosen):
        if k not in held:
            w[k] = math.log((r["t"] + 0.5) / (n[1] + 1)) - math.log((r["c"] + 0.5) / (n[0] + 1))
    return Model({f: float(w[k]) for f, k in vocabulary.items()}, bias)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with a struct `toxicity` (score, toxic_sentences); a NULL or empty text has score 0.

    A column of that name is replaced; all others stay as they are.
    """
    return docs.withColumn("toxicity", score_column(model, text_or_empty(f"`{text_col}`")))


def _score(batches: Iterator[pa.Array], weights: dict[str, float], bias: float) -> Iterator[pa.Array]:
    words = Model(weights, bias).words()
    for texts in batches:
        found = [sentence_scores(t, words, bias) for t in texts.to_pylist()]
        yield pa.StructArray.from_arrays(
            [pa.array([noisy_or(p) for p in found], pa.float64()), pa.array([int((p >= 0.5).sum()) for p in found], pa.int32())],
            ["score", "toxic_sentences"])


def score_column(model: Model, text: Column) -> Column:
    """The document's probability and its number of sentences at 0.5 or more, computed over Arrow batches."""
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _score(batches, weights, bias)

    weights, bias = model.weights, model.bias
    ship(SparkSession.active())
    return F.arrow_udf(score, "struct<score: double, toxic_sentences: int>", F.ArrowUDFType.SCALAR_ITER)(text)


def _locate(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    words = model.words()
    for batch in batches:
        for part in slices(batch, 1):
            row, start, end, score = [], [], [], []
            for r, text in enumerate(part.column(1).to_pylist()):
                at, total, first, last = 0, 0.0, None, 0
                for token in [*_TOKEN.finditer(text), None]:
                    if token is None or token[0][0] in ".!?\n":
                        if first is not None:
                            p = 1.0 / (1.0 + np.exp(-np.clip(model.bias + total, -40, 40)))
                            if p >= threshold:
                                row.append(r)
                                start.append(first)
                                end.append(last)
                                score.append(float(p))
                        total, first = 0.0, None
                    else:
                        total += words[token[0].lower()]
                        first, last = token.start() if first is None else first, token.end()
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64())],
                ["id", "start", "end", "score"])


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, start, end (code points, from the first word to the end of the last), score of each sentence at `threshold` or more."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    return map_arrow(own, partial(_locate, model=model, threshold=threshold), schema).withColumnRenamed("id", id_col)
