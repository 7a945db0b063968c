"""Secret scan: token-like strings proposed by a pattern, told from false positives by a random forest.

Proposed are the forms of known providers, values of fields that are named
after a secret (of any length), and long runs that mix kinds of characters;
a name is not part of the value that is assigned to it.

Features of a candidate are its length, its make-up and the transitions between
kinds of characters, whether it begins as a known provider's, how much of it the
corpus's own common words cover, the document's path, and the words on both
sides: cues, and the nearest words hashed. The forest is trained on labelled
findings: the caller's own, or those that `certain` labels because their form
leaves no doubt. Every score is the forest's, also for those. Texts are only
ever handled by Spark's own functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import let, packed, sieve, store, text_key, text_or_empty
from terrapanel.llm.spans import find_all

BEFORE = 48  # characters before a candidate that count as its neighbourhood
AFTER = 32  # and behind it
DICTIONARY = 1000  # the corpus's commonest words that may cover a candidate
LEAST_DOCS = 3  # documents that hold a word of the dictionary, at least
BUCKETS = 12  # hash buckets for the nearest words, on each side
MARK = "[SECRET]"

_CUES = r"token|secret|passw|pass[ _-]?phrase|pwd|api[ _.-]?key|access[ _.-]?key|private[ _.-]?key|credential|auth|bearer|signature"
_AGAINST = r"sha-?[0-9]*|commit|checksum|digest|hash|md5|uuid|guid|isbn|order|serial|phone|card|\bid\b"
_FORMS = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|sk-[A-Za-z0-9]{20}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10}"
_KNOWN = rf"(?<![A-Za-z0-9])(?:{_FORMS})"
_FIELD = rf"(?:{_CUES})[A-Za-z0-9_-]{{0,20}}[\"']?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}"  # a name that holds a cue, and the sign after it

_TEST_PATH = r"(?i)test|example|sample|fixture|mock|doc|vendor|lock$|\.md$"
_WORDS = ("about|account|after|again|also|area|auch|avec|back|base|book|case|city|como|company|data|day|della|der|desde|die|dans|est|example|field|file|first|for|form|from|"
          "good|group|hand|have|home|house|image|index|into|item|job|les|life|line|list|main|make|name|nicht|not|number|order|para|page|part|people|place|pour|product|que|"
          "school|server|service|site|state|story|system|table|test|text|that|the|this|time|title|type|und|user|value|von|water|web|week|with|word|work|world|year|una")

_RUN = "A-Za-z0-9+/_-"
_PAD = rf"(?:={{1,2}}+(?![={_RUN}]))"
_MIXED = rf"(?=[A-Za-z+/_-]*+[0-9]|[{_RUN}]*?[a-z][A-Z])"  # a digit, or a capital after a small letter, anywhere in the run
_VALUE = r"[^\s\"'&;,<>(){}\[\]=:][^\s\"'&;,<>(){}\[\]]*(?<![.:])"
# Tried in this order at each place; no dots, which mean another thing within find_all
CANDIDATE = "|".join([
    rf'(?<=")(?<=(?i:{_FIELD})")(?!")[^"\\\n]*+(?:\\[^\n][^"\\\n]*+){{0,50}}+(?=")',  # quoted values of fields named after a secret
    rf"(?<=')(?<=(?i:{_FIELD})')(?!')[^'\\\n]*+(?:\\[^\n][^'\\\n]*+){{0,50}}+(?='(?![A-Za-z0-9]))",
    rf"(?<=[:=>]\s{{0,3}})(?<=(?i:{_FIELD})){_VALUE}",  # the same without quotes
    rf"(?<=\s)(?<=(?i:bearer)\s{{1,3}}){_VALUE}",
    rf"{_KNOWN}[{_RUN}]*+{_PAD}?",
    rf"(?<=[A-Za-z0-9_-]=){_MIXED}[{_RUN}]{{8,}}+{_PAD}?",  # what is assigned to any name
    # long runs, unless they are the name of a field themselves
    rf"(?<![{_RUN}])(?=[{_RUN}]{{14}}){_MIXED}(?![{_RUN}]*?(?i:{_CUES})[A-Za-z0-9_-]{{0,20}}[\"']?\s{{0,3}}[:=]\s{{0,3}}[^\s=])"
    rf"(?:[{_RUN}]{{16,}}+{_PAD}?|[{_RUN}]{{14,15}}+(?<=[{_RUN}]{{15}}){_PAD}|[{_RUN}]{{14}}==(?![={_RUN}]))"])


@dataclass(frozen=True)
class Forest:
    """Size of the forest and the bound on its training sample."""

    trees: int = 40
    depth: int = 8
    max_train: int = 20_000
    seed: int = 7
    names: list[str] = field(default_factory=lambda: [
        "length", "long", "changes", "capitals", "to_digit", "from_digit", "consonants", "digits", "upper", "lower", "signs", "distinct", "hex", "known", "covered",
        "test_path", "cue", "against", "assigned", "quoted", "cue_after", "against_after",
        *[f"before_{k}" for k in range(BUCKETS)], *[f"after_{k}" for k in range(BUCKETS)]])


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY) -> list[str]:
    """The words of three to twelve letters a-z that most documents hold, counted over all whole texts."""
    own = F.array_distinct(F.filter(F.split(F.lower(text_or_empty(f"`{text_col}`")), "[^a-z]+"), lambda w: F.length(w).between(3, 12)))
    counts = docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCS)
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(words).collect()]


def _share(v: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(v, f"[^{chars}]", "")) / F.length(v)


def _near(text: Column, last: bool) -> Column:
    """How many of the two nearest words fall in each bucket."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")
    two = F.slice(F.reverse(words) if last else words, 1, 2)
    return let(F.transform(two, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))), lambda own: F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter(own, lambda x: x == k)).cast("double")))


def _features(v: Column, before: Column, after: Column, path: Column, words: list[str]) -> Column:
    n = F.length(v).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "\u0001"), "[A-Z]+", "\u0002"), "[a-z]+", "\u0003")
    # longer words first, so that a short one does not end a match early
    covered = n - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(words, key=lambda w: (-len(w), w))), "")) if words else F.lit(0.0)
    low, tail = F.lower(before), F.lower(after)
    often = lambda c, pattern: F.regexp_count(c, F.lit(pattern)) / n
    values = [
        F.least(n, F.lit(256.0)), (n >= 32).cast("double"), F.length(kinds) / n, often(v, "[a-z][A-Z]"), often(v, "[A-Za-z][0-9]"), often(v, "[0-9][A-Za-z]"),
        often(F.lower(v), "[bcdfghjklmnpqrstvwxz]{4}"), _share(v, "0-9"), _share(v, "A-Z"), _share(v, "a-z"), _share(v, "+/_=-"),
        F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0)), v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"), v.rlike(f"^{_KNOWN}").cast("double"),
        covered / n, path.rlike(_TEST_PATH).cast("double"), low.rlike(_CUES).cast("double"), low.rlike(_AGAINST).cast("double"),
        before.rlike(r"[:=]\s{0,3}[\"']?$").cast("double"), before.rlike("[\"']$").cast("double"), tail.rlike(_CUES).cast("double"), tail.rlike(_AGAINST).cast("double")]
    return F.concat(F.array(*[x.cast("double") for x in values]), _near(before, True), _near(after, False))


def certain(v: Column, before: Column) -> Column:
    """1 or 0 where form and neighbourhood leave no doubt, else NULL.

    A known provider's form, or a value of letters and other characters of a
    field that is named after a secret, is a secret, and so is a quoted pass
    phrase. Numbers, words, runs of few characters and what is named as a
    checksum are not, unless a field named after a secret leaves them in doubt.
    """
    low = F.lower(before)
    varied = F.size(F.array_distinct(F.split(v, ""))) >= 8
    words = F.length(F.regexp_replace(F.lower(v), _WORDS, "")) <= 0.5 * F.length(v)
    plain = v.rlike("^[0-9+/_=-]+$") | ~varied | words | v.rlike(r"^[A-Za-z][a-z]*\W{0,2}$")
    quoted = low.rlike(rf"{_FIELD}[\"']$")
    bare = low.rlike(rf"{_FIELD}$")
    mixed = v.rlike(r"^\S*$") & v.rlike("[A-Za-z]") & v.rlike("[^A-Za-z]") & ~words & (varied | (F.length(v) < 16))
    phrase = low.rlike(rf"(?:pass[ _-]?phrase|passw|pwd)[a-z0-9_-]{{0,20}}[\"']?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}[\"']$") & varied & ~words & v.rlike("[A-Za-z]")
    return (F.when(v.rlike(_KNOWN), F.lit(1.0)).when((quoted & mixed) | phrase | (bare & mixed & v.rlike("[0-9]") & (F.length(v) >= 16)), F.lit(1.0))
            .when(plain & ~quoted & ~low.rlike(rf"{_FIELD}(?<==\s{{0,3}})$"), F.lit(0.0))
            .when(quoted | bare, F.lit(None).cast("double")).when(low.rlike(rf"(?:{_AGAINST})\W{{0,4}}$"), F.lit(0.0)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, words: list[str] | None = None) -> DataFrame:
    """id, key (of the text), start, end, features, certain: a stored row for each candidate, in code points, end exclusive.

    `words` is the dictionary that may cover a candidate, that of `docs` if none is given.
    """
    words = dictionary(docs, text_col) if words is None else words
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("key"), path.alias("path"), text_or_empty(f"`{text_col}`").alias("text"))
    found = own.select("id", "key", "path", F.explode(find_all(F.col("text"), CANDIDATE, BEFORE, AFTER)).alias("m"))
    return store(found.select("id", "key", F.col("m.start").alias("start"), F.col("m.end").alias("end"),
                              _features(F.col("m.value"), F.col("m.before"), F.col("m.after"), F.col("path"), words).alias("features"),
                              certain(F.col("m.value"), F.col("m.before")).alias("certain")))


def train(labelled: DataFrame, forest: Forest = Forest()) -> RandomForestClassificationModel | float:
    """A forest for `labelled` (features, label 0.0 or 1.0); the only label as a number where there is but one, 0.0 for none.

    At most `max_train` findings of each label are used, chosen by a hash of
    their features; the rarer label weighs as much as the other.
    """
    rows = labelled.filter("label IS NOT NULL").select("features", "label")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return next(iter(n), 0.0)
    parts = [rows.filter(F.col("label") == x).orderBy(F.xxhash64("features"), "features").limit(forest.max_train) for x in (0.0, 1.0)]
    used = {x: min(n[x], forest.max_train) for x in n}
    weight = F.when(F.col("label") == 1.0, F.lit(used[0.0] / used[1.0])).otherwise(F.lit(1.0))
    sample = store(parts[0].unionByName(parts[1]).select(array_to_vector("features").alias("features"), "label", weight.alias("weight")))
    return RandomForestClassifier(numTrees=forest.trees, maxDepth=forest.depth, seed=forest.seed, weightCol="weight", featureSubsetStrategy="onethird").fit(sample)


def score(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """`found` with `score`, the probability that a candidate is a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    voted = model.transform(found.withColumn("__vector", array_to_vector("features")).withColumnRenamed("features", "__own").withColumnRenamed("__vector", "features"))
    return voted.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("__own", "features")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, labelled: DataFrame | None = None,
         forest: Forest = Forest()) -> DataFrame:
    """One row for each candidate: id, start, end, score, is_secret.

    `labelled` (features, label) trains the forest; without it, the candidates
    that `certain` decides. Where only one label occurs, it is the score. A NULL or empty text has no candidates; repeated
    rows each have theirs. Other columns are not read.
    """
    return _scored(docs, id_col, text_col, path_col, labelled, forest).select(F.col("id").alias(id_col), "start", "end", "score", (F.col("score") >= 0.5).alias("is_secret"))


def _scored(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, labelled: DataFrame | None, forest: Forest) -> DataFrame:
    found = candidates(docs, id_col, text_col, path_col)
    model = train(found.select("features", F.col("certain").alias("label")) if labelled is None else labelled, forest)
    return score(found, model)


def _redacted(text: Column, spans: Column) -> Column:
    """`text` with each of the sorted spans (start, end) replaced by MARK."""
    def piece(s: Column, i: Column) -> Column:
        low = F.when(i > 0, spans[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, low + 1, s["start"] - low), F.lit(MARK))

    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    return F.concat(F.array_join(F.transform(spans, piece), ""), tail)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, length_col: str | None = None,
           labelled: DataFrame | None = None, forest: Forest = Forest()) -> DataFrame:
    """`docs` with every secret replaced by MARK, and `length_col`, if named, set to the new number of characters.

    Rows without secrets and all other columns stay as they are.
    """
    secrets = _scored(docs, id_col, text_col, path_col, labelled, forest).filter("score >= 0.5")
    # a document's spans are part of one text; rows that repeat id and text have equal spans
    lists = store(secrets.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans")).withColumn("__hash", F.xxhash64("__key")))
    rows = packed(docs, docs[f"`{id_col}`"].alias("__doc"), text_key(text_col).alias("__own"))
    # only rows whose text may hold a secret are shuffled
    test = sieve(lists, "__hash", in_lambdas=False)(F.xxhash64("__own"))
    near = rows.filter(test).join(lists, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left").select("__row", "__spans")
    far = rows.filter(~test).select("__row", F.lit(None).cast(lists.schema["__spans"].dataType).alias("__spans"))
    rows = far.unionByName(near)
    text = F.when(F.col("__spans").isNull(), F.col(f"__row.`{text_col}`")).otherwise(
        let(F.col("__spans"), lambda s: _redacted(F.col(f"__row.`{text_col}`"), s)))
    rows = rows.withColumn("__text", text)

    def column(f: T.StructField) -> Column:
        own = F.col(f"__row.`{f.name}`")
        if f.name == text_col:
            return F.col("__text").alias(f.name)
        if f.name == length_col:
            return F.when(F.col("__spans").isNull(), own).otherwise(F.length("__text").cast(f.dataType)).alias(f.name)
        return own.alias(f.name)

    return rows.select(*[column(f) for f in docs.schema.fields])
