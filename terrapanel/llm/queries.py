"""One query for each operator over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import byte_bpe, decontamination, filter_audit, packing, pii, prefix_trie, secret_scan, topk, toxicity, url_filter, warc
from terrapanel.llm.common import text_or_empty
from terrapanel.llm.exact_dedup import exact_duplicates
from terrapanel.llm.near_dedup import near_duplicates
from terrapanel.session import shared_folder


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.encode(_table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(tokens.withColumn("ids_sha256", F.sha2("ids", 256)), ranks, text=False)
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.find_pii(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", pii.base_digest(F.col("base")).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"), "n_added")


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of the labels."""
    docs = _table(spark, sf, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, _table(spark, sf, "labels").filter(~held_out))
    scored = docs.select("doc_id", toxicity.score_column(model, text_or_empty("text")).alias("t"))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "t.score",
                         (F.col("t.score") >= 0.5).cast("int").alias("predicted"), "t.toxic_sentences")


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    pages, path = _table(spark, sf, "pages"), shared_folder(spark, "warc")
    warc.write_archives(pages, path)
    key = pages.schema["page_id"].dataType
    # a gap in archives just written is a page that was not read back
    failed = F.raise_error(F.concat(F.lit("page not read back: "), F.concat_ws(" ", "archive", "start", "end", "gap"))).cast("boolean")
    return warc.read_archives(spark, path, payload=False).filter(F.when(F.col("gap").isNull(), F.lit(True)).otherwise(failed)).select(
        F.col("key").cast(key).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, sha256(h) AS payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


RULES = [url_filter.Rule("allow", "com/"), url_filter.Rule("block", "example.com/en/"), url_filter.Rule("allow", "www.example.com/en/"),
         url_filter.Rule("block", "net/es/"), url_filter.Rule("block", "net/fr/")]


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's url judged by rules, else by its host's place in the link graph."""
    return url_filter.judge(_table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every token-like string of all documents with the probability that it is a secret."""
    return secret_scan.scan(_table(spark, sf, "documents"), path_col="source")


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_duplicates(_table(spark, sf, "documents"), keep="largest")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

def op9_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of documents whose five-word shingles are at least 0.8 alike."""
    return near_duplicates(_table(spark, sf, "documents"), words=5, similarity=0.8)


def op10_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The five best inner products for every fiftieth vector."""
    return topk.top_k(_table(spark, sf, "embeddings"), F.col("id") % 50 == 0, k=5)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""


def op11_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents that lie in windows of ten words of benchmark items."""
    found = decontamination.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), length=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = """
WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS window FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS window FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lengths WHERE len(w) >= n)),
hits AS (SELECT p.r, p.i, p.n, x.item_id FROM places AS p JOIN windows AS x ON p.n = x.n AND p.window = x.window),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (r) LEFT JOIN named USING (r)"""


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes from all documents at every place of every order."""
    return filter_audit.audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


OP12_SQL = """
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
failed AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS bits FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT f.part, f.bits, count(*) AS n, sum(coalesce(m.good, 0)) AS good, sum(coalesce(m.toxic, 0)) AS toxic FROM failed AS f LEFT JOIN marks AS m USING (doc_id) GROUP BY f.part, f.bits),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l AS a, l AS b, l AS c, l AS d, l AS e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, (SELECT CAST(sum(1 << (k - 1)) AS BIGINT) FROM l WHERE c = filter_order[s]) AS own,
  coalesce((SELECT CAST(sum(1 << (k - 1)) AS BIGINT) FROM l WHERE contains(filter_order[1:s - 1], c)), 0) AS prior FROM orders, range(1, 6) AS x(s)),
shown AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER ((bits & (own | prior)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((bits & own) <> 0 AND (bits & prior) = 0), 0) AS removed,
  coalesce(sum(n) FILTER ((bits & own) <> 0 AND (bits & prior) <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER ((bits & own) <> 0 AND (bits & prior) = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER ((bits & own) <> 0 AND (bits & prior) = 0), 0) AS toxic_lost
  FROM steps, d GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM shown"""


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf, "conversations"))


# crc32 of a text of digits, bit by bit; 3988292384 is its reversed polynomial
OP13_SQL = """
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 6 AS h FROM own),
rebuilt AS (SELECT h.conv_id, list_concat(CASE WHEN b.turns IS NULL OR h.h = 0 THEN [] ELSE b.turns[1:h.h] END, h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
paths AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE turns[1:d] END AS p, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids FROM paths GROUP BY d, p),
kin AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes AS c WHERE c.d = n.d + 1 AND c.d > 0 AND CASE WHEN n.d = 0 THEN TRUE ELSE c.p[1:n.d] = n.p END) AS n_children
  FROM nodes AS n LEFT JOIN nodes AS u ON u.d = n.d - 1 AND (u.d = 0 OR n.p[1:u.d] = u.p)),
under AS (SELECT v.d, v.p, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * CASE WHEN u.d = 0 THEN 0 ELSE length(u.p[u.d].t) END) AS saved_tokens
  FROM kin AS v JOIN kin AS u ON u.d >= v.d AND (v.d = 0 OR u.p[1:v.d] = v.p) GROUP BY v.d, v.p)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM kin JOIN under USING (d, p)"""

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_winnowing": op11_winnowing,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {
    "op4_warc": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op11_winnowing": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
