"""The pipeline against brute force, the registered queries against their SQL and contracts."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hard_rows import HARD

import __spark_entry__ as entry
import corpus_pipeline
from check import table
from terrapanel.llm import near_dedup, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(queries.ORACLE[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_all_are_registered():
    assert [n for n in entry.queries() if n.startswith("op")] == list(queries.QUERIES) and len(queries.QUERIES) == 13
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_toxicity_query(spark):
    got = queries.op3_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


def test_url_query_rows(spark):
    got = queries.op6_url_filter(spark, SF)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean texts, exact and near copies, toxic texts and secrets, with labels for half of them."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    rows, kind = [], {}

    def add(text, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, "en", f"src{len(rows) % 3}", len(text) if text is not None else None))

    clean = [[word() for _ in range(rnd.randint(40, 120))] for _ in range(150)]
    for c in clean:
        add(" ".join(c), "clean")
    for c in clean[:20]:
        add(" ".join(c), "copy")
    for c in clean[20:40]:
        c = list(c)
        c[rnd.randrange(len(c))] = "changed"
        add(" ".join(c), "near")
    for k in range(60):
        add(" ".join(word() for _ in range(30)) + ". you vilewort grumbag. " + " ".join(word() for _ in range(30)), "toxic")
    for k in range(10):
        add(" ".join(word() for _ in range(30)) + f' token = "{hashlib.sha1(bytes([k])).hexdigest()}" end', "secret")
    for t in (None, "", ""):
        add(t, "empty")
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(w == "toxic")) for i, w in kind.items() if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, kind


def test_stages_on_planted_cases(spark, planted):
    folder, rows, kind = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    text = {r[0]: r[1] for r in rows}
    assert set(seen["toxicity"]) == {i for i, w in kind.items() if w != "toxic"}
    best = {}
    for i in seen["toxicity"]:
        best[text[i] or ""] = max(i, best.get(text[i] or "", -1))
    assert set(seen["exact_dedup"]) == set(best.values())
    left = sorted(seen["exact_dedup"])
    sets = {i: near_dedup.shingles(text[i] or "", 5)[0] for i in left}
    gone = {b for a in left for b in left if a < b and len(sets[a]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert gone and set(seen["near_dedup"]) == set(left) - gone
    assert set(seen["secret_scan"]) == set(seen["near_dedup"])
    for i, r in seen["secret_scan"].items():
        assert ("[SECRET]" in (r.text or "")) == (kind[i] == "secret")
        assert r.text == text[i] or (kind[i] == "secret" and r.n_chars == len(r.text))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(seen["secret_scan"])


def test_run_gives_the_last_stage(spark, planted):
    got = corpus_pipeline.run(spark, planted[0])
    assert "sequence_id" in got.columns and got.count() > 100


def test_stages_take_hard_rows(spark, hard, empty, planted):
    """Of rows with equal texts the one with the largest id stays; no other row is lost."""
    left = {}
    for i, t in HARD:
        left[t or ""] = max(i if i is not None else -1, left.get(t or "", -1))
    for rows, want in ((hard, sorted(left.values())), (empty, [])):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, planted[0])
            assert docs.columns == rows.columns
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect()) == want
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, planted[0])
        assert sorted({r.doc_id if r.doc_id is not None else -1 for r in packed.select("doc_id").collect()}) == want
