"""WARC archives: exact round trip, and recovery around damage."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from terrapanel.llm import warc as W
from terrapanel.llm.queries import op4_warc
from terrapanel.session import shared_folder


@pytest.fixture
def pages(spark):
    rows = [(3, "http://a/1", "same " * 50), (1, "http://a/2?x=1\r\nX: y", "same " * 50), (2, None, "same " * 50), (None, "http://b", "same " * 50), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (8, "ü %41", "<p>日本語😀</p>\r\n\r\nWARC/1.1\r\n" * 30), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000), (10, "u", "x" * 300_000)]
    return spark.createDataFrame([(*r, "m", 1) for r in rows], "page_id long, url string, html string, member string, first int")


def test_round_trip(spark, pages):
    path = shared_folder(spark, "warc-test")
    W.write_archives(pages, path, records_per_file=3)
    rows = {}
    for r in W.read_archives(spark, path).collect():
        assert r.gap is None
        rows.setdefault(r.key, []).append(r)
    for p in pages.collect():
        body = (p.html or "").encode()
        r = rows[str(p.page_id) if p.page_id is not None else None][0]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(body), hashlib.sha256(body).hexdigest(), p.url)
        assert (r.payload == (p.html or "")) == (r.record_type == "response")
    kind = {k: [(r.record_type, r.refers_to) for r in v] for k, v in rows.items()}
    assert kind["1"] == [("response", None)] and kind["3"] == kind["2"] == kind[None] == [("revisit", "1")]
    assert kind["4"] == kind["5"] == kind["6"] == kind["7"] == [("response", None)]
    assert kind["9"] == [("response", None)] * 2 and kind["10"] == [("revisit", "9")]


def test_files_are_ordinary_gzip_series(spark, pages):
    path = shared_folder(spark, "warc-test")
    W.write_archives(pages, path)
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path.removeprefix('file:')}/part-*"))
    assert text.count(b"WARC-Record-ID: ") == 12


def _archive(n, packed=True):
    recs = []
    for k in range(n):
        body = f"page {k} ".encode() * 20
        rec = W.record_bytes("response", str(k), "http://x", "2024-01-01T00:00:00Z", body, hashlib.sha256(body).hexdigest(), len(body))
        recs.append(W._member(rec) + W.EMPTY_MEMBER if packed else rec)
    return recs


def _keys(data):
    return [h["warc-record-id"] for _, _, h, _ in W.salvage(data) if h is not None]


@pytest.mark.parametrize("packed", [True, False])
def test_one_damaged_record_costs_only_itself(packed):
    recs = _archive(9, packed)
    for bad in range(9):
        cut = bytearray(recs[bad])
        cut[len(cut) // 2] ^= 0xFF
        data = b"".join(recs[:bad]) + bytes(cut) + b"".join(recs[bad + 1:])
        found = list(W.salvage(data))
        gaps = [(a, b) for a, b, h, _ in found if h is None]
        start = len(b"".join(recs[:bad]))
        assert len(_keys(data)) == 8 and len(gaps) == 1
        assert gaps[0][0] == start and gaps[0][1] <= start + len(cut)


@pytest.mark.parametrize("packed", [True, False])
def test_garbage_truncation_and_empty_input(packed):
    rnd = random.Random(1)
    recs = _archive(6, packed)
    noise = bytes(rnd.randrange(256) for _ in range(5000)) + W.MAGIC + b"WARC/1.1\r\nno"
    data = noise + recs[0] + recs[1] + noise + b"".join(recs[2:5]) + recs[5][:40]
    found = list(W.salvage(data))
    assert len(_keys(data)) == 5 and found[0][:2] == (0, len(noise)) and found[-1][2] is None and found[-1][1] == len(data)
    assert sum(b - a for a, b, h, _ in found if h is None) >= 2 * len(noise) + 40
    assert list(W.salvage(b"")) == [] and list(W.salvage(W.EMPTY_MEMBER)) == []


def test_mixed_archive_in_spark_reports_gaps(spark):
    path = shared_folder(spark, "warc-test")
    df = spark.createDataFrame([(bytearray(b"".join(_archive(3)) + b"junk" + b"".join(_archive(2, False))),)], "b binary")
    df.select(F.col("b").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").text(path)
    got = W.read_archives(spark, path, payload=False).collect()
    assert len([r for r in got if r.gap is None]) == 5
    assert sorted(r.end - r.start for r in got if r.gap is not None) == [1, 4]  # the junk, and the sink's final line feed


def test_empty_table(spark, pages):
    path = shared_folder(spark, "warc-test")
    W.write_archives(pages.filter("1 = 0"), path)
    assert W.read_archives(spark, path).count() == 0


def test_long_urls_are_read_back(spark, tmp_path):
    """In archives and by the query, which fails if a page is missing."""
    urls = ["http://a/" + "x" * 200_000, "http://b/" + " %" * 50_000, "http://c/"]
    pages = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)], "page_id long, url string, html string")
    path = shared_folder(spark, "warc-test")
    W.write_archives(pages, path)
    assert {(r.gap, r.key, r.url) for r in W.read_archives(spark, path).collect()} == {(None, str(k), u) for k, u in enumerate(urls)}
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in op4_warc(spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_long_heads_in_uncompressed_archives():
    recs = [W.record_bytes("response", str(k), "http://x/" + "y" * 100_000, "d", b"p", hashlib.sha256(b"p").hexdigest(), 1) for k in range(3)]
    assert len(_keys(b"".join(recs))) == 3
    assert len(_keys(recs[0] + recs[1][:90_000] + recs[2])) == 2


def test_query_fails_on_a_page_it_wrote_and_cannot_read(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "page")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    good = W.read_archives
    monkeypatch.setattr(W, "read_archives", lambda *a, **k: good(*a, **k).withColumn("gap", F.lit("no record head")))
    with pytest.raises(Exception, match="page not read back"):
        op4_warc(spark, str(tmp_path)).collect()


def _noisy(n):
    """Records whose payloads hardly shrink, so that a cut member still has most of them."""
    rnd = random.Random(3)
    bodies = [bytes(rnd.randrange(33, 127) for _ in range(3000)) for _ in range(n)]
    return [W.record_bytes("response", str(k), "http://x", "d", b, hashlib.sha256(b).hexdigest(), len(b)) for k, b in enumerate(bodies)]


def test_one_bad_record_in_an_archive_of_one_member():
    recs = _noisy(9)
    for bad in (0, 4, 8):
        cut = bytearray(recs[bad])
        cut[-100] ^= 0x01
        data = gzip.compress(b"".join(recs[:bad]) + bytes(cut) + b"".join(recs[bad + 1:]))
        found = list(W.salvage(data))
        start = len(b"".join(recs[:bad]))
        assert len(_keys(data)) == 8
        assert [x[3] for x in found if x[2] is None] == [f"block digest differs (bytes {start} to {start + len(cut)} of the member's content)"]
        assert all(x[:2] == (0, len(data)) for x in found)


def test_a_cut_or_damaged_member_keeps_what_can_be_unpacked():
    recs = _noisy(9)
    whole, tail = gzip.compress(b"".join(recs)), W._member(recs[0])
    for cut in (len(whole) - 4, len(whole) * 2 // 3):
        kept = 9 if cut > len(whole) - 9 else 5
        for data in (whole[:cut], whole[:cut] + tail):
            found = list(W.salvage(data))
            assert len(_keys(data)) >= kept + (len(data) > cut)
            gaps = [x for x in found if x[2] is None]
            assert len(gaps) == 1 and 0 < gaps[0][0] < cut and gaps[0][1] == cut
    bad = bytearray(whole)
    bad[-6] ^= 0xFF  # checksum
    assert len(_keys(bytes(bad) + tail)) == 10
    stored = gzip.compress(b"".join(recs), 0)
    assert len(_keys(stored[:len(stored) - 2000])) == 8


def test_record_of_a_bad_member_needs_a_digest():
    plain = b"WARC/1.1\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    whole = gzip.compress(plain + _noisy(1)[0] + plain)
    bad = bytearray(whole)
    bad[-6] ^= 0xFF
    assert len(_keys(whole)) == 3 and _keys(bytes(bad)) == [f"<{W.URN}0>"]


def _foreign(block, **heads):
    lines = ["WARC/0.18", "WARC-Type: response", "WARC-Record-ID: <urn:f>", *[f"{k.replace('_', '-')}: {v}" for k, v in heads.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("name", ["sha1", "md5", "SHA-256"])
def test_digests_of_foreign_archives(name):
    body = b"HTTP/1.1 200 OK\r\n\r\nfive!"
    made = hashlib.new(name.lower().replace("-", ""), body)
    for stated in (made.hexdigest(), base64.b32encode(made.digest()).decode(), base64.b32encode(made.digest()).decode().rstrip("=")):
        rec = _foreign(body, WARC_Block_Digest=f"{name}:{stated}")
        assert len(_keys(rec)) == 1 and _keys(rec.replace(b"five!", b"fivf!")) == []


def test_payloads_and_lengths_of_foreign_archives():
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"five!").digest()).decode()
    read = lambda block: W._record(*W.parse_record(_foreign(block, WARC_Payload_Digest=sha1), 0)[1:], True)
    assert read(b"HTTP/1.1 200 OK\r\n\r\nfive!")[-1] == read(b"five!")[-1] == "five!"
    read(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nfi\r\n3;x=y\r\nve!\r\n0\r\n\r\n")
    for bad in (b"HTTP/1.1 200 OK\r\n\r\nfivf!", b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nfive!"):
        with pytest.raises(W.Damaged):
            read(bad)
