"""Encoding against tiktoken, decoding against the text."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hard_rows import HARD

from terrapanel.llm import byte_bpe as B

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_characters_are_distinct_and_printable():
    chars = B.byte_characters()
    assert len(set(chars)) == 256 and all(c.isprintable() for c in chars) and chars[ord("a")] == "a" and chars[32] == "Ġ"


def test_ids_equal_the_reference_on_mixed_text(reference):
    rnd = random.Random(2)
    chars = [chr(c) for c in range(1, 0x3000)] + list("😀🏳️‍🌈日本語") + list("abc  \n\t'12.,") * 200
    texts = ["".join(rnd.choice(chars) for _ in range(80)) for _ in range(2000)] + ["", "<|endoftext|>", "it's  we'll\n\n x" * 50, "z" * 3000]
    got = B.encoder(RANKS, PATTERN).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]


def test_round_trip_of_hard_rows(hard, reference):
    tokens = B.encode(hard, RANKS, PATTERN)
    got = B.decode(tokens, RANKS).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t in HARD)
    want = {t or "": len(reference.encode_ordinary(t or "")) for _, t in HARD}
    assert all(r.n_tokens == want[r.decoded] for r in got)


def test_offsets_cover_shared_characters(spark):
    text = "añ 😀日"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = B.encode(df, RANKS, PATTERN, offsets=True).first()
    table, ids = B.byte_table(RANKS), np.frombuffer(bytes(r.ids), "<u4").tolist()
    at = 0
    for i, b, c, e in zip(ids, r.byte_start, r.char_start, r.char_end):
        assert b == at and text.encode()[b:b + len(table[i])] == table[i]
        assert len(text[:c].encode()) <= b and len(text[:e].encode()) >= b + len(table[i])
        at += len(table[i])
    assert at == len(text.encode())


def test_cut_characters_and_unknown_ids(spark):
    table = B.byte_table(RANKS)
    smile = [table.index(bytes([b])) for b in "😀".encode()]
    rows = [(1, np.array(smile[:2], "<u4").tobytes()), (2, np.array([*smile, 60000], "<u4").tobytes()), (3, None), (4, b"")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "decoded int, ids binary")
    got = [(r[0], r[1]) for r in B.decode(df, RANKS).collect()]
    assert got == [(1, "�"), (2, "😀"), (3, ""), (4, "")]
    raw = [bytes(r[1]) for r in B.decode(df, RANKS, text=False).collect()]
    assert raw[0] == "😀".encode()[:2]


def test_empty_table(empty):
    assert B.decode(B.encode(empty, RANKS, PATTERN), RANKS).count() == 0
