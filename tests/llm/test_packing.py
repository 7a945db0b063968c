"""Packing: every token placed once, no overlap, close to the fewest sequences."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from hard_rows import HARD

from terrapanel.llm import packing as K
from terrapanel.llm.common import Recent

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def laid_out(runs):
    bins, seen = {}, {}
    for length, first, last, each, start, at in runs:
        assert first == seen.get(length, 0)
        seen[length] = last
        for n in range(last - first):
            bins.setdefault(start + n // each, []).append((at + n % each * length, length))
    return bins, seen


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_all_without_gaps(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([7, 10, 64, 4096])
    counts = {rnd.randint(1, cap): rnd.randint(1, 40) for _ in range(rnd.randint(0, 25))}
    runs, n = K.plan_bins(counts, cap)
    bins, seen = laid_out(runs)
    assert seen == counts and sorted(bins) == list(range(n))
    for pieces in bins.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= cap and sum(3 * length > cap for _, length in pieces) <= 2


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    x, n = np.unique(np.clip(rng.lognormal(6.6, 1, 40_000).astype(int), 1, 4096), return_counts=True)
    _, bins = K.plan_bins(dict(zip(x.tolist(), n.tolist())), 4096)
    assert bins <= 1.002 * -(-int((x * n).sum()) // 4096)


def test_words_equal_whole_texts(reference):
    rnd = random.Random(3)
    chars = [chr(c) for c in range(1, 0x2100)] + list("abc É 's12.,<|endoftext|> \n\t") * 40
    texts = ["".join(rnd.choice(chars) for _ in range(70)) for _ in range(2000)] + ["<|endoftext|> x", "", "It's WE'LL ßÀ"]
    assert [np.frombuffer(b, "<u4").tolist() for b in K.encode_words(texts, PATH)] == [reference(t) for t in texts]


def test_hard_rows(hard, reference):
    got = K.pack(hard, PATH, capacity=256).collect()
    want = []
    for i, t in HARD:
        ids = [*reference(t or ""), 1]
        want += [(i or 0, k, b, len(ids[b:b + 256]), zlib.crc32(np.array(ids[b:b + 256], "<u4").tobytes())) for k, b in enumerate(range(0, len(ids), 256))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        assert [a for a, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 256


def test_empty_table(empty):
    assert K.pack(empty, PATH).count() == 0


def test_words_that_a_worker_remembers_stay_few():
    """However many there are, and frequent ones are not looked up again."""
    words = K._Words(PATH)
    for k in range(590_000):
        words[f"w{k}x"]
    tables = [t for t in (words, *vars(words).values()) if isinstance(t, dict)]
    assert sum(sys.getsizeof(t) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in t.items()) for t in tables) < 100e6
    made = []
    recent = Recent(lambda x: made.append(x) or x + 1, 10)
    assert all(recent[k] == k + 1 and recent[-1] == 0 for k in range(100))
    assert made.count(-1) == 1 and len(recent) + len(recent.before) <= 20
