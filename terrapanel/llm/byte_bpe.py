"""Byte-level BPE encoding and decoding over Arrow batches.

A byte-level vocabulary spells each of the 256 bytes as one printable
character, so that a text tokenizer can merge bytes. The tokenizer is built from
a file of ranks with the tokenizers library. Each distinct match of the split
pattern goes through it once for a worker's cache; texts are then put together
from their matches, which gives the ids of encoding the whole text, because
merges never cross a match.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer
from tokenizers import models, pre_tokenizers

from terrapanel.llm.common import map_arrow, slices, text_or_empty

CACHE = 300_000  # matches a worker remembers; it starts again when full, which changes no result


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next unused from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def build_tokenizer(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizer that joins the neighbours whose union has the lowest rank, within each match of `pattern`."""
    chars = byte_characters()
    spell = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(spell[token[:i]], spell[token[i:]]) for token in sorted(ranks, key=ranks.get)
              for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    t = Tokenizer(models.BPE({spell[k]: v for k, v in ranks.items()}, merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@lru_cache(2)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id; none for ids that the file leaves out."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    """The bytes that packed ids stand for; ids outside the vocabulary stand for none."""
    own = np.frombuffer(ids, "<u4")
    if own.size and int(own.max()) >= len(table):
        own = own[own < len(table)]
    return b"".join(map(table.__getitem__, own.tolist()))


class Encoder(dict):
    """Ids of texts as packed little-endian unsigned 32-bit integers; keeps those of each match of the pattern it has met."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.model = build_tokenizer(read_ranks(path), pattern).model
        self.find = regex.compile(pattern).findall
        self.lengths = np.array([len(b) for b in byte_table(path)], np.int64)

    def __missing__(self, match: str) -> bytes:
        # a match is what the tokenizer's splitter hands to its model, once spelled in byte characters
        ids = [t.id for t in self.model.tokenize("".join(map(byte_characters().__getitem__, match.encode())))]
        if len(self) >= CACHE:
            self.clear()
        out = self[match] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, self.find(t))) for t in texts]

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, first character, end character) of each token.

        A character that several tokens share belongs to each of them.
        """
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
        return starts, char_of[starts], char_of[ends - 1] + 1


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, pattern)
    for batch in batches:
        for part in slices(batch, 1):
            texts = part.column(1).to_pylist()
            ids = enc.encode(texts)
            out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = [batch.schema.names[0], "n_tokens", "ids"]
            if offsets:
                found = [enc.offsets(t, x) for t, x in zip(texts, ids)]
                for k, name in enumerate(("byte_start", "char_start", "char_end")):
                    out.append(pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(out, names)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """id, n_tokens, ids (packed little-endian unsigned 32-bit), with `offsets` also byte_start, char_start, char_end.

    One row for each row of `docs`, whole texts; NULL counts as empty and an
    empty text has no ids. No special tokens: their spelling is ordinary text.
    Characters are code points. Other columns are not read.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    fields = [T.StructField("id", own.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("byte_start", "char_start", "char_end")]
    out = map_arrow(own, partial(_encode, path=ranks_path, pattern=pattern, offsets=offsets), T.StructType(fields))
    return out.withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], path: str, text: bool) -> Iterator[pa.RecordBatch]:
    table = byte_table(path)
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1):
            raw = [decode_ids(x or b"", table) for x in part.column(batch.num_columns - 1).to_pylist()]
            out = [*part.columns[:-1], pa.array(raw, pa.binary())]
            if text:  # whole texts are put together first, so characters split between tokens are whole again
                out[-1] = pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "decoded"])


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", text: bool = True) -> DataFrame:
    """`tokens` with `ids_col` replaced by `decoded`: the text, or with text=False its bytes.

    Ids cut in the middle of a character leave a replacement character in the
    text; the bytes hold exactly what the ids stand for. NULL ids give an empty text.
    """
    keep = [c for c in tokens.columns if c != ids_col]
    # packed under plain names for the batches: the caller's may clash with `decoded`
    own = tokens.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{ids_col}`").alias("ids"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("decoded", T.StringType() if text else T.BinaryType())])
    out = map_arrow(own, partial(_decode, path=ranks_path, text=text), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "decoded")
