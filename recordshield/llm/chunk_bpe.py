"""Operator 13, BPE with word ends: encoding and decoding with reuse of content-defined chunks.

A text in UTF-8 is cut wherever a rolling hash of the last WINDOW bytes has BITS zero bits, at least LEAST bytes apart, so that a passage
is cut alike in whatever text it stands. Chunks are known by a 128-bit hash. A chunk that two different texts hold is encoded once, in the text
of the least digest that holds it, and the ids go to the others; equal texts are encoded once altogether.

Joins: a word may run over the cut, so the ids of a chunk hold only from its first to its last ASCII white space, where every text that has the
chunk splits words alike: the normaliser, the pattern and the special tokens of such a vocabulary never reach over white space. What lies
between the parts that hold is encoded anew, from white space to white space: the word at the join, or, where chunks have no white space or
are in no other text, a window that grows over them until both of its ends agree with their neighbours.

The tokenizers library encodes words (what ASCII white space separates) in batches; each task keeps the ids of words it has met in a table of
bounded size. A text travels packed, once, to the place where its chunks are known; memory follows slices of a text, not its length, except for
its bytes and its ids.

Defined cases: a null text is encoded like an empty one, to no ids; special tokens are found in the text, none are added; truncation and padding
in the vocabulary file are not used; equal rows give equal results; tables without rows give none; columns that are to pass
through are named by the caller, and results named like one of them are refused. Decoding joins the tokens as the file's decoder says, with a space where it
names none.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh3_128_digest

from ..session import discard, store_at
from .bpe import read_vocabulary

#: Bytes the rolling hash sees, zero bits at a cut, least bytes of a chunk: about 600 bytes on average.
WINDOW, BITS, LEAST = 32, 9, 128
#: Bytes of a text that are hashed or split at a time.
SLICE = 1 << 20
#: Bytes of words and ids a task remembers; the table is emptied when it is full.
REMEMBERED = 64 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
_MASK = np.uint64(((1 << BITS) - 1) << 40)
_BREAK = re.compile(rb"[ \t-\r]")
_ROWS = 64


def cuts(data: bytes) -> list[int]:
    """The bounds of the chunks of a text: 0, the cuts, its length."""
    out = [0]
    with np.errstate(over="ignore"):
        for start in range(0, len(data), SLICE):
            first = max(0, start - WINDOW + 1)
            h = _BYTES[np.frombuffer(data, np.uint8, min(start + SLICE, len(data)) - first, first)]
            step, factor = 1, _ODD
            # the hash of 2k bytes from two hashes of k
            while step < WINDOW:
                wider = h.copy()
                wider[step:] += h[:-step] * factor
                h, factor, step = wider, factor * factor, 2 * step
            for end in (np.flatnonzero((h & _MASK) == 0) + first + 1).tolist():
                if end > start and end - out[-1] >= LEAST and end < len(data):
                    out.append(end)
    return [*out, len(data)] if data else [0]


def core(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a chunk whose ids hold in every text: from its first white space to its last; empty if there are not two."""
    first = _BREAK.search(data, start, end)
    if not first:
        return start, start
    last = end - 1
    while data[last] not in b" \t\n\x0b\x0c\r":
        last -= 1
    return first.start(), last


def slices(data: bytes, start: int, end: int) -> Iterator[bytes]:
    """The bytes from start to end in pieces of about SLICE that end before white space."""
    while start < end:
        stop = min(start + SLICE, end)
        if stop < end:
            found = _BREAK.search(data, stop, end)
            stop = found.start() if found else end
        yield data[start:stop]
        start = stop


class Vocabulary:
    """Encoder and decoder of one vocabulary file, held once per Python process."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(raw.decode())
        self.library.no_truncation()
        self.library.no_padding()
        if any(_BREAK.search(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("an added token with white space in it may reach over the parts that are encoded alone")
        size = max(self.library.get_vocab(with_added_tokens=True).values(), default=0) + 1
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, data: bytes, start: int, end: int) -> Iterator[bytes]:
        """The ids of the words from start to end, packed, slice by slice."""
        for piece in slices(data, start, end):
            words = piece.split()
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            found = list(map(self.known.get, words))
            if None in found:
                fresh = list({w for w, ids in zip(words, found) if ids is None})
                made = self.library.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)
                for w, one in zip(fresh, made):
                    ids = np.array(one.ids, self.kind).tobytes()
                    self.known[w] = ids
                    self.held += len(w) + len(ids) + 200
                found = list(map(self.known.__getitem__, words))
            yield b"".join(found)

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind)

    def decode(self, ids: Sequence[int]) -> str:
        if self.library.decoder is None:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.library.decode(list(ids), skip_special_tokens=False)

    def digests(self, parts: Iterable[bytes]) -> tuple[int, bytes, bytes]:
        """Number of ids, digest of the ids in 32 bits each, digest of the text they decode to."""
        n, of_ids, of_text = 0, sha256(), sha256()
        whole: list[int] = []
        for packed in parts:
            ids = self.ids(packed)
            if not len(ids):
                continue
            of_ids.update(ids.astype("<u4").tobytes())
            if self.library.decoder is None:
                of_text.update((" " if n else "").encode() + self.decode(ids.tolist()).encode())
            else:
                whole += ids.tolist()
            n += len(ids)
        if whole:
            of_text.update(self.decode(whole).encode())
        return n, of_ids.digest(), of_text.digest()


@lru_cache(maxsize=2)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def encode_parts(codec: Vocabulary, data: bytes, shared: Iterable[tuple[int, bytes, bool]]) -> tuple[list[tuple[bytes | None, bytes]], list[tuple[bytes, bytes]]]:
    """A text as parts in order, each the hash of a chunk encoded elsewhere or packed ids; and (hash, packed ids) of the chunks encoded here.

    ``shared``: place, hash and whether to encode it here, of the chunks that other texts hold too.
    """
    bounds, parts, own, done = cuts(data), [], [], 0
    for place, digest, here in sorted(shared):
        start, end = core(data, bounds[place], bounds[place + 1])
        if start == end:
            continue
        parts.append((None, b"".join(codec.encode(data, done, start))))
        if here:
            ids = b"".join(codec.encode(data, start, end))
            own.append((digest, ids))
            parts.append((None, ids))
        else:
            parts.append((digest, b""))
        done = end
    parts.append((None, b"".join(codec.encode(data, done, len(data)))))
    return parts, own


# --- stages --------------------------------------------------------------------------------------------------------------


def chunk_table(texts: DataFrame) -> DataFrame:
    """(digest, place, chunk) of every chunk of (digest, body)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                digests, places, chunks = [], [], []
                piece = batch.slice(start, _ROWS)
                for digest, body in zip(piece.column(0).to_pylist(), piece.column(1)):
                    data = body.as_py()
                    bounds = cuts(data)
                    for place, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        if core(data, a, b)[0] != core(data, a, b)[1]:
                            digests.append(digest)
                            places.append(place)
                            chunks.append(xxh3_128_digest(data[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(places, pa.int32()), pa.array(chunks, pa.binary())], names=["digest", "place", "chunk"]
                )

    return texts.mapInArrow(cut, "digest binary, place int, chunk binary")


def shared_chunks(chunks: DataFrame) -> DataFrame:
    """(digest, shared): per text the place, hash and owner mark of its chunks that another text holds too."""
    me = F.struct("digest", "place")
    holders = chunks.groupBy("chunk").agg(F.min(me).alias("owner"), F.max("digest").alias("last"))
    holders = holders.where(F.col("owner.digest") != F.col("last")).select("chunk", "owner")
    met = chunks.join(holders, "chunk").select("digest", F.struct("place", "chunk", (F.col("owner") == me).alias("here")).alias("one"))
    # a set, as equal texts list their chunks several times
    return met.groupBy("digest").agg(F.collect_set("one").alias("shared"))


def packed_texts(texts: DataFrame) -> DataFrame:
    """(digest, packed): each distinct text once, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                packed = [press.compress(x.as_py()) for x in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(packed, pa.binary())], names=["digest", "packed"])

    return texts.mapInArrow(pack, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))


_DONE, _PART, _CHUNK = 0, 1, 2
_FINAL = "digest binary, n_tokens long, ids_digest binary, text_digest binary, ids binary"


def encode_table(docs: DataFrame, path: str, results: Sequence[str], keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the ``results`` asked for.

    ids, n_tokens, ids_sha256 (of the ids in 32 bits, little end first), and, decoded again from the ids: decoded_sha256 (of the text in UTF-8).
    """
    if set(results) & set(keep):
        raise ValueError("a result may not be named like a column that is kept")
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    with_ids = "ids" in results
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.unhex(F.md5(body)).alias("digest"), body.alias("body"))

    def final(codec: Vocabulary, parts: list[bytes]) -> tuple:
        return (*codec.digests(parts), b"".join(parts) if with_ids else None)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, unpack = _vocabulary(vocabulary.value), zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece, rows = batch.slice(start, _ROWS), []
                for digest, packed, shared in zip(piece.column(0).to_pylist(), piece.column(1), piece.column(2).to_pylist()):
                    data = unpack.decompress(packed.as_py())
                    if not shared:
                        if with_ids:
                            rows.append((_DONE, digest, None, None, *final(codec, list(codec.encode(data, 0, len(data))))))
                        else:
                            rows.append((_DONE, digest, None, None, *codec.digests(codec.encode(data, 0, len(data))), None))
                        continue
                    parts, own = encode_parts(codec, data, [(x["place"], x["chunk"], x["here"]) for x in shared])
                    rows += [(_CHUNK, None, None, chunk, None, None, None, ids) for chunk, ids in own]
                    if all(chunk is None for chunk, _ in parts):
                        rows.append((_DONE, digest, None, None, *final(codec, [ids for _, ids in parts])))
                    else:
                        rows += [(_PART, digest, n, chunk, None, None, None, ids) for n, (chunk, ids) in enumerate(parts)]
                kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                columns = zip(*rows) if rows else ((),) * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    chunks, listed = store_at(chunk_table(texts), "chunks")
    put = packed_texts(texts).join(shared_chunks(chunks), "digest", "left").select("digest", "packed", "shared")
    made, _ = store_at(put.mapInArrow(encode, _MADE), "encoded", compression="zstd")
    discard(spark, listed)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _vocabulary(vocabulary.value)
        for batch in batches:
            for row in range(batch.num_rows):
                digest, parts = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                out = (digest, *final(codec, [x["ids"] for x in parts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(out, (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["digest", "n_tokens", "ids_digest", "text_digest", "ids"],
                )

    parts = made.where(F.col("kind") == _PART)
    pool = made.where(F.col("kind") == _CHUNK).select("chunk", "ids")
    fetched = parts.where(F.col("chunk").isNotNull()).select("digest", "part", "chunk").join(pool, "chunk").select("digest", "part", "ids")
    whole = parts.where(F.col("chunk").isNull()).select("digest", "part", "ids").unionByName(fetched)
    whole = whole.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts")).mapInArrow(assemble, _FINAL)
    columns = ["digest", "n_tokens", "ids_digest", "text_digest", *(["ids"] if with_ids else [])]
    finals = made.where(F.col("kind") == _DONE).select(*columns).unionByName(whole.select(*columns))

    width = 2 if _vocabulary(vocabulary.value).kind == "<u2" else 4
    make = {
        "n_tokens": F.col("__n_tokens"),
        "ids_sha256": F.lower(F.hex("__ids_digest")),
        "decoded_sha256": F.lower(F.hex("__text_digest")),
        "ids": _unpacked(width)(F.col("__ids")) if with_ids else None,
    }
    finals = finals.select(*[F.col(c).alias(f"__{c}") for c in columns])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.unhex(F.md5(body)).alias("__key"))
    return rows.join(finals, F.col("__key") == F.col("__digest")).select(*[F.col(f"`{c}`") for c in keep], *[make[r].alias(r) for r in results])


_NAMES = ["kind", "digest", "part", "chunk", "n_tokens", "ids_digest", "text_digest", "ids"]
_MADE = "kind int, digest binary, part int, chunk binary, n_tokens long, ids_digest binary, text_digest binary, ids binary"


def _unpacked(width: int):
    @F.pandas_udf("array<int>")
    def unpack(packed: pd.Series) -> pd.Series:
        return packed.map(lambda b: np.frombuffer(b, f"<u{width}").astype(np.int32))

    return unpack


def decode_table(tokens: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``, the text of a column of ids; null ids decode to an empty text."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _vocabulary(vocabulary.value)
        for batch in batches:
            texts = pa.array([codec.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*keep, "decoded"])

    schema = ", ".join([*[f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep], "decoded string"])
    return tokens.select(*[F.col(f"`{c}`") for c in keep], F.col(ids).alias("__ids")).mapInArrow(decode, schema)
