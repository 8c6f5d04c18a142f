"""Operator 5, byte-level BPE: encoding with offsets, and decoding.

A text in UTF-8 is cut by a pattern; the bytes of each piece are mapped to printable characters and merged by the BPE model of
the tokenizers library, whose vocabulary and merges are derived from a file of ranks. A merge of two tokens is listed
where the lower ranks alone bring a token down to exactly these two. Each task keeps the ids of pieces it has met in a table of bounded
size. As every byte is in exactly one token, a token's offsets are running sums of token lengths.

Decoding maps the characters of each token back to bytes. A character whose bytes lie in several tokens is put together
before the text is decoded; bytes that are no UTF-8, as from ids cut off in a character, become U+FFFD.

Defined cases: a null text is encoded like an empty one, to no ids; there are no special tokens, their strings are ordinary text;
ids outside the vocabulary raise an error; null ids decode to an empty text; equal rows give equal results; columns
that are to pass through are named by the caller, and results named like one of them are refused.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

#: Pieces a task remembers; the table is emptied when it is full.
REMEMBERED = 200_000
_SLICE_ROWS = 64


def byte_table() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, following = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(following))
            following += 1
    return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two tokens each longer token is merged from, in the order of ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            known = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            lowest, i = min(known)
            if lowest >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encoder and decoder of one vocabulary, held once per Python process."""

    def __init__(self, raw: bytes, pattern: str):
        ranks, table = read_ranks(raw), byte_table()
        spell = lambda token: "".join(table[b] for b in token)
        vocabulary = {spell(token): rank for token, rank in ranks.items()}
        merges = [(spell(a), spell(b)) for a, b in merge_list(ranks)]
        self.model = models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True)
        self.split = regex.compile(pattern).findall
        self.spelled = {b: c for b, c in enumerate(table)}
        bytes_of = {c: b for b, c in enumerate(table)}
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in vocabulary.items():
            self.bytes[rank] = bytes(bytes_of[c] for c in token)
        self.decimal = [str(i) for i in range(self.size)]
        self.known = _Pieces(self)

    def encode(self, text: str | None) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text or ""))))

    def offsets(self, ids: Sequence[int]) -> list[int]:
        """The byte at which each token begins, and behind the last one the length."""
        out = [0]
        for i in ids:
            out.append(out[-1] + len(self.bytes[i]))
        return out

    def decode(self, ids: Sequence[int] | None) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids or ()))

    def decode_text(self, ids: Sequence[int] | None) -> str:
        """Token by token, as from a stream: the bytes of an unfinished character wait for the next token."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join(decoder.decode(self.bytes[i]) for i in ids or ()) + decoder.decode(b"", True)

    def digest(self, ids: Sequence[int]) -> str:
        return sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


class _Pieces(dict):
    """Ids of a piece, made by the library where they are not known yet."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        spelled = piece.encode("utf-8", "replace").decode("latin-1").translate(self.codec.spelled)
        ids = tuple(token.id for token in self.codec.model.tokenize(spelled))
        self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def read_vocabulary(path: str) -> bytes:
    """The file of ranks, about a megabyte; it is read by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


_KINDS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "starts": ("array<int>", pa.list_(pa.int32())),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "decoded": ("string", pa.string()),
}


def encode_table(docs: DataFrame, path: str, pattern: str, results: Sequence[str], keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the ``results`` asked for.

    ids, starts (first byte of each token), n_tokens, ids_sha256 (of the decimal ids joined by a space), and, decoded again from
    the ids: decoded (text) and decoded_sha256 (of the bytes).
    """
    if set(results) & set(keep):
        raise ValueError("a result may not be named like a column that is kept")
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        make = {
            "ids": lambda ids: ids,
            "starts": lambda ids: codec.offsets(ids)[:-1],
            "n_tokens": len,
            "ids_sha256": codec.digest,
            "decoded_sha256": lambda ids: sha256(codec.decode(ids)).hexdigest(),
            "decoded": codec.decode_text,
        }
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE_ROWS):
                piece = batch.slice(start, _SLICE_ROWS)
                out: list[list] = [[] for _ in results]
                for body in piece.column(piece.num_columns - 1).to_pylist():
                    ids = codec.encode(body)
                    for column, name in zip(out, results):
                        column.append(make[name](ids))
                made = [pa.array(column, _KINDS[name][1]) for column, name in zip(out, results)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *made], names=[*keep, *results])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{r} {_KINDS[r][0]}" for r in results]])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(encode, schema)


def decode_table(tokens: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``, the text of a column of ids."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            texts = pa.array([codec.decode_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*keep, "decoded"])

    schema = ", ".join([*[f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep], "decoded string"])
    return tokens.select(*keep, F.col(ids).alias("__ids")).mapInArrow(decode, schema)
