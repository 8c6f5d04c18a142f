"""Operator 2, substring dedup: sliding spans of sentences.

A text is cut into sentences (after ``.``, ``!`` or ``?`` with white space behind, and after line ends); a sentence of more than ten words is
cut further, so that long ones can match in part. The places of these cuts follow from the words around them alone (winnowing: of every ten
neighbouring pairs of words, a cut goes after the first word of the pair with the least checksum), so that a passage is cut alike wherever
it stands, in whatever sentence it begins. From every sentence starts a span, and at every sentence ends one: the shortest run of at least
three sentences with at least fifteen words. So every sentence of a longer run lies in a span of that run: the one that starts there, or,
near the run's end, the one that ends with it. Spans are hashed (128 bits of their lower-cased words) and joined over the whole
corpus; all sentences that lie in a repeated span which is not its first (by document id, then text hash, then place) are removed.
What is left keeps its bytes; a text without removals comes back as it was.

One shuffle finds the repeats. Within a slice of some megabytes of documents only the first span of a hash is sent on; its other occurrences are
already known to repeat and leave as merged intervals. So a hash that stands in a third of all texts brings one row per
slice, not one per text. Intervals of a document meet its text by (id, text hash).

Defined cases: null and blank texts have no sentences and come back unchanged; a text all of whose sentences repeat comes back
empty, not dropped; rows that repeat id and text are one document and get the same text; equal ids with other texts are told
apart by the text hash; repeats within one text count; a null id sorts first; all other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate, chain, islice
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_SENTENCES = 3
SPAN_WORDS = 15
PIECE_WORDS = 10
#: Texts that a task looks at together.
SLICE_CHARS = 4 << 20

_END = re.compile(r"[.!?]\s+|\n\s*")
_WORD = re.compile(r"\s*\S+\s*")

_SPANS = "h1 long, h2 long, doc_id long, text_hash long, first int, last int, known boolean"


def cut_long(sentence: str) -> list[str]:
    """A sentence of more than PIECE_WORDS words in pieces of at most about as many; two neighbouring cuts are never further apart."""
    words = " ".join(sentence.lower().split()).encode("utf-8", "surrogatepass").split(b" ")
    if len(words) <= PIECE_WORDS:
        return [sentence]
    pairs = list(map(crc32, words[1:], map(crc32, words)))
    window = pairs[:PIECE_WORDS]
    value = min(window)
    cuts = [len(window) - 1 - window[::-1].index(value)]
    for last in range(PIECE_WORDS, len(pairs)):
        if pairs[last] <= value:
            value = pairs[last]
            cuts.append(last)
        elif cuts[-1] <= last - PIECE_WORDS:
            window = pairs[last - PIECE_WORDS + 1 : last + 1]
            value = min(window)
            cuts.append(last - window[::-1].index(value))
    tokens, begin, out = _WORD.findall(sentence), 0, []
    for cut in [*cuts, len(tokens) - 1]:
        out.append("".join(tokens[begin : cut + 1]))
        begin = cut + 1
    return out


def sentences(text: str | None) -> list[str]:
    """The pieces of a text; joined they are the text. Blank pieces hang on the piece before, at the start on the one behind."""
    text = text or ""
    out: list[str] = []
    begin = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        sentence = text[begin:end]
        if not sentence.strip():
            if out:
                out[-1] += sentence
                begin = end
            continue
        begin = end
        # a word takes two characters, the white space behind it included
        if len(sentence) > 2 * PIECE_WORDS:
            out += cut_long(sentence)
        else:
            out.append(sentence)
    return out if begin == len(text) else [text]


def spans(pieces: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """(first, last, hash) of the spans that start and that end at each sentence, as long as there are any, in the order of their starts."""
    keys = [" ".join(p.lower().split()).encode(errors="surrogatepass") for p in pieces]
    # words before each sentence
    before = [0, *accumulate(k.count(b" ") + 1 if k else 0 for k in keys)]
    found, end, begin = [], 0, 0
    for first in range(len(pieces)):
        while end < len(pieces) and (end - first < SPAN_SENTENCES or before[end] - before[first] < SPAN_WORDS):
            end += 1
        if end - first < SPAN_SENTENCES or before[end] - before[first] < SPAN_WORDS:
            break
        found.append((first, end))
    if not found:
        return
    starting = len(found)
    for last in range(found[0][1], len(pieces) + 1):
        while last - begin > SPAN_SENTENCES and before[last] - before[begin + 1] >= SPAN_WORDS:
            begin += 1
        if begin >= starting or found[begin][1] != last:
            found.append((begin, last))
    for first, last in sorted(found):
        yield first, last - 1, blake2b(b" ".join(keys[first:last]), digest_size=16).digest()


def _merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (doc_id, text_hash, text) in lists of about SLICE_CHARS of text, so that a task's memory does not follow the length of texts."""
    rows, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for row in zip(*[batch.slice(start, 256).column(c).to_pylist() for c in ("doc_id", "text_hash", "text")]):
                rows.append(row)
                size += len(row[2])
                if size >= SLICE_CHARS:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _batch_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
        ("known", pa.bool_()),
    ])
    for rows in _slices(batches):
        seen: dict[bytes, tuple] = {}
        known: list[tuple] = []
        # in document order, so that the first occurrence in the slice is met first
        for doc, mark, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            again = []
            for first, last, digest in spans(sentences(text)):
                at = (doc, mark, first, last)
                before = seen.setdefault(digest, at)
                if before[:3] != at[:3]:
                    again.append((first, last))
            known += [(doc, mark, a, b) for a, b in _merge(again)]
        firsts = ((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), *at, False) for d, at in seen.items())
        out = chain(firsts, ((hash((doc, mark, a)), -1, doc, mark, a, b, True) for doc, mark, a, b in known))
        # made batch by batch, never as a second list of the whole slice
        while part := list(islice(out, 50_000)):
            columns = list(zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, firsts, lasts): intervals of sentences to remove, per document that has any."""
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where(
        F.col("text").isNotNull()
    )
    found = marked.mapInArrow(_batch_spans, _SPANS)
    place = W.partitionBy("h1", "h2").orderBy("doc_id", "text_hash", "first")
    later = found.withColumn("rank", F.rank().over(place)).where((F.col("rank") > 1) | F.col("known"))
    return later.groupBy("doc_id", "text_hash").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")
    )


_KEPT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType()),
    T.StructField("removed_words", T.IntegerType()),
])


@F.pandas_udf(_KEPT)
def _cut(text: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    out = []
    for body, a, b in zip(text, firsts, lasts):
        pieces = sentences(body)
        if a is None or len(a) == 0:
            out.append((body, len(pieces), 0, 0))
            continue
        gone = _merge(list(zip(map(int, a), map(int, b))))
        kept, at = [], 0
        for first, last in gone:
            kept += pieces[at:first]
            at = last + 1
        kept += pieces[at:]
        words = sum(len(p.split()) for first, last in gone for p in pieces[first : last + 1])
        out.append(("".join(kept), len(pieces), sum(y - x + 1 for x, y in gone), words))
    return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "removed_words"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(row: the columns of ``docs``, cut: text, n_sentences, n_removed, removed_words), one row per document."""
    gone = repeated_spans(docs)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("__id"),
        F.xxhash64("text").alias("__hash"),
        F.col("text").alias("__text"),
    )
    on = rows["__id"].eqNullSafe(gone["doc_id"]) & (rows["__hash"] == gone["text_hash"])
    return rows.join(gone, on, "left").select("row", _cut("__text", "firsts", "lasts").alias("cut"))


def dedup_table(docs: DataFrame) -> DataFrame:
    """doc_id, the text that is left, and how much went."""
    return remove_repeats(docs).select("row.doc_id", "cut.text", "cut.n_sentences", "cut.n_removed", "cut.removed_words")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents with their own columns, the text replaced by what is left and ``n_chars`` brought up to date."""
    done = remove_repeats(docs)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("cut.text").alias(c))
        elif c == "n_chars":
            columns.append(
                F.when(F.col("cut.n_removed") > 0, F.length("cut.text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
            )
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return done.select(*columns)
