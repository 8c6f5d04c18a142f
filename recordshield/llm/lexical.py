"""Operator 12, ranked lexical search: dense blocked matrix products in whole numbers.

Terms are the runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. N documents hold at least one term, L terms in all; a document has
n of them, tf of one; df documents hold a term. A term weighs ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``, a document has
``m = 75 + (25 n N) div L``, its impact at a term is ``(10^9 tf) div (1000 tf + 12 m)``, and it scores the sum of w times impact over the item's
terms, repeats included.

The items form the query set. They pass the driver in groups of at most GROUP_ITEMS items and about GROUP_TERMS (item, term) pairs, whatever their number; every
document is read once a group. In a group, documents are counted over the items' vocabulary only and stored as (document, n, terms, tf); df, N
and L are summed from all of them. Then each task lays blocks of documents out as dense tiles of impacts, with the columns that block
and item tile have in common, and multiplies them by dense tiles of item weights in float64. All entries are whole, an impact is below 10^6,
and a tile's weights add up to at most 2^53 / 10^6 an item (tiles are split by columns, a single weight into summands, until they do), so every partial sum is
exact in whatever order it is added; tiles are added up in 64 bits.

A task keeps the best k of each item: a block's documents lie in the order of their ids and are sorted stably, so ties go to the smaller id, at the border of the
list too. The lists of all tasks are cut to k in two steps, first by item and a bucket of tasks.

Defined cases: null and empty texts have no terms and do not count in N; documents that score 0 are not returned; of equal scores the smaller id comes first,
a null id last; each row of either table is a document or an item of its own, also if it repeats another; items without known terms and
empty tables give no rows; other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store

GROUP_ITEMS, GROUP_TERMS = 1 << 14, 1 << 20
#: Items, columns and documents of a tile.
TILE_ITEMS, TILE_COLUMNS, TILE_DOCS = 256, 2048, 1024
#: An impact is below this.
IMPACT = 1_000_000
WEIGHTS = (1 << 53) // IMPACT
#: Buckets of tasks in the first cut of their lists.
BUCKETS = 64
SLICE = 1 << 20
_ROWS = 64
_KEPT = {*string.ascii_letters.encode(), *string.digits.encode(), *range(128, 256)}
#: Bytes of terms, lowered; all others become a space. A character beyond ASCII has no byte below 128.
_TABLE = bytes(ord(chr(b).lower()) if b < 128 and b in _KEPT else b if b in _KEPT else 32 for b in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice."""
    data, start = data.translate(_TABLE), 0
    while start < len(data):
        stop = data.find(b" ", start + SLICE)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def item_groups(items: DataFrame, item: str, text: str) -> Iterator[tuple[list, dict[bytes, int], np.ndarray]]:
    """Groups of the query set: the items' ids, the vocabulary, and (item, column, times) of their terms."""
    ids, vocabulary, entries = [], {}, []
    for row in items.select(F.col(item), F.col(text).cast("binary")).toLocalIterator():
        counts: dict[int, int] = {}
        for part in terms(bytes(row[1] or b"")):
            for term in part:
                column = vocabulary.setdefault(term, len(vocabulary))
                counts[column] = counts.get(column, 0) + 1
        if counts:
            entries += [(len(ids), column, n) for column, n in counts.items()]
            ids.append(row[0])
        if len(ids) >= GROUP_ITEMS or len(entries) >= GROUP_TERMS:
            yield ids, vocabulary, np.array(entries, np.int64)
            ids, vocabulary, entries = [], {}, []
    if ids:
        yield ids, vocabulary, np.array(entries, np.int64)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], doc: str, text: str) -> DataFrame:
    """(doc, n, columns, tf) of every document with a term: its terms in the vocabulary, in order, as packed 32-bit numbers."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                out: list[tuple] = []
                for name, body in zip(piece.column(0).to_pylist(), piece.column(1)):
                    n, columns, times = 0, np.empty(0, np.int64), np.empty(0, np.int64)
                    for part in terms(body.as_py() or b""):
                        n += len(part)
                        met = np.fromiter(map(place, part, repeat(-1)), np.int64, len(part))
                        met, often = np.unique(met[met >= 0], return_counts=True)
                        if len(columns):
                            met, at = np.unique(np.concatenate([columns, met]), return_inverse=True)
                            often = np.bincount(at, np.concatenate([times, often])).astype(np.int64)
                        columns, times = met, often
                    if n:
                        out.append((name, n, columns.astype("<i4").tobytes(), times.astype("<i4").tobytes()))
                kinds = (batch.column(0).type, pa.int64(), pa.binary(), pa.binary())
                columns = zip(*out) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "n", "columns", "tf"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc), F.col(text).cast("binary")).mapInArrow(count, f"doc {kind}, n long, columns binary, tf binary")


def holders(counted: DataFrame, width: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                raw = b"".join(batch.column(0).slice(start, 1024).to_pylist())
                total += np.bincount(np.frombuffer(raw, "<i4"), minlength=width)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["column", "df"])

    out = np.zeros(width, np.int64)
    # as many rows as the group's vocabulary has terms
    for row in counted.select("columns").mapInArrow(add, "column int, df long").groupBy("column").agg(F.sum("df").alias("df")).collect():
        out[row["column"]] = row["df"]
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def safe_tiles(columns: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, item x column weights) whose sums an item stay within WEIGHTS and that add up to those given."""
    if not len(columns):
        return
    if len(columns) <= TILE_COLUMNS and weights.sum(1).max() <= WEIGHTS:
        yield columns, weights
    elif len(columns) > 1:
        half = len(columns) // 2
        yield from safe_tiles(columns[:half], weights[:, :half])
        yield from safe_tiles(columns[half:], weights[:, half:])
    else:
        while weights.any():
            yield columns, np.minimum(weights, WEIGHTS)
            weights = np.maximum(weights - WEIGHTS, 0)


class ItemTile:
    """The weights of up to TILE_ITEMS items over their own columns."""

    def __init__(self, first: int, entries: np.ndarray, weights: Sequence[int]):
        self.first = first
        self.size = int(entries[:, 0].max()) - first + 1
        self.columns, at = np.unique(entries[:, 1], return_inverse=True)
        self.rows, self.at = entries[:, 0] - first, at
        self.values = entries[:, 2] * np.array([weights[c] for c in entries[:, 1].tolist()], np.int64)

    def dense(self, common: np.ndarray) -> np.ndarray:
        """item x column, of the columns of ``common``, which are some of the tile's."""
        place = np.full(len(self.columns), -1)
        place[np.searchsorted(self.columns, common)] = np.arange(len(common))
        kept = place[self.at] >= 0
        out = np.zeros((self.size, len(common)), np.int64)
        out[self.rows[kept], place[self.at][kept]] = self.values[kept]
        return out


def item_tiles(entries: np.ndarray, weights: Sequence[int]) -> list[ItemTile]:
    return [
        ItemTile(first, entries[(entries[:, 0] >= first) & (entries[:, 0] < first + TILE_ITEMS)], weights)
        for first in range(0, int(entries[:, 0].max()) + 1, TILE_ITEMS)
    ]


class Block:
    """Documents, ordered by id, as impacts at the columns they hold."""

    def __init__(self, rows: Sequence[tuple[int | None, int, bytes, bytes]], n_docs: int, n_terms: int):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        self.none = np.array([r[0] is None for r in rows])
        self.ids = np.array([r[0] or 0 for r in rows], np.int64)
        held = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows]
        tf = np.concatenate([np.frombuffer(r[3], "<i4").astype(np.int64) for r in rows])
        self.doc = np.repeat(np.arange(len(rows)), [len(h) for h in held])
        # Python's numbers: the product can pass 64 bits before it is divided
        m = np.array([75 + 25 * r[1] * n_docs // n_terms for r in rows], np.int64)
        self.columns, self.at = np.unique(np.concatenate(held), return_inverse=True)
        self.impacts = (1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc])).astype(np.float64)

    def dense(self, common: np.ndarray) -> np.ndarray:
        """column x document."""
        place = np.full(len(self.columns), -1)
        place[np.searchsorted(self.columns, common)] = np.arange(len(common))
        kept = place[self.at] >= 0
        out = np.zeros((len(common), len(self.ids)))
        out[place[self.at][kept], self.doc[kept]] = self.impacts[kept]
        return out

    def scores(self, tile: ItemTile) -> np.ndarray:
        """item x document, in 64-bit numbers."""
        total = np.zeros((tile.size, len(self.ids)), np.int64)
        common = np.intersect1d(self.columns, tile.columns, assume_unique=True)
        for start in range(0, len(common), TILE_COLUMNS):
            for columns, weights in safe_tiles(common[start : start + TILE_COLUMNS], tile.dense(common[start : start + TILE_COLUMNS])):
                total += (weights.astype(np.float64) @ self.dense(columns)).astype(np.int64)
        return total


class Best:
    """The best ``k`` (score, id) of each of ``size`` items so far, highest first, ties by id; a score of 0 stands for none."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.scores, self.ids = np.zeros((size, 0), np.int64), np.zeros((size, 0), np.int64)
        self.none = np.zeros((size, 0), bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Scores item x document, of documents in the order of their ids."""
        first = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.scores = np.hstack([self.scores, np.take_along_axis(scores, first, 1)])
        self.ids = np.hstack([self.ids, ids[first]])
        self.none = np.hstack([self.none, none[first]])
        # stable sorts by the least important key first
        self._order(np.argsort(self.ids, axis=1, kind="stable"))
        self._order(np.argsort(self.none, axis=1, kind="stable"))
        self._order(np.argsort(-self.scores, axis=1, kind="stable")[:, : self.k])

    def _order(self, order: np.ndarray) -> None:
        self.scores, self.ids, self.none = (np.take_along_axis(x, order, 1) for x in (self.scores, self.ids, self.none))


def best_lists(counted: DataFrame, tiles: list[ItemTile], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score, bucket): the best of every task's documents for each item, by number."""
    shared = counted.sparkSession.sparkContext.broadcast(tiles)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(tile.size, k) for tile in shared.value]
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                piece = batch.slice(start, TILE_DOCS)
                rows = [r for r in zip(*[c.to_pylist() for c in piece.columns]) if r[2]]
                if rows:
                    block = Block(rows, n_docs, n_terms)
                    for own, tile in zip(best, shared.value):
                        own.add(block.scores(tile), block.ids, block.none)
        bucket = TaskContext.get().partitionId() % BUCKETS
        for own, tile in zip(best, shared.value):
            row, at = np.nonzero(own.scores)
            ids = pa.array(own.ids[row, at], pa.int64(), mask=own.none[row, at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + tile.first, pa.int32()), ids, pa.array(own.scores[row, at], pa.int64()), pa.array(np.full(len(row), bucket), pa.int32())],
                names=["item", "doc", "score", "bucket"],
            )

    return counted.select("doc", "n", "columns", "tf").mapInArrow(rank, "item int, doc long, score long, bucket int")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, doc: str = "doc_id", item: str = "item_id", text: str = "text"
) -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents of the highest scores for each item. Ids of documents are longs."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    out = None
    for ids, vocabulary, entries in item_groups(items, item, text):
        counted = store(count_terms(docs.select(F.col(doc).cast("long").alias(doc), text), vocabulary, doc, text), "terms")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weights = [weight(n_docs, int(df)) for df in holders(counted, len(vocabulary))]
        lists = best_lists(counted, item_tiles(entries, weights), n_docs, n_terms, k)
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        for by in (["item", "bucket"], ["item"]):
            lists = lists.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, name {kind.simpleString()}")
        # at most GROUP_ITEMS rows
        lists = lists.join(F.broadcast(names), "item").select(F.col("name").alias(item), "rank", F.col("doc").alias(doc), "score")
        out = lists if out is None else out.unionByName(lists)
    return out if out is not None else spark.createDataFrame([], f"`{item}` {kind.simpleString()}, rank int, `{doc}` long, score long")
