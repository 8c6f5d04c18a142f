"""Operator 4, approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Nearness is the inner product. A vector x gets one more component, ``sqrt(M * M - |x| * |x|)`` with M the greatest norm of all, a query a zero there;
the nearest vector by distance is then the one of the largest inner product. On a bounded sample (at most about ``sample`` rows, those with
the least hash of the id) k-means is run, and run again in each cluster, until there are about ``leaves`` leaves. Every row of the table is
put into the leaf that it reaches by going down to the nearest child.

A query walks the tree with a priority queue that holds the open branches by their distance from the query and visits the leaves as they come out.
How many leaves are visited is calibrated: for a bounded number of queries the exact neighbours are found among all rows, and visits are widened until
the mean share found reaches ``recall``.

Search joins queries and rows by (leaf, block): blocks of a leaf, and of the queries that visit it, hold about BLOCK rows, so that no task
gathers a leaf that holds a third of all rows. A block pair returns its k best rows of each query. Of equal vectors only the k + 1 least ids can be
among the k nearest of any query; the others are left out before the search, which changes no result.

Scores are sums in double precision in one fixed order, so that equal vectors have equal scores; ties go to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do those of another length than most;
rows that repeat id and vector count once; a query leaves out every row of its own id; fewer candidates than k give fewer rows; a null id is no query
and no candidate; without vectors the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store

SAMPLE = 20_000
LEAVES = 256
BRANCHES = 16
CALIBRATION = 128
RECALL = 0.96
BLOCK = 4096
_MARGIN = 1e-9

_PAIRS = "query_id long, vec_id long, score double, leaf int"


# --- the tree ----------------------------------------------------------------------------------------------------------


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the place of each point's centre; empty centres are dropped."""
    centres = points[rng.choice(len(points), k, replace=False)]
    at = None
    for _ in range(rounds):
        new = _nearest(points, centres)
        if at is not None and (new == at).all():
            break
        at = new
        used = np.unique(at)
        centres = np.stack([points[at == c].mean(0) for c in used])
        at = np.searchsorted(used, at)
    return centres, at


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


class Tree:
    """Nodes by number, 0 the root: centres of the children, their numbers, and the leaf number of each node (-1 if it is none)."""

    def __init__(self, points: np.ndarray, leaves: int, branches: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        least = max(1, len(points) // max(leaves, 1))
        waiting = [(self._node(), points)]
        while waiting:
            node, own = waiting.pop()
            k = min(branches, -(-len(own) // least))
            if k > 1 and len(own) > k and (own != own[0]).any():
                centres, at = _kmeans(own, k, rng)
                if len(centres) > 1:
                    self.centres[node] = centres
                    self.children[node] = [self._node() for _ in centres]
                    waiting += [(child, own[at == i]) for i, child in enumerate(self.children[node])]
                    continue
            self.leaf[node] = self.leaves
            self.leaves += 1

    def _node(self) -> int:
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out, waiting = np.empty(len(points), np.int32), [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            else:
                at = _nearest(points[rows], self.centres[node])
                waiting += [(child, rows[at == i]) for i, child in enumerate(self.children[node]) if (at == i).any()]
        return out

    def visits(self, point: np.ndarray, most: int, sizes: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """Leaves in the order in which the priority queue gives them out: ``most``, and more until they hold ``enough`` rows by their ``sizes``."""
        queue, out, met = [(0.0, 0)], [], 0
        while queue and (len(out) < most or met < enough):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                met += 0 if sizes is None else int(sizes[self.leaf[node]])
                continue
            gaps = self.centres[node] - point
            for distance, child in zip((gaps * gaps).sum(1).tolist(), self.children[node]):
                heapq.heappush(queue, (distance, child))
        return out


# --- vectors in and out of tasks ---------------------------------------------------------------------------------------


def usable(df: DataFrame, vector: str) -> Column:
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    """Rows of doubles from an Arrow list column or a series of raw bytes."""
    if isinstance(column, pd.Series):
        return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))])


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query place, row place, score) of the k best rows of each query, own ids left out."""
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        rough = part @ rows.T
        rough[query_ids[start : start + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            cut = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            cut = cut - _MARGIN * (1 + np.abs(cut))
            q, r = np.nonzero((rough >= cut[:, None]) & (rough > -np.inf))
        else:
            q, r = np.nonzero(rough > -np.inf)
        exact = (part[q] * rows[r]).sum(1)
        order = np.lexsort((ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < k
        yield q[kept] + start, r[kept], exact[kept]


# --- the operator ------------------------------------------------------------------------------------------------------


def prepared(df: DataFrame, vec_id: str, vector: str, k: int) -> DataFrame:
    """(vec_id, vector, copy): usable rows once each; ``copy`` counts equal vectors by id, and those over k + 1 are no candidates."""
    rows = df.where(usable(df, vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    return rows.distinct()


def nearest(
    df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, leaves: int = LEAVES,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``df`` for which ``is_query`` (over ``vec_id``) holds."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = prepared(df, vec_id, vector, k)
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return empty
    rows = store(rows.where(F.size("vector") == lengths["d"]), "vectors")
    copies = W.partitionBy("vector").orderBy("vec_id")
    candidates = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("m")).first()
    norm = float(np.sqrt(facts["m"]))

    share = min(1.0, sample / facts["n"])
    picked = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    points = np.array([r["vector"] for r in rows.where(picked).select("vec_id", "vector").orderBy("vec_id").collect()])
    if not len(points):
        points = np.array([rows.orderBy("vec_id").first()["vector"]])
    tree = Tree(_lifted(points, norm), leaves, BRANCHES)
    shared = spark.sparkContext.broadcast(tree)  # its size is bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(_matrix(batch.column(1)))
                raw = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(raw, pa.binary()), pa.array(shared.value.place(_lifted(x, norm)))], names=["vec_id", "raw", "leaf"]
                )

    index = store(candidates.select("vec_id", "vector").mapInArrow(place, "vec_id long, raw binary, leaf int"), "index")
    queries = rows.where(is_query)
    visits = _calibrate(index, queries, tree, norm, k, recall)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    # a query's own rows are no answers to it
    own = index.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))
    queries = queries.join(own, "vec_id", "left").select("vec_id", "vector", F.coalesce("own", F.lit(0)).alias("own"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(_matrix(batch.column(1)))
                need = (k + batch.column(2).to_numpy()).tolist()
                seen = [shared.value.visits(p, visits, sizes, n) for p, n in zip(np.column_stack([x, np.zeros(len(x))]), need)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(seen, pa.list_(pa.int32()))],
                    names=["query_id", "query", "leaves"],
                )

    asked = store(queries.mapInArrow(walk, "query_id long, query binary, leaves array<int>"), "queries")
    asked = asked.select("query_id", "query", F.explode("leaves").alias("leaf"))
    # one row per leaf: bounded by the tree
    row_blocks = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("row_blocks"))
    query_blocks = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_blocks"))
    blocks = F.broadcast(store(row_blocks.join(query_blocks, "leaf"), "blocks"))

    def dealt(frame: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        block = F.pmod(F.xxhash64(key, F.lit("block")), F.col(f"{own}s")).cast("int").alias(own)
        return frame.join(blocks, "leaf").select(*frame.columns, block, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))

    left = dealt(index, "vec_id", "row_block", "query_block").groupBy("leaf", "row_block", "query_block")
    right = dealt(asked, "query_id", "query_block", "row_block").groupBy("leaf", "row_block", "query_block")

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "leaf": []})
        ids, query_ids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        found = list(_best(_matrix(queries["query"]), query_ids, _matrix(rows["raw"]), ids, k))
        q, r, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": score, "leaf": np.int32(rows["leaf"].iloc[0])})

    hits = left.cogroup(right).applyInPandas(search, _PAIRS)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def _calibrate(index: DataFrame, queries: DataFrame, tree: Tree, norm: float, k: int, recall: float) -> int:
    """The fewest visits that find ``recall`` of the exact neighbours of CALIBRATION queries among all rows."""
    chosen = queries.orderBy(F.xxhash64("vec_id", F.lit("calibrate")), "vec_id").limit(CALIBRATION).collect()
    if not chosen:
        return 1
    x, ids = np.array([r["vector"] for r in chosen]), np.array([r["vec_id"] for r in chosen])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, rows = batch.column(0).to_numpy(), _matrix(batch.column(1).to_pandas())
            leaf = batch.column(2).to_numpy()
            for q, r, score in _best(x, ids, rows, own, k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[r]), pa.array(score), pa.array(leaf[r])], names=["query_id", "vec_id", "score", "leaf"])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = index.mapInArrow(exact, _PAIRS).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()
    step = {int(i): {leaf: n for n, leaf in enumerate(tree.visits(np.append(v, 0.0), tree.leaves))} for i, v in zip(ids, x)}
    places = np.sort([step[r["query_id"]][r["leaf"]] for r in true])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else 1
