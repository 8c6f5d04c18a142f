"""Operator 8, SimHash near-dedup: candidates by the general pigeonhole principle.

A document's fingerprint has a bit for every bit of the hash of its word shingles, set if it is set in over half of them
(repeats count). Two documents are linked if their fingerprints differ in at most ``within`` bits; components are linked
documents.

The bits are dealt into ``m`` partitions, correlated bits together, and partition i gets a threshold t_i of its own, -1 upwards,
with ``sum(t_i) = sure - m + 1``: then a pair that differs in at most ``sure`` bits differs in at most t_i bits of some partition i. Dynamic
programming chooses the thresholds that cost least, by candidate pairs estimated from the joint counts of the bits over all
fingerprints and by the keys to be sent; m itself is chosen the same way among the given ones. A partition with t = 0 is probed by its
value, with t > 0 by the values with t of its bits left out. Every pair that shares a key is compared whole.

Where ``within`` exceeds ``sure``, pairs up to ``sure`` bits apart are found for certain and those beyond with high probability only; op8
has both at 3.

The pipeline's stage links texts, not fingerprints: bits only make candidates (pairs that agree in a partition of one of two deals, at most
STAGE_WITHIN bits apart, sizes in a ratio that allows the similarity), and nodes are linked if the Jaccard similarity of the two sets of
shingles, counted exactly, is at least STAGE_LIKENESS. Candidates join nodes to families; of each pair's group only a forest is kept. Within a family all nodes are
compared by their shingle hashes, block by block, and again only a forest of the links leaves a task: the rows grow with the nodes, not with their pairs.

Copies: documents are first reduced to distinct fingerprints. Rows of a key are gathered in lists of at most about BLOCK; a key
with more is split into blocks and each pair of blocks is a group of its own, so no list grows with the data. A group
returns links of its members to the least of their component there, never all pairs.

Defined cases: null, empty and blank texts have the fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; ids may repeat or be null (a component of null ids only has a null id); an empty table gives an empty result;
other columns pass nowhere (table) or through untouched (stage).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest, xxh128_digest

from ..operators.mapping import components
from ..session import discard, store, store_at

SEED = 42
BLOCK = 1024
#: A key costs about as much to make and send as this many comparisons.
KEY_COST = 1000.0

Part = tuple[tuple[int, ...], int]


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the shingles of a text in UTF-8, A-Z lowered; words are what ASCII white space separates."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash drawn from a hash; the 0-th is itself."""
    if k == 0:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes | None, size: int, lanes: int = 1) -> bytes:
    """``8 * lanes`` bytes, the highest bit first."""
    return _majority(shingle_hashes(text, size), lanes)


def _majority(hashes: np.ndarray, lanes: int) -> bytes:
    out = b""
    for k in range(lanes):
        total = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 4096):
            own = _mixed(hashes[start : start + 4096], k).astype(">u8")
            total += np.unpackbits(own.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
        out += np.packbits(2 * total > len(hashes)).tobytes()
    return out


def shingle_set_print(text: bytes | None, size: int, lanes: int) -> bytes:
    """Fingerprint of the distinct shingles, their number in 4 bytes, and 16 bytes that are equal only for equal sets."""
    hashes = np.unique(shingle_hashes(text, size))
    return _majority(hashes, lanes) + len(hashes).to_bytes(4, "big") + xxh128_digest(hashes.tobytes(), SEED)


def fingerprint_udf(size: int, lanes: int, make_one=fingerprint):
    @F.pandas_udf(T.BinaryType())
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: make_one(t, size, lanes))

    return make


# --- partitions and thresholds -----------------------------------------------------------------------------------------


def bit_counts(prints: DataFrame, lanes: int) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and per lane how many have both bits a and b: a 64 x 64 table, from all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((lanes, 64, 64)), 0
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, lanes, 8)
            for start in range(0, len(raw), 4096):
                bits = np.unpackbits(raw[start : start + 4096], axis=2).astype(np.float32)
                for k in range(lanes):
                    total[k] += bits[:, k].T @ bits[:, k]
            n += len(raw)
        if n:
            flat = np.append(total.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["cell", "n"])

    rows = prints.select("fp").mapInArrow(count, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(lanes * 64 * 64 + 1)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(lanes, 64, 64)


def deal_bits(n: int, joint: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m partitions of equal size, give or take one: each takes the bits that go most with those it has."""
    lanes = len(joint)
    width = 64 * lanes
    likeness = np.zeros((width, width))
    for k, table in enumerate(joint):
        p = table / max(n, 1)
        q = np.diag(p)
        spread = np.sqrt(np.maximum(q * (1 - q), 1e-12))
        likeness[64 * k : 64 * k + 64, 64 * k : 64 * k + 64] = np.abs((p - np.outer(q, q)) / np.outer(spread, spread))
    np.fill_diagonal(likeness, 0)
    left, parts = set(range(width)), []
    for i in range(m):
        want = width // m + (i < width % m)
        part = [max(sorted(left), key=lambda b: likeness[b, sorted(left)].sum())]
        left.remove(part[0])
        near = likeness[part[0]].copy()
        while len(part) < want:
            bit = max(sorted(left), key=lambda b: near[b])
            part.append(bit)
            left.remove(bit)
            near += likeness[bit]
        parts.append(part)
    return parts


def _agreeing(n: int, joint: np.ndarray, part: Sequence[int]) -> float:
    """The share of pairs that agree in all bits of a partition, each bit given the one before it in the same lane."""
    share, before = 1.0, {}
    for bit in part:
        lane, b = divmod(bit, 64)
        q = joint[lane, b, b] / n
        alone = q * q + (1 - q) * (1 - q)
        if lane in before:
            a = before[lane]
            qa = joint[lane, a, a] / n
            both = joint[lane, a, b] / n
            cells = (both, qa - both, q - both, 1 - qa - q + both)
            share *= min(1.0, sum(c * c for c in cells) / (qa * qa + (1 - qa) * (1 - qa)))
        else:
            share *= alone
        before[lane] = b
    return share


def plan_parts(n: int, joint: np.ndarray, sure: int, choices: Sequence[int]) -> list[Part]:
    """Partitions with their thresholds, at the least estimated cost."""
    best, chosen = math.inf, []
    pairs = n * (n - 1) / 2
    for m in choices:
        parts = deal_bits(n, joint, m)
        goal = sure - m + 1
        most = max(0, goal // m + 2)
        costs = []
        for part in parts:
            agree, own = _agreeing(max(n, 1), joint, part), {-1: 0.0}
            for t in range(most + 1):
                if math.comb(len(part), t) > 4096:
                    break
                # leaving out t bits that agree half the time doubles the agreeing pairs t times, for each choice of bits
                own[t] = n * KEY_COST * math.comb(len(part), t) + pairs * min(1.0, agree * 2**t) * math.comb(len(part), t)
            costs.append(own)
        # least cost to reach a sum of thresholds with the partitions so far; sums are counted from all at -1
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for own in costs:
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for have, (cost, taken) in table.items():
                for t, more in own.items():
                    to = have + t
                    if to not in following or cost + more < following[to][0]:
                        following[to] = (cost + more, (*taken, t))
            table = following
        if goal in table and table[goal][0] < best:
            best, thresholds = table[goal]
            chosen = [(tuple(sorted(p)), t) for p, t in zip(parts, thresholds) if t >= 0]
    return chosen


# --- keys, groups, links -----------------------------------------------------------------------------------------------


def _keys(bits: np.ndarray, parts: Sequence[Part]) -> Iterator[np.ndarray]:
    """One array of 64-bit keys per (partition, choice of left-out bits); equal keys of other choices only add comparisons."""
    weights = np.random.default_rng(SEED).integers(1, 1 << 63, size=bits.shape[1], dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        for place, (part, t) in enumerate(parts):
            own = np.array(part)
            terms = bits[:, own].astype(np.uint64) * weights[own]
            whole = terms.sum(1, dtype=np.uint64)
            for choice, gone in enumerate(combinations(range(len(own)), t)):
                left = whole - terms[:, list(gone)].sum(1, dtype=np.uint64) if gone else whole
                yield _mixed(left + np.uint64(place * 65_537 + choice + 1), 1).view(np.int64)


def probe_keys(prints: DataFrame, parts: Sequence[Part], lanes: int) -> DataFrame:
    """(key, fp): every fingerprint under each of its keys; bytes behind the ``lanes`` go along."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                piece = batch.slice(start, 2048)
                raw = np.frombuffer(b"".join(piece.column(0).to_pylist()), np.uint8).reshape(piece.num_rows, -1)[:, : 8 * lanes]
                for key in _keys(np.unpackbits(raw, axis=1), parts):
                    yield pa.RecordBatch.from_arrays([pa.array(key), piece.column(0)], names=["key", "fp"])

    return prints.select("fp").mapInArrow(probe, "key long, fp binary")


def _links(prints: list[bytes], other: list[bytes], within: int) -> list[tuple[bytes, bytes]]:
    """(member, least of its component) among all of ``prints``, or only across if there are ``other`` ones."""
    nodes = prints + other
    if len(nodes) <= 8 and not other:
        numbers = [int.from_bytes(x, "big") for x in nodes]
        near = [(a, b) for a, b in combinations(range(len(nodes)), 2) if (numbers[a] ^ numbers[b]).bit_count() <= within]
        return [(max(nodes[a], nodes[b]), min(nodes[a], nodes[b])) for a, b in near]
    nodes_order = sorted(range(len(nodes)), key=nodes.__getitem__)
    rank = np.empty(len(nodes), np.int32)
    rank[nodes_order] = np.arange(len(nodes), dtype=np.int32)
    words = np.frombuffer(b"".join(nodes), np.uint64).reshape(len(nodes), -1)
    left, right = (np.arange(len(prints)), np.arange(len(prints), len(nodes))) if other else (np.arange(len(nodes)),) * 2
    far = np.zeros((len(left), len(right)), np.uint16)
    for k in range(words.shape[1]):
        far += np.bitwise_count(words[left, k][:, None] ^ words[right, k][None, :])
    return [(nodes[i], nodes[j]) for i, j in _forest(rank, nodes_order, left, right, far <= within)]


def _forest(rank: np.ndarray, order: Sequence[int], left: np.ndarray, right: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """(member, least of its component), by place, for links between ``left`` and ``right``; ``order`` lists the places by rank."""
    label, big = rank.copy(), np.int32(len(rank))
    while True:
        new = label.copy()
        new[left] = np.minimum(new[left], np.where(near, label[right][None, :], big).min(1))
        new[right] = np.minimum(new[right], np.where(near, new[left][:, None], big).min(0))
        # a label is a node's rank: go on from that node's own label
        new = np.minimum(new, new[np.array(order)[new]])
        if (new == label).all():
            break
        label = new
    return [(i, order[label[i]]) for i in np.flatnonzero(label != rank).tolist()]


def key_groups(prints: DataFrame, parts: Sequence[Part], lanes: int) -> DataFrame:
    """(prints, other, cross): the fingerprints of a key, or two blocks of them if it has many."""
    keyed = probe_keys(prints, parts, lanes)
    hot = store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "hot-keys")
    hot = hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(hot, F.col("key") == F.col("hot_key"), "left").select(
        "key", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks")
    )
    block = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).select(
        "key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    )
    groups = placed.groupBy("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")).agg(
        F.collect_list(F.when(F.col("block") <= F.col("with"), F.col("fp"))).alias("prints"),
        F.collect_list(F.when(F.col("block") > F.col("with"), F.col("fp"))).alias("other"),
    )
    return groups.where(F.size("prints") + F.size("other") > 1).select("prints", "other", (F.col("low") != F.col("high")).alias("cross"))


def links(prints: DataFrame, parts: Sequence[Part], lanes: int, within: int) -> DataFrame:
    """(fp, least): links that join each component of near fingerprints."""
    return _compared(key_groups(prints, parts, lanes), lambda own, other: _links(own, other, within))


def _compared(groups: DataFrame, find) -> DataFrame:
    """(fp, least): what ``find(prints, other)`` finds in every group; ``other`` is empty within a block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                for own, other, cross in zip(*[piece.column(c).to_pylist() for c in ("prints", "other", "cross")]):
                    if not cross:
                        found.update(find(own, []))
                    elif own and other:
                        found.update(find(own, other))
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["fp", "least"])

    return groups.mapInArrow(compare, "fp binary, least binary")


def near_groups(prints: DataFrame, sure: int, within: int, choices: Sequence[int], lanes: int = 1) -> DataFrame:
    """(fp, root) of fingerprints that are linked to others, from distinct fingerprints ``fp``."""
    n, joint = bit_counts(prints, lanes)
    found = store(links(prints, plan_parts(n, joint, sure, choices), lanes, within).distinct(), "links")
    return components(found.select(F.array("least", "fp").alias("nodes"))).select(
        F.col("node").alias("fp"), F.col("component").alias("root")
    )


def grouped(marked: DataFrame, least, group) -> DataFrame:
    """(fp, first): for every fingerprint of ``marked`` the aggregate ``least`` over its whole component, which ``group(prints)`` finds."""
    prints = store(marked.groupBy("fp").agg(least.alias("first")), "prints")
    roots = store(group(prints), "roots")
    joined = prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = joined.where(F.col("first").isNotNull()).groupBy("root").agg(F.min("first").alias("first"))
    return store(joined.drop("first").join(firsts, "root", "left").select("fp", "first"), "groups")


def near_duplicates(
    docs: DataFrame, size: int = 3, sure: int = 3, within: int = 3, choices: Sequence[int] = (2, 3, 4), lanes: int = 1
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    make = fingerprint_udf(size, lanes)
    marked = store(docs.select("doc_id", make(F.col("text").cast("binary")).alias("fp")), "fingerprints")
    groups = grouped(marked, F.min("doc_id"), lambda prints: near_groups(prints, sure, within, choices, lanes))
    return marked.join(groups, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("first").alias("component_id"))


# --- the pipeline's stage ----------------------------------------------------------------------------------------------

#: Five-word shingles, 512 bits. At a Jaccard similarity of 0.8 a bit differs with a chance of 0.15 (0.19 in texts of a few words), so 77 bits
#: (96) do on average, with a deviation of 8 (9). The limits, from STAGE_SHORT shingles on and below, lie nearly four deviations above. They make candidates only.
STAGE_SIZE, STAGE_LANES, STAGE_SURE, STAGE_WITHIN, STAGE_SHORT = 5, 8, 31, (108, 128), 20
#: Nodes and bytes of shingle hashes in a block of a family, about.
FAMILY_BLOCK, FAMILY_BYTES = 512, 8 << 20
#: Numerator and denominator of the least Jaccard similarity of a link.
STAGE_LIKENESS = (4, 5)


def two_deals(n: int, joint: np.ndarray, m: int) -> list[Part]:
    """The bits dealt into m partitions twice, the second time so that no two bits of a partition were together the first time."""
    first = deal_bits(n, joint, m)
    across = [part[place] for place in range(max(map(len, first))) for part in first if place < len(part)]
    ends = np.cumsum([0, *map(len, first)])
    return [(tuple(sorted(p)), 0) for p in [*first, *(across[a:b] for a, b in zip(ends, ends[1:]))]]


def _ranked(nodes: Sequence[bytes]) -> tuple[np.ndarray, list[int]]:
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    rank = np.empty(len(nodes), np.int32)
    rank[order] = np.arange(len(nodes), dtype=np.int32)
    return rank, order


def _sides(own: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.arange(own), np.arange(own, own + other)) if other else (np.arange(own),) * 2


def _candidates(prints: list[bytes], other: list[bytes], lanes: int) -> list[tuple[bytes, bytes]]:
    """(member, least) of the groups of nodes that may be alike, among ``prints`` or only across if there are ``other`` ones."""
    nodes, width = prints + other, 8 * lanes
    if len(nodes) <= 8:
        numbers = [int.from_bytes(x[:width], "big") for x in nodes]
        if all((a ^ b).bit_count() > STAGE_WITHIN[1] for a, b in combinations(numbers, 2)):
            return []
    raw = np.frombuffer(b"".join(nodes), np.uint8).reshape(len(nodes), -1)
    words = np.ascontiguousarray(raw[:, :width]).view(np.uint64)
    sizes = np.ascontiguousarray(raw[:, width : width + 4]).view(">u4")[:, 0].astype(np.int64)
    left, right = _sides(len(prints), len(other))
    far = np.zeros((len(left), len(right)), np.uint16)
    for k in range(words.shape[1]):
        far += np.bitwise_count(words[left, k][:, None] ^ words[right, k][None, :])
    part, whole = STAGE_LIKENESS
    lesser, greater = np.minimum.outer(sizes[left], sizes[right]), np.maximum.outer(sizes[left], sizes[right])
    near = (far <= np.where(lesser >= STAGE_SHORT, *STAGE_WITHIN)) & (whole * lesser >= part * greater)
    rank, order = _ranked(nodes)
    return [(nodes[i], nodes[j]) for i, j in _forest(rank, order, left, right, near)]


def shingle_tables(prints: DataFrame, families: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(fp, family, hashes): the distinct shingle hashes, packed and in order, of every node that is in a family."""
    owners = prints.join(families, "fp").select("fp", "family", F.col("first.id").alias("o_id"), F.col("first.mark").alias("o_mark"))
    rows = docs.select(F.col("doc_id").alias("r_id"), F.xxhash64("text").alias("r_mark"), F.col("text").cast("binary").alias("body"))
    on = F.col("r_id").eqNullSafe(F.col("o_id")) & (F.col("r_mark") == F.col("o_mark"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                packed = [np.unique(shingle_hashes(x.as_py(), size)).tobytes() for x in piece.column(2)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(packed, pa.binary())], names=["fp", "family", "hashes"])

    # rows may repeat id and text
    return rows.join(owners, on).select("fp", "family", "body").mapInArrow(pack, "fp binary, family binary, hashes binary").dropDuplicates(["fp"])


def _alike(tables: Sequence[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the sets of ``left`` and ``right`` are as alike as STAGE_LIKENESS, counted exactly over lists of who holds a hash."""
    lengths = np.array([len(t) for t in tables])
    held, holder = np.concatenate([tables[j] for j in right]), np.repeat(np.arange(len(right)), lengths[right])
    order = np.argsort(held, kind="stable")
    held, holder = held[order], holder[order]
    part, whole = STAGE_LIKENESS
    near = np.zeros((len(left), len(right)), bool)
    for place, i in enumerate(left.tolist()):
        first, last = np.searchsorted(held, tables[i], "left"), np.searchsorted(held, tables[i], "right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(holder[at], minlength=len(right))
        near[place] = whole * shared >= part * (lengths[i] + lengths[right] - shared)
    return near


def family_links(tables: DataFrame) -> DataFrame:
    """(fp, least): links that join each component of alike nodes, from (fp, family, hashes).

    A family is cut into blocks by number and bytes; all pairs of its nodes are compared, within a block or across two, and only a forest leaves the task.
    """
    sized = tables.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK), F.ceil(F.sum(F.octet_length("hashes")) / FAMILY_BYTES)).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("n"),
    )
    placed = tables.join(sized.where(F.col("n") > 1), "family")
    block = F.pmod(F.xxhash64("fp", F.lit("family")), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).select("family", "fp", "hashes", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    node = F.struct("fp", "hashes")
    groups = placed.groupBy("family", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")).agg(
        F.collect_list(F.when(F.col("block") <= F.col("with"), node)).alias("own"), F.collect_list(F.when(F.col("block") > F.col("with"), node)).alias("other")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, other, cross = (batch.column(c)[row].as_py() for c in range(3))
                if len(own) + len(other) < 2 or (cross and not (own and other)):
                    continue
                nodes = own + other
                names, tables = [x["fp"] for x in nodes], [np.frombuffer(x["hashes"], np.uint64) for x in nodes]
                left, right = _sides(len(own), len(other))
                rank, order = _ranked(names)
                found = _forest(rank, order, left, right, _alike(tables, left, right))
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in u], pa.binary()), pa.array([names[j] for j in v], pa.binary())], names=["fp", "least"]
                    )

    return groups.select("own", "other", (F.col("low") != F.col("high")).alias("cross")).mapInArrow(compare, "fp binary, least binary")


def alike_groups(prints: DataFrame, docs: DataFrame, size: int, sure: int, lanes: int) -> DataFrame:
    """(fp, root) of the nodes that are linked to others, from distinct nodes ``fp`` with an owner ``first`` in ``docs``."""
    spark = docs.sparkSession

    def joined(found: DataFrame) -> DataFrame:
        return components(found.select(F.array("least", "fp").alias("nodes")))

    n, joint = bit_counts(prints.select(F.substring("fp", 1, 8 * lanes).alias("fp")), lanes)
    groups = key_groups(prints, two_deals(n, joint, sure + 1), lanes)
    found, listed = store_at(_compared(groups, lambda own, other: _candidates(own, other, lanes)).distinct(), "candidates")
    families, known = store_at(joined(found).select(F.col("node").alias("fp"), F.col("component").alias("family")), "families")
    tables, packed = store_at(shingle_tables(prints, families, docs, size), "shingles")
    links, _ = store_at(family_links(tables), "links")
    discard(spark, listed, known, packed)
    return joined(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def keep_one(docs: DataFrame, size: int = STAGE_SIZE, sure: int = STAGE_SURE, lanes: int = STAGE_LANES) -> DataFrame:
    """The documents without those that are alike with one of a smaller id, directly or through others; of rows that repeat id and text one stays.

    Documents without words are no copies of each other's content: they are a group of exact copies like any other.
    """
    make = fingerprint_udf(size, lanes, shingle_set_print)
    marked = store(
        docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), make(F.col("text").cast("binary")).alias("fp")), "fingerprints"
    )
    me = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    groups = grouped(marked, F.min(me), lambda prints: alike_groups(prints, docs, size, sure, lanes))
    judged = marked.join(groups, "fp").groupBy("id", "mark").agg(
        F.min(F.col("first") == me).alias("stays"), F.count(F.lit(1)).alias("rows")
    )
    judged = store(judged.where(~F.col("stays") | (F.col("rows") > 1)), "judged")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__mark"))
    on = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__mark") == F.col("mark"))
    single = rows.join(judged, on, "left_anti").select("row.*")
    repeated = rows.join(judged.where("stays"), on).dropDuplicates(["__id", "__mark"]).select("row.*")
    return single.unionByName(repeated)
