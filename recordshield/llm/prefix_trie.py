"""Operator 11, conversation prefix trie by van Emde Boas recursion.

A node of depth d is a distinct sequence of the first d turns (role, text) of some conversations, its members. Sequences are cut at half their depth, the
largest power of two: the prefixes up to the cut are named, and the trie above the cut and the forests below it, whose roots are the names, are cut in
the same way, all of one size in the same round. So there are as many rounds as the greatest depth has binary digits:

- names of blocks of 1, 2, 4, ... turns, each from its two halves; then, from the longest block down, the name of a cut is that of its root and that of the block
  between them. Names are 128-bit hashes, so no numbering has to be agreed on between tasks.
- totals: a root of a forest of 2^j levels, with its own value and those of the forests grafted below it, goes to the root of the forest it is in, from the shortest
  forests up. Then, from the longest down, what the forests below a cut add up to is attached to the leaf of the upper trie they hang on, and each
  attached sum goes on to the leaf of the upper half of that trie, added up where leaves meet. Every node ends up with all that lies below it, though each
  round moves only nodes at every 2^j-th depth.

Every look-up is by (conversation, depth), of which there is one row, so that no join has a hot side but the last one, which asks a parent for its
number; sums are pre-aggregated by Spark. A conversation of any length is spread by position. The digest of a node's conversations is fed by one task
in the order of their ids, from slices of bounded size: memory stays constant, as the hash has to see all bytes in turn.

Defined cases: rows without conv_id take no part; null role or text is empty; turns order by number, null first, and equal numbers by a hash of role and text, so that equal
rows are interchangeable; each row is a turn of its own, also if it repeats another; conversations without turns are members of the root only; a table without conversations
has no node; other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import discard, store, store_at
from .common import words

#: Turns of a conversation that share one row of a look-up; bytes of a slice of ids.
SPREAD, SLICE = 1024, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def _name(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, key, words): the turns of each conversation in order, from 0; the key stands for role and text."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    key = _name(F.octet_length(by).cast("string").cast("binary"), F.lit(":").cast("binary"), by.cast("binary"), said.cast("binary"))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), key.alias("key"), F.size(words(said)).cast("long").alias("words")
    )
    return number_rows(rows, [F.col("turn").asc_nulls_first(), "key"], "pos", 0, ["conv"]).drop("turn")


def rebuild(own: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, at, key, words), and (conv, length).

    Conversation c starts with the first h = crc32(c) % ``most`` turns of c - c % ``family`` and goes on with its own turns after its first h.
    """
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("of_base")), "base", "left")
    taken = F.least("h", F.coalesce("of_base", F.lit(0))).alias("taken")
    convs = store(convs.select("conv", "n", "h", "base", taken), "conversations")
    starts = own.where(F.col("pos") < most - 1).select(F.col("conv").alias("base"), F.col("pos").alias("at"), "key", "words")
    starts = starts.join(convs.select("conv", "base", "h"), "base").where(F.col("at") < F.col("h")).select("conv", "at", "key", "words")
    # one row for so many turns: the join has no hot key, however long a conversation is
    spread = convs.select("conv", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SPREAD}"))).alias("spread"))
    rest = own.withColumn("spread", F.expr(f"pos div {SPREAD}")).join(spread, ["conv", "spread"]).where(F.col("pos") >= F.col("h"))
    rest = rest.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("at"), "key", "words")
    lengths = convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return store(starts.unionByName(rest), "turns"), lengths


def blocks(sequences: DataFrame, levels: int) -> list[DataFrame]:
    """Per level j (conv, block, name, words): the whole blocks of 2^j turns, and the words of a block's last turn."""
    out = [sequences.select("conv", F.col("at").alias("block"), F.col("key").alias("name"), "words")]
    right = F.col("block") % 2 == 1
    for j in range(1, levels):
        halves = out[-1].groupBy("conv", F.expr("block div 2").alias("block")).agg(
            F.max(F.when(~right, F.col("name"))).alias("left"), F.max(F.when(right, F.col("name"))).alias("right"), F.max(F.when(right, F.col("words"))).alias("words")
        )
        whole = halves.where(F.col("left").isNotNull() & F.col("right").isNotNull())
        out.append(store(whole.select("conv", "block", _name(F.col("left"), F.col("right")).alias("name"), "words"), f"blocks-{j}"))
    return out


def prefixes(lengths: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """(conv, at, name, words): the name of every prefix, from the cuts at the longest blocks down to single turns."""
    root = F.unhex(F.md5(F.lit("").cast("binary")))
    found = [store(lengths.select("conv", F.lit(0).cast("long").alias("at"), root.alias("name"), F.lit(0).cast("long").alias("words")), "prefixes")]
    for j in reversed(range(len(parts))):
        roots = reduce(DataFrame.unionByName, found).select("conv", F.col("at").alias("root"), F.col("name").alias("above"))
        below = parts[j].where(F.col("block") % 2 == 0).select("conv", (F.col("block") * (1 << j)).alias("root"), "name", "words")
        cut = roots.join(below, ["conv", "root"])
        found.append(store(cut.select("conv", (F.col("root") + (1 << j)).alias("at"), _name(F.col("above"), F.col("name")).alias("name"), "words"), f"prefixes-{j}"))
    return reduce(DataFrame.unionByName, found)


def subtree_sums(nodes: DataFrame, names: DataFrame, levels: int, values: Sequence[str]) -> DataFrame:
    """(name, values): for every node that has others below it the sums over those, of ``nodes`` (name, at, conv, parent, values).

    ``names`` is (conv, at, name) of all prefixes; ``conv`` may be any member of a node.
    """
    sums = [F.sum(v).alias(v) for v in values]
    place = [F.min("conv").alias("conv"), F.min("at").alias("at")]

    def above(rows: DataFrame, by: int) -> DataFrame:
        """Each row at the node ``by`` levels up."""
        moved = rows.select("conv", (F.col("at") - by).alias("at"), *values)
        return moved.join(names, ["conv", "at"]).select("name", "at", "conv", *values)

    def lowest(j: int) -> Column:
        return F.col("at") % (1 << (j + 1)) == (1 << j)

    grafted: list[DataFrame] = []
    hung = []
    for j in range(levels):
        own = nodes.where(lowest(j))
        total = reduce(DataFrame.unionByName, [own.select("name", "at", "conv", *values), *[g.where(lowest(j)) for g in grafted]])
        total = store(total.groupBy("name").agg(*place, *sums), f"roots-{j}")
        grafted.append(store(above(total, 1 << j).groupBy("name").agg(*place, *sums), f"grafted-{j}"))
        parents = own.select(F.col("name").alias("of"), "parent")
        hung.append(total.join(parents, total["name"] == parents["of"]).select(F.col("parent").alias("name"), (F.col("at") - 1).alias("at"), "conv", *values))
    found: list[DataFrame] = []
    for j in reversed(range(levels)):
        passed = [above(reduce(DataFrame.unionByName, found), 1 << j)] if found else []
        rows = reduce(DataFrame.unionByName, [hung[j], *passed])
        found.append(store(rows.groupBy("name").agg(*place, *sums), f"attached-{j}"))
    return reduce(DataFrame.unionByName, found).select("name", *values)


def digest_members(rows: DataFrame) -> DataFrame:
    """(name, digest): SHA-256 of the comma-joined ``conv`` of each ``name`` in ascending order, from (name, conv)."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, held, size, n = TaskContext.get().partitionId(), None, [], 0, 0
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary())
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["name", "part", "n", "ids"])
            out.clear()
            return made

        for batch in batches:
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (own != name or size > SLICE):
                    out.append((name, part, n, ",".join(held).encode()))
                    held, size, n = [], 0, n + 1
                    if len(out) >= 256:
                        yield batch_of()
                name = own
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            out.append((name, part, n, ",".join(held).encode()))
        if out:
            yield batch_of()

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, names, digests = None, None, [], []
        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != name:
                    if state:
                        names.append(name)
                        digests.append(state.hexdigest())
                    name, state = own, hashlib.sha256(ids.as_py())
                else:
                    state.update(b"," + ids.as_py())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["name", "digest"])
                names, digests = [], []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "digest"])

    ordered = rows.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    # the bounds of a range partitioning must not be drawn twice
    cut = store(ordered.mapInArrow(slices, "name binary, part int, n long, ids binary"), "ends")
    fed = cut.repartition("name").sortWithinPartitions("name", "part", "n").select("name", "ids")
    return fed.mapInArrow(feed, "name binary, digest string")


def prefix_trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` is (conv, at, key, words) with ``at`` gapless from 0, ``lengths`` (conv, length) of all conversations, those without turns too.
    """
    greatest, first = lengths.agg(F.max("length"), F.min("conv")).first()
    levels = int(greatest or 0).bit_length()
    prefix = prefixes(lengths, blocks(sequences, levels) if levels else [])
    names = prefix.select("conv", "at", "name")
    nodes = prefix.groupBy("at", "name").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    up = names.select("conv", (F.col("at") + 1).alias("at"), F.col("name").alias("parent"))
    nodes, plain = store_at(nodes.join(up, ["conv", "at"], "left"), "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0)).alias("n_children")
    nodes = nodes.join(children, "name", "left").select(
        "name", "at", "conv", "parent", "n_convs", n_children, F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    nodes = store(nodes, "nodes")
    discard(sequences.sparkSession, plain)
    ends = digest_members(lengths.select("conv", F.col("length").alias("at")).join(names, ["conv", "at"]))
    if levels:
        below = subtree_sums(nodes, names, levels, ["leaves", "saved"])
        below = below.select("name", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        nodes = nodes.join(below, "name", "left").withColumns(
            {"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}
        )
    nodes = nodes.join(ends, "name", "left")
    # nodes right below the root know its number; the others ask
    numbers = nodes.where(F.col("at") > 0).select(F.col("name").alias("above"), F.col("conv").alias("of_parent"))
    asked = nodes.where(F.col("at") > 1).join(numbers, F.col("parent") == F.col("above"))
    top = nodes.where(F.col("at") <= 1).withColumn("of_parent", F.when(F.col("at") == 1, F.lit(first).cast("long")))
    return top.unionByName(asked.drop("above")).select(
        F.col("conv").alias("conv_id"),
        F.col("at").alias("depth"),
        F.col("of_parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"),
    )
