"""Operator 3, sharding: jump consistent hashing.

A stable key is mapped to one of ``n`` shards by following the jumps of a generator seeded with the key; the last jump
below ``n`` is the shard. Nothing but the key and ``n`` decides, there is no ring table, and going from ``n`` to ``n + 1``
shards moves rows into the new shard only, about one in ``n + 1``. All columns are native; the generator's 64-bit product
is put together from 32-bit halves, because Spark's own product refuses to wrap around.

Defined cases: integer keys are used as they are, other keys by their ``xxhash64``; a null key counts as key 0; equal keys
share a shard whatever their number (that is the law), and their slots follow the text and then arrive in any order; a null
text has no bytes (size 1) and a null checksum; an empty table gives an empty result. Columns other than those named pass
nowhere, so clashing names cannot meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import number_rows

#: Fixed value: multiplier of the generator of jump consistent hashing.
MULTIPLIER = 2862933555777941757
_LOW32 = (1 << 32) - 1
_FIRST_STEPS = 64


def _low32_product(a: Column, c: int) -> Column:
    """The low 32 bits of a 32-bit column times a 32-bit constant, with no intermediate over 2**50."""
    low, high = c & 0xFFFF, c >> 16
    return (a * F.lit(low) + (a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)).bitwiseAND(F.lit(_LOW32))


def _jump(state: Column) -> Column:
    """One step: the state is (high and low half of the generator, last jump, next jump)."""
    high, low = state["high"], state["low"]
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _LOW32
    by_low, by_high = low * F.lit(m_low & 0xFFFF), low * F.lit(m_low >> 16)
    total = by_low + by_high.bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(by_high, 16)
    new_high = (carry + _low32_product(high, m_low) + _low32_product(low, m_high)).bitwiseAND(F.lit(_LOW32))
    far = (state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_high, 1) + 1).cast("double"))
    return F.struct(
        new_high.alias("high"),
        total.bitwiseAND(F.lit(_LOW32)).alias("low"),
        state["next"].alias("last"),
        F.floor(far).cast("bigint").alias("next"),
    )


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a bigint key."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_LOW32)).alias("low"),
        F.lit(-1).cast("bigint").alias("last"),
        F.lit(0).cast("bigint").alias("next"),
    )

    def run(state: Column, steps: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: F.when(s["next"] < shards, _jump(s)).otherwise(s)
        )

    # about ln(shards) steps are needed; the rare row that needs more than 64 goes on to the certain bound
    state = run(start, min(shards, _FIRST_STEPS))
    if shards > _FIRST_STEPS:
        from .common import let

        state = let(state, lambda s: F.when(s["next"] >= shards, s).otherwise(run(s, shards)))
    return state["last"].cast("int")


def key_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return F.col(column).cast("bigint") if isinstance(kind, T.IntegralType) else F.when(F.col(column).isNotNull(), F.xxhash64(column))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """All columns of ``df`` with ``shard`` and ``grown_shard`` (with one shard more) behind them. No shuffle."""
    number = key_number(df, key)
    return df.withColumns({"shard": jump_shard(number, shards), "grown_shard": jump_shard(number, shards + 1)})


def shard_table(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """One row per row of ``df``: key, size, checksum of the text, shards and a gapless slot from 0 within the shard.

    Slots come from :func:`number_rows`: (shard, key) is range-partitioned, so a shard, however large, is numbered by many
    tasks, and only counts per (shard, task) are added up.
    """
    body = F.col(text).cast("binary")
    facts = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(body).cast("bigint").alias("text_crc32"),
    )
    placed = assign_shards(facts, key, shards)
    return number_rows(placed, [F.col(key), F.col("size"), F.col("text_crc32")], name="slot", start=0, within=["shard"])
