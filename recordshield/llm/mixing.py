"""Operator 9, mixing sources to target weights: Pareto order sampling.

Every document of a source is due ``target / source size`` copies. The whole part is certain: every document gets as many
copies. The rest is drawn with unequal probabilities that grow with a document's importance: p = factor * importance, with
the factor solved so that the expected words are the words due; importances whose p would reach 1 are certain and get a
whole copy more, the factor is solved for the others. These are drawn by Pareto order sampling: with u uniform in (0, 1),
documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` and taken in that order until the sample has its fixed size. The
size is measured in words, so that the taken words come to the target within half a document. u is a digest of the seed,
the document's id, the digest of its text and its number among equal rows, so reruns agree.

The order is global in a source, yet no task sorts a source: ranks fall into 65,536 buckets, bucket totals are summed by
a window of at most that many rows a source, and only rows of one bucket are sorted together. Importances are whole numbers
from 1 to 1,000, so the solution for a source is a window of at most 1,000 rows.

Defined cases: a null or blank text has size 0 and is never charged; a null source is a source, the last; null ids are told
apart by their texts; an empty table gives an empty result; repeated rows are counted first and then drawn one by one, each
with a u of its own (equal rows may change places); a source without words has target 0 and gets no copies; an importance
that is null or below 1 counts as 1, one above 1,000 as 1,000.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import store
from .common import unit, words

BUCKETS = 65_536
#: Importances are whole numbers from 1 to this.
LEVELS = 1_000
#: Repeated rows are made again from their number in pieces of so many.
PIECE = 65_536
#: The expected copies of a document are kept this far from a certain draw.
EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    Sources in code point order, null last, take the weights in turn. Targets are ``share`` of all words by weight, at most
    ``most`` times the source; the excess is shared again among the others until none is above. Each round needs two sums
    over the sources, so any number of sources is fine.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(totals, [F.col("source").asc_nulls_last()], name="place", start=0)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = store(ranked.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"] * share
    level, capped = None, None
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(float(most))
        row = ranked.agg(
            F.sum(F.when(over, F.col("source_size") * F.lit(float(most))).otherwise(0.0)).alias("held"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row["n"] == capped:
            break
        capped = row["n"]
        level = (total - row["held"]) / row["open"] if row["open"] else 0.0
        if not row["open"]:
            break
    cap = F.col("source_size") * F.lit(float(most))
    target = F.least(cap, F.col("weight") * F.lit(level)) if row["open"] else cap
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def variety(text: Column) -> Column:
    """An importance from 1 to 5: one more for every quarter of the words that are different words."""
    found = words(text)
    return F.when(F.size(found) > 0, 1 + F.floor(4 * F.size(F.array_distinct(found)) / F.size(found))).otherwise(1)


def _one_by_one(units: DataFrame) -> DataFrame:
    """Every row as often as ``__n`` says, numbered by ``__place`` from 0; a great number is dealt out in pieces."""
    many = F.col("__n") > PIECE
    pieces = units.where(many).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(PIECE).cast("bigint"))))
    pieces = pieces.repartition(*[F.col(f"`{c}`") for c in pieces.columns])
    parts = units.where(~many).withColumn("__from", F.lit(0).cast("bigint")).unionByName(pieces)
    last = F.least(F.col("__from") + PIECE, F.col("__n")) - 1
    return parts.withColumn("__place", F.explode(F.sequence("__from", last)))


def inclusion(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(__source, source_size, target, __whole, __certain, __factor, __mean, __due), one row a source.

    From importance ``__certain`` on every document has a copy for sure. The others have probability ``__factor`` times
    their importance, ``__mean`` over all their words, and ``__due`` words to be drawn.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select(
        F.col("source").alias("__source"), "source_size", "target", F.floor(rate).alias("__whole"),
        (F.col("target") - F.floor(rate) * F.col("source_size")).alias("__open"),
    )
    levels = facts.groupBy("source", "__level").agg(F.sum("size").alias("__n"))
    steps = levels.join(plan, levels["source"].eqNullSafe(plan["__source"])).drop("source")
    falling = W.partitionBy("__source").orderBy(F.col("__level").desc())
    above = F.coalesce(F.sum("__n").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("__level") * F.col("__n")).over(falling.rowsBetween(0, W.unboundedFollowing))
    # with all greater importances certain, the factor would bring this one to 1 or more
    steps = steps.withColumn("__full", (rest > 0) & (F.col("__level") * (F.col("__open") - above) >= rest))
    solved = steps.groupBy("__source", "source_size", "target", "__whole", "__open").agg(
        F.min(F.when(F.col("__full"), F.col("__level"))).alias("__certain"),
        F.coalesce(F.sum(F.when(F.col("__full"), F.col("__n"))), F.lit(0)).alias("__held"),
        F.sum(F.when(~F.col("__full"), F.col("__n"))).alias("__rest"),
        F.sum(F.when(~F.col("__full"), F.col("__level") * F.col("__n"))).alias("__weighted"),
    )
    due = F.col("__open") - F.col("__held")
    return solved.select(
        "__source", "source_size", "target", "__whole", "__certain", due.alias("__due"),
        F.when(F.col("__weighted") > 0, due / F.col("__weighted")).otherwise(0.0).alias("__factor"),
        F.when(F.col("__rest") > 0, due / F.col("__rest")).otherwise(0.0).alias("__mean"),
    )


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return p / (1 - p)


def mix(
    docs: DataFrame,
    weights: Sequence[float],
    share: float,
    most: float = 2.0,
    seed: str = "mix",
    importance: Column | None = None,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(``keep`` columns, source, size, source_size, target, copies, taken), one row per document.

    ``importance`` (a whole number from 1 to 1,000; equal for all if absent) is what the inclusion probabilities of the
    drawn part are in proportion to within a source.
    """
    level = F.lit(1) if importance is None else F.coalesce(F.least(F.greatest(importance, F.lit(1)), F.lit(LEVELS)), F.lit(1))
    units = docs.select(
        *keep,
        F.col("source"),
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        level.cast("bigint").alias("__level"),
        F.md5(F.col("text").cast("binary")).alias("__text"),
    )
    units = units.groupBy(*units.columns).agg(F.count(F.lit(1)).alias("__n"))
    digest = unit(F.lit(seed), *[F.col(c) for c in keep], F.col("__text"), F.col("__place"))
    facts = store(_one_by_one(units).select(*keep, "source", "size", "__level", digest.alias("__u")), "mix-facts")
    plan = store(inclusion(facts, source_targets(facts, weights, share, most)), "mix-plan")
    due = facts.join(plan, facts["source"].eqNullSafe(plan["__source"])).drop("__source")
    certain = F.coalesce(F.col("__level") >= F.col("__certain"), F.lit(False))
    rank = (F.col("__u") / (1 - F.col("__u"))) / _odds(F.col("__level") * F.col("__factor"))
    # within a source the bucket grows with the rank, and buckets are filled about evenly whatever the probabilities are
    scaled = rank * _odds(F.col("__mean"))
    bucket = F.least(F.floor(scaled / (1 + scaled) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    due = due.withColumns({"__sure": certain, "__rank": rank, "__bucket": bucket})
    due = due.withColumn("__charged", F.when(F.col("__sure"), 0).otherwise(F.col("size")))
    held = due.groupBy("source", "__bucket").agg(F.sum("__charged").alias("__n"))
    below = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(
        F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below")
    )
    inside = W.partitionBy("source", "__bucket").orderBy("__rank", *keep, "size").rowsBetween(W.unboundedPreceding, -1)
    due = due.withColumn("__inside", F.coalesce(F.sum("__charged").over(inside), F.lit(0)))
    due = due.join(held, due["source"].eqNullSafe(held["__s"]) & (F.col("__bucket") == F.col("__b")))
    before = F.col("__below") + F.col("__inside")
    drawn = (F.col("size") > 0) & (F.col("__sure") | (before + F.col("size") / 2 <= F.col("__due")))
    copies = F.col("__whole") + drawn.cast("bigint")
    return due.select(
        *keep, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix_documents(
    docs: DataFrame, weights: Sequence[float], share: float, most: float = 2.0, seed: str = "mix", importance: Column | None = None
) -> DataFrame:
    """The documents with their own columns, each repeated as often as the mix takes it.

    Copies meet their text by (doc_id, text hash); rows that repeat both, and the source, are drawn one by one and
    share their copies out evenly, by their number among themselves.
    """
    mark = F.xxhash64("text")
    drawn = mix(docs.withColumn("__mark", mark), weights, share, most, seed, importance, keep=("doc_id", "__mark"))
    copies = drawn.groupBy("doc_id", "source", "__mark").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"))
    copies = copies.where(F.col("total") > 0).select(
        F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), F.col("__mark").alias("c_mark"), "total", "rows"
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), F.col("source").alias("r_source"), mark.alias("r_mark")
    )
    on = F.col("r_id").eqNullSafe(F.col("c_id")) & F.col("r_source").eqNullSafe(F.col("c_source")) & (F.col("r_mark") == F.col("c_mark"))
    met = rows.join(copies, on)
    # a single row takes all its copies; of rows that repeat, all take the whole share and the rest goes by their number among equal ones
    rest = F.col("total") % F.col("rows")
    equal = ["c_id", "c_source", "c_mark"]
    met = met.select("row", *equal, "total", "rows")
    several = number_rows(met.where(F.col("rows") > 1), equal, name="place", start=0, within=equal)
    met = met.where(F.col("rows") == 1).withColumn("place", F.lit(0).cast("bigint")).unionByName(several.select(*met.columns, F.col("place").cast("bigint")))
    times = F.floor(F.col("total") / F.col("rows")) + (F.col("place") < rest).cast("bigint")
    return met.withColumn("times", times.cast("int")).where(F.col("times") > 0).select(F.explode(F.sequence(F.lit(1), F.col("times"))), "row").select("row.*")
