"""Operator 6, quality rules: a learned decision list.

Every text is described by a few plain measures (native expressions over the whole text). From labelled documents a list of
rules is learned by sequential covering: a rule is a conjunction of thresholds that is grown, condition by condition, by the
gain in information on two thirds of the labelled documents, pruned back on the last third, and kept only if it is nearly
always right there; the documents it covers are set aside and the next rule is grown. Documents that no rule covers are kept.
The list becomes one ordered ``CASE`` expression.

Learning never moves rows: thresholds are quantiles of all labelled documents, documents are counted into cells of binned
measures, and each step is one aggregation of the cell table whose result has a row per (measure, bin).

Defined cases: null, empty and blank texts have no words, all measures 0, and fail the base rules; labels of one document
that disagree are taken as bad if any says so; null labels are left out; without labels the list is empty; equal gains go to
the first measure and lowest threshold, so that reruns agree; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import SPACE, let, words

#: Characters counted as symbols, the window of repeated words, the limits of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Up to this many repeated windows of a text are looked up one by one.
SHORT_LIST = 128

#: Measures that rules may test, as expressions over the counts below. Counts are first divided by the words.
MEASURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "shout_rate": "n_shouts / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _repeat_words(tokens: Column) -> Column:
    """Words inside a window of three that occurs twice or more in the text.

    Windows are known by their hash. Those that occur again are found by sorting the hashes; their places are then looked up
    in the short list of repeated hashes, or, where that list is long, by sorting the hashes once more with their places.
    In place order, the words they cover are counted once. Both ways give the same places.
    """
    places = F.when(F.size(tokens) >= WINDOW, F.sequence(F.lit(0), F.size(tokens) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)]))

    def looked_up(hashed: Column, again: Column) -> Column:
        return F.filter(F.transform(hashed, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())

    def sorted_out(hashed: Column) -> Column:
        ordered = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        beside = let(
            ordered,
            lambda a: F.filter(a, lambda x, k: (F.get(a, k - 1)["h"] == x["h"]) | (F.get(a, k + 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(beside, lambda x: x["i"]))

    def covered(hashed: Column) -> Column:
        again = let(F.sort_array(hashed), lambda a: F.array_distinct(F.filter(a, lambda h, k: F.get(a, k + 1) == h)))
        found = let(again, lambda d: F.when(F.size(d) <= SHORT_LIST, looked_up(hashed, d)).otherwise(sorted_out(hashed)))
        return F.aggregate(
            found,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )

    # most texts repeat nothing: only the others are sorted
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def describe(df: DataFrame, text: str = "text") -> DataFrame:
    """The counts of each text as columns behind the others; a count named like a column of ``df`` replaces it."""
    body = F.coalesce(F.col(text), F.lit(""))

    def count(characters: str) -> Column:
        return F.regexp_count(body, F.lit(f"[{characters}]"))

    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    counted = let(
        words(body),
        lambda t: F.struct(F.size(t).alias("n"), F.length(F.array_join(t, "")).alias("c"), _repeat_words(t).alias("r")),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    wide = df.withColumns({"__words": counted, "__lines": line_counts})
    counts = {
        "n_words": F.col("__words.n"),
        "word_chars": F.col("__words.c"),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": F.col("__lines.d"),
        "n_repeat_words": F.col("__words.r"),
        "n_lines": F.col("__lines.n"),
        "n_shouts": count("!"),
        "n_capitals": count("A-Z"),
    }
    return wide.withColumns({k: v.cast("bigint") for k, v in counts.items()}).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules_column(rules: Sequence[Rule]) -> Column:
    """The decision list as one expression: null if no rule fits, else the place of the first that does."""
    out = F.lit(None).cast("int")
    for place, rule in reversed(list(enumerate(rules))):
        out = F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(place)).otherwise(out)
    return out


def learn_rules(
    described: DataFrame,
    labels: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 10,
    quantiles: int = 20,
) -> list[Rule]:
    """Rules that tell bad documents, from ``described`` (doc_id and counts) and ``labels`` (doc_id, quality 0 or 1).

    All labelled documents that pass the base rules take part. ``quantiles`` thresholds a class and measure are tried.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("__bad"))
    labelled = described.where(~base_failed()).join(marks, "doc_id")
    names = list(MEASURES)
    values = store(
        labelled.select(
            "__bad",
            (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) == 0).alias("__held"),
            *[F.expr(MEASURES[m]).alias(m) for m in names],
        ),
        "labelled",
    )
    steps = [(k + 0.5) / quantiles for k in range(quantiles)]
    found = values.groupBy("__bad").agg(*[F.percentile_approx(m, steps).alias(m) for m in names]).collect()
    seen = {m: sorted({float(v) for row in found for v in (row[m] or [])}) for m in names}
    # thresholds lie midway between quantiles, so that a rule keeps its distance from both classes
    cuts = {m: [(a + b) / 2 for a, b in zip(v, v[1:])] for m, v in seen.items()}
    bins = [
        reduce(lambda a, b: a + b, [(F.col(m) > F.lit(c)).cast("int") for c in cuts[m]], F.lit(0)).alias(m) for m in names
    ]
    cells = values.select("__bad", "__held", *bins).groupBy("__held", *names).agg(
        F.sum(F.col("__bad").cast("bigint")).alias("bad"), F.sum((~F.col("__bad")).cast("bigint")).alias("good")
    )
    cells = store(cells, "cells")

    def fits(rule: Sequence[tuple[str, bool, int]]) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(m) > k) if up else (F.col(m) <= k) for m, up, k in rule], F.lit(True))

    rules: list[list[tuple[str, bool, int]]] = []
    while len(rules) < max_rules:
        left = cells
        for done in rules:
            left = left.where(~fits(done))
        rule = _grow(left.where(~F.col("__held")), names, cuts, fits, max_conditions)
        if not rule:
            break
        rule = _prune(left.where("__held"), rule, fits, min_precision, min_covered)
        if not rule:
            break
        rules.append(rule)
    return [tuple(Condition(m, up, cuts[m][k]) for m, up, k in rule) for rule in rules]


def _grow(cells: DataFrame, names: list[str], cuts: dict, fits, most: int) -> list[tuple[str, bool, int]]:
    """Conditions added while each gains information about the bad documents."""
    rule: list[tuple[str, bool, int]] = []
    while len(rule) < most:
        stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("bin")) for m in names])).alias("x")
        rows = (
            cells.where(fits(rule)).select(stacked, "bad", "good").groupBy("x.m", "x.bin")
            .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
        )
        best, chosen = 0.0, None
        for m in names:
            own = {r["bin"]: (r["bad"], r["good"]) for r in rows if r["m"] == m}
            bad, good = sum(b for b, _ in own.values()), sum(g for _, g in own.values())
            if not bad or not good:
                return rule
            low_bad = low_good = 0
            for k in range(len(cuts[m])):
                b, g = own.get(k, (0, 0))
                low_bad, low_good = low_bad + b, low_good + g
                for up, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                        if gain > best + 1e-9:
                            best, chosen = gain, (m, up, k)
        if chosen is None:
            break
        rule.append(chosen)
    return rule


def _prune(cells: DataFrame, rule, fits, min_precision: float, min_covered: int):
    """The shortest best beginning of the rule on documents it was not grown on; None if that is not nearly always right."""
    heads = [rule[: k + 1] for k in range(len(rule))]
    sums = [
        F.coalesce(F.sum(F.when(fits(h), F.col(c))), F.lit(0)).alias(f"{c}{k}") for k, h in enumerate(heads) for c in ("bad", "good")
    ]
    row = cells.agg(*sums).first()
    best, chosen = None, None
    for k, head in enumerate(heads):
        p, n = row[f"bad{k}"], row[f"good{k}"]
        if p + n < min_covered or p / (p + n) < min_precision:
            continue
        worth = p - n
        if best is None or worth > best:
            best, chosen = worth, head
    return chosen


def judge(described: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``base_failed``, ``rule`` (place of the first that fits, else null) and ``kept`` behind the described documents."""
    out = described.withColumns({"base_failed": base_failed(), "rule": rules_column(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_table(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """One row per document with its counts and the verdict; the texts are read once."""
    described = store(describe(docs.select("doc_id", "text")).drop("text"), "described")
    return judge(described, learn_rules(described, labels, **learning))


def keep_good(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """The documents that are kept, with their own columns; texts are described once, and stored beside their counts."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id"), F.col("text"))
    described = store(describe(own).drop("text"), "described")
    rules = learn_rules(described.drop("__row"), labels, **learning)
    return judge(described, rules).where("kept").select("__row.*")
