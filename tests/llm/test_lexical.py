"""Ranked lexical search against plain counting."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recordshield.llm import lexical

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(docs, items, k):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for i, text in items:
        want = TERM.findall((text or "").translate(LOWER))
        scored = []
        for d, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in want if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=5, parts=4):
    left = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS).repartition(parts)
    right = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    out = lexical.rank_documents(left, right, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(docs, items, k)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcXYZéß漢1") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)] + [(None, docs[7][1]), (None, docs[9][1]), (5, None), (6, ""), (8, " .,;"), (7, docs[7][1])]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(90, None), (91, "..."), (92, "nowherefound"), (None, docs[7][1]), (3, docs[7][1] * 3)]
    return docs, items


def test_equals_brute_force_with_ties_and_odd_rows(spark, corpus):
    check(spark, *corpus)


def test_groups_and_tiles_change_nothing(spark, corpus, monkeypatch):
    for name, value in (("GROUP_ITEMS", 7), ("TILE_ITEMS", 3), ("TILE_COLUMNS", 4), ("TILE_DOCS", 9), ("BUCKETS", 2)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus
    check(spark, docs, items, 20, 7)


def test_tiles_stay_below_the_bound(corpus):
    docs, _ = corpus
    entries = np.array([(0, 0, 10**8), (0, 1, 3), (1, 1, 5)], np.int64)
    tile = lexical.ItemTile(0, entries, [26_000, 7])
    parts = list(lexical.safe_tiles(np.array([0, 1]), tile.dense(np.array([0, 1]))))
    assert all(w.sum(1).max() * lexical.IMPACT <= 1 << 53 for _, w in parts) and len(parts) > 200
    total = np.zeros((2, 2), np.int64)
    for columns, w in parts:
        total[:, columns] += w
    assert total.tolist() == [[26_000 * 10**8, 21], [0, 35]]
    rows = [(4, 9, np.array([0, 1], "<i4").tobytes(), np.array([3, 1], "<i4").tobytes())]
    block = lexical.Block(rows, 10, 90)
    m = 75 + 25 * 9 * 10 // 90
    impacts = [10**9 * tf // (1000 * tf + 12 * m) for tf in (3, 1)]
    assert block.scores(tile).tolist() == [[26_000 * 10**8 * impacts[0] + 21 * impacts[1]], [35 * impacts[1]]]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", "x")], DOCS)
    assert lexical.rank_documents(docs, spark.createDataFrame([(1, "a", "x")], ITEMS)).count() == 0
    assert lexical.rank_documents(some, items).count() == 0


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "ab cd " * 1000 + "é" * 50 + " ab"
    whole = [t for part in lexical.terms(text.encode()) for t in part]
    monkeypatch.setattr(lexical, "SLICE", 64)
    assert [t for part in lexical.terms(text.encode()) for t in part] == whole == [t.encode() for t in TERM.findall(text)]
