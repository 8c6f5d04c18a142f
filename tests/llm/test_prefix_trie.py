"""The prefix trie against a trie of plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from recordshield.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + said[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode().split()) if path else 0
    out = []
    for path, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path], digest))
    return sorted(out, key=repr)


def check(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.turns(df)))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == brute(rows)
    return got


def conversation(rng, c, n, pool):
    return [(c, k, rng.choice(["user", "assistant", None]), rng.choice(pool)) for k in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(11)
    pool = ["a b", "c", "", None, "d  e\nf", "é ü"]
    rows = [r for c in range(90) if c % 7 for r in conversation(rng, c, rng.randint(1, 9), pool)]
    rows += [(-3, 0, "user", "a b"), (-3, None, "user", "c"), (-20, 1, None, "c"), (None, 0, "user", "a b"), (10**12, 5, "user", "a b")]
    # equal numbers, repeated rows
    rows += [(200, 1, "user", "x"), (200, 1, "user", "x"), (200, 1, "user", "w"), (200, None, "user", "y"), (201, 3, "user", "a b")]
    check(spark, rows)


def test_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPREAD", 16)
    monkeypatch.setattr(prefix_trie, "SLICE", 20)
    rng = random.Random(12)
    # a chain of 150 turns, copies that leave it at any depth, and a first turn that most conversations share
    chain = [(1000, k, "user", f"t{k} of it") for k in range(150)]
    rows = list(chain)
    for c in range(1001, 1012):
        stop = rng.randint(1, 149)
        rows += [(c, k, "user", t) for _, k, _, t in chain[:stop]] + [(c, stop, "user", f"own {c}")] * (c % 2)
    rows += [(3000 + 20 * k, 0, "user", "hello there") for k in range(120)]
    got = check(spark, rows)
    assert max(r[1] for r in got) >= 140 and len(got) > 150


def test_no_turns_left(spark):
    # conversations whose own turns all fall away and whose family head is absent
    rows = [(c, 0, "user", "x") for c in range(1, 20)]
    got = check(spark, rows)
    assert got[0][:2] == (1, 0)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.turns(empty))).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 8, 9])
def test_depths_at_the_powers_of_two(spark, depth):
    rows = [(20 * c, k, "user", f"{k if k < depth - 1 else c % 3} w") for c in range(8) for k in range(depth)]
    check(spark, rows)
