"""Substring dedup, neighbours, BPE, language id, SimHash, WARC and the pipeline against brute force and on odd input."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from recordshield.llm import bpe, langid, neighbours, simhash, substring, warc
from recordshield.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)) + "."


def doc_rows(texts):
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]


# --- 2: substring dedup --------------------------------------------------------------------------------------------------


def brute_cut(rows):
    """Removed sentences per row from every span of every row, in document order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2]))
    seen, gone = {}, [set() for _ in rows]
    for i in order:
        doc, text, mark = rows[i]
        for first, last, digest in substring.spans(substring.sentences(text)):
            if seen.setdefault(digest, (doc, mark, first)) != (doc, mark, first):
                gone[i] |= set(range(first, last + 1))
    return ["".join(p for k, p in enumerate(substring.sentences(r[1])) if k not in gone[i]) for i, r in enumerate(rows)]


def test_spans_of_a_slice_leave_in_small_batches():
    text = " ".join(f"word{n} is here now again." for n in range(120_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_hash": [2], "text": [text]})
    sizes = [b.num_rows for b in substring._batch_spans(iter([batch]))]
    assert sum(sizes) == 119_998 and max(sizes) <= 50_000


def test_substring_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["h"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("h", F.xxhash64("text")).collect()]
    want = {r[0]: t for r, t in zip(rows, brute_cut(rows))}
    got = {r["doc_id"]: r["text"] for r in QUERIES["op2_substring_dedup"](spark, SMALL).collect()}
    assert got == want and any(got[r[0]] != r[1] for r in rows)


def test_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(3)
    passages = [" ".join(sentence(rng, 12) for _ in range(5)), sentence(rng, 60), " ".join(sentence(rng, 2) for _ in range(26))]
    own = [[sentence(rng, rng.randint(3, 14)) for _ in range(8)] for _ in range(40)]
    texts = [" ".join([*o[:4], passages[i % 3], *o[4:]]) for i, o in enumerate(own)] + [" ".join(o) for o in own[:0]]
    docs = spark.createDataFrame(doc_rows(texts), DOCS)
    out = {r["doc_id"]: r for r in substring.dedup_table(docs).collect()}
    for i, o in enumerate(own):
        left = out[i]["text"]
        assert all(s in left for s in o)
        assert (passages[i % 3] in left) == (i < 3)
        if i >= 3:
            assert len(left.split()) - sum(len(s.split()) for s in o) <= 12
    plain = spark.createDataFrame(doc_rows([" ".join(o) for o in own]), DOCS)
    assert substring.dedup_table(plain).where("n_removed > 0").count() == 0


def test_passage_inside_longer_sentences(spark):
    """A passage without a sentence end goes wherever the sentences around it begin."""
    rng = random.Random(9)
    passage = sentence(rng, 51)[:-1].split()
    texts = []
    for i in range(30):
        before, after = sentence(rng, 7 + i)[:-1], sentence(rng, 5 + i % 4)
        texts.append(" ".join([sentence(rng, 6), before, *passage, after, sentence(rng, 9)]))
    left = {r["doc_id"]: r["text"] for r in substring.dedup_table(spark.createDataFrame(doc_rows(texts), DOCS)).collect()}
    assert left[0] == texts[0]
    for i in range(1, 30):
        stays = [w for w in left[i].split() if w in passage]
        own = [w for w in texts[i].split() if w not in passage]
        assert len(stays) <= 20 and set(own) <= set(left[i].split())


def test_ends_of_passages_go(spark):
    """Against every run of at least three sentences and fifteen words, not spans; sentences here are never cut further."""
    rng = random.Random(17)
    assert [(a, b) for a, b, _ in substring.spans([sentence(rng, n) for n in (10, 3, 2, 5)])] == [(0, 2), (0, 3)]
    texts, passages = [], [[sentence(rng, n) + " " for n in sizes] for sizes in ((10, 3, 2, 5), (1, 7, 6, 1, 1), (6, 6, 6, 2, 1, 3, 1), (2,) * 9, (9, 9, 1))]
    for k in range(40):
        pieces = [sentence(rng, rng.randint(1, 10)) + " " for _ in range(rng.randint(0, 4))]
        whole = passages[k % 5]
        cut = rng.randint(0, 2) if k > 9 else 0
        pieces += whole[cut:] if k % 3 else whole[: len(whole) - cut]
        pieces += [sentence(rng, rng.randint(1, 10)) + " " for _ in range(rng.choice([0, 0, 3]))]
        texts.append(pieces)
    texts += [list(passages[0]), passages[2] + passages[0]]
    seen, want = {}, []
    for k, pieces in enumerate(texts):
        assert substring.sentences("".join(pieces)) == pieces
        sizes, gone = [len(p.split()) for p in pieces], set()
        for a in range(len(pieces)):
            for b in range(a + 3, len(pieces) + 1):
                if sum(sizes[a:b]) >= 15 and seen.setdefault(tuple(pieces[a:b]), (k, a)) != (k, a):
                    gone |= set(range(a, b))
        want.append("".join(p for i, p in enumerate(pieces) if i not in gone))
    docs = spark.createDataFrame(doc_rows(["".join(t) for t in texts]), DOCS)
    got = {r["doc_id"]: r["text"] for r in substring.dedup_documents(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want and want[-2:] == ["", ""]


def test_substring_odd_rows(spark):
    rng = random.Random(4)
    body = " ".join(sentence(rng, 10) for _ in range(6))
    rows = [
        (1, body, "en", "s", 1), (1, body, "en", "s", 1), (1, body + " More.", "en", "s", 1), (None, body, None, None, None), (2, None, "en", "s", 0),
        (3, "", "en", "s", 0), (4, " \n ", "en", "s", 3), (5, body + "\n" + body, "en", "s", 9), (6, "word " * 200_000, "en", "s", 9),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("first", F.lit(7))
    out = substring.dedup_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and all(r["row"] == "clash" and r["first"] == 7 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    # the null id is first and keeps its text; both equal rows of id 1 are treated alike
    assert by[None] == [body] and Counter(by[1])[""] == 2 and by[2] == [None] and by[3] == [""] and by[4] == [" \n "]
    assert by[5] == [""] and len(by[6][0]) < 1000
    assert substring.dedup_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "A b. C d!\n\n e? f", " \n x", "no end", "x" * 5000 + " y.", "One. " * 40, "1.5 is. not\n a b c d e f g h i j k l m"])
def test_sentences_lose_nothing(text):
    assert "".join(substring.sentences(text)) == text


# --- 4: neighbours -------------------------------------------------------------------------------------------------------


def brute_nearest(ids, x, q, k):
    score = (x * x[q]).sum(1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in QUERIES["op4_nearest_neighbours"](spark, SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert sorted(got) == sorted(int(ids[i]) for i in queries)
    share = []
    for i in queries:
        want = brute_nearest(ids, x, i, 20)
        own = sorted(got[int(ids[i])])
        assert [r for r, _, _ in own] == list(range(1, 21))
        share.append(len({v for _, v, _ in own} & {v for v, _ in want}) / 20)
    assert np.mean(share) >= 0.9


def test_visits_go_on_until_enough_rows():
    rng = np.random.default_rng(18)
    dense = [c + np.r_[t, np.zeros(7)] for c in rng.normal(size=(6, 8)) * 3 for t in rng.normal(size=400) * 0.01]
    single = rng.normal(size=(40, 8)) * 40
    points = np.array([*dense, *single])
    tree = neighbours.Tree(points, 24, neighbours.BRANCHES)
    sizes = np.bincount(tree.place(points), minlength=tree.leaves)
    held = [[int(sizes[tree.visits(p, 1, *more)].sum()) for p in single] for more in ((), (sizes, 21))]
    assert min(held[0]) < 20 and min(held[1]) >= 21
    assert sorted(tree.visits(single[0], 1, sizes, len(points) + 1)) == list(range(tree.leaves))


def test_every_query_gets_k_rows(spark):
    """Dense clusters, which set the visits, and single rows far from them and from each other."""
    rng = np.random.default_rng(18)
    dense = [c + np.r_[t, np.zeros(7)] for c in rng.normal(size=(6, 8)) * 3 for t in rng.normal(size=400) * 0.01]
    vectors = [x.tolist() for x in [*dense, *(rng.normal(size=(40, 8)) * 40)]]
    # a query with many rows of its own
    rows = [*enumerate(vectors), *[(2439, (np.array(vectors[2439]) + i * 0.01).tolist()) for i in range(1, 31)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = F.col("vec_id") != 2439
    got = Counter(r["query_id"] for r in neighbours.nearest(df, asked, 20, leaves=24, recall=0.9).collect())
    assert Counter(got.values()) == {20: 2439}
    got = neighbours.nearest(df, F.col("vec_id") == 2439, 20, leaves=24, recall=0.9).groupBy("query_id").count().collect()
    assert [tuple(r) for r in got] == [(2439, 20)]


def test_neighbours_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8))
    rows = [(i, base[i].tolist()) for i in range(300)] + [(1000 + i, base[5].tolist()) for i in range(400)]
    rows += [(5, base[5].tolist()), (2000, None), (2020, [0.0] * 8), (2040, [None] + [1.0] * 7), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0, 20, leaves=16, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(300), *range(1000, 1400)])
    x = np.vstack([base, np.repeat(base[5:6], 400, 0)])
    assert sorted(got) == [int(i) for i in ids if i % 5 == 0]
    right = 0
    for q, found in got.items():
        want = brute_nearest(ids, x, int(np.flatnonzero(ids == q)[0]), 20)
        right += [v for _, v, _ in sorted(found)] == [v for v, _ in want]
        assert len({v for _, v, _ in found}) == len(found) == 20 and q not in {v for _, v, _ in found}
    assert right >= 0.9 * len(got)
    # many copies: of equal scores the smallest ids come first
    assert [v for _, v, _ in sorted(got[1000])][:3] == [5, 1001, 1002] or [v for _, v, _ in sorted(got[1000])][0] not in range(1003, 1400)
    few = neighbours.nearest(spark.createDataFrame(rows[:4], df.select("vec_id", "embedding").schema), F.col("vec_id") == 0, 20).collect()
    assert len(few) == 3
    assert neighbours.nearest(df.limit(0), F.lit(True), 20).count() == 0


# --- 5: BPE --------------------------------------------------------------------------------------------------------------

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BPE_TEXTS = [
    None, "", " ", "a", "Hello world", "  two  spaces \n\n\t x", "don't I'LL we've", "naïve café ÜBER", "😀👩‍👩‍👧 ok", "<|endoftext|> text", "x" * 3000, "12345 ١٢٣ ⅷ",
    "  \u0085 z", "日本語のテキスト", "a\x00b\x1f", "é" * 700, "﻿bom", "𐍈𝔘",
]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(bpe.read_vocabulary(PATH))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, reference):
    docs = spark.createDataFrame(doc_rows(BPE_TEXTS), DOCS)
    out = bpe.encode_table(docs, PATH, PATTERN, ["ids", "starts", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])
    for r in out.collect():
        text = BPE_TEXTS[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        pieces = reference.decode_tokens_bytes(ids)
        assert r["starts"] == [sum(map(len, pieces[:i])) for i in range(len(ids))]
    back = bpe.decode_table(out, PATH, PATTERN).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {i: t or "" for i, t in enumerate(BPE_TEXTS)}


def test_bpe_every_code_point(reference):
    codec = bpe._codec(bpe.read_vocabulary(PATH), PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 5000):
        for glue in ("", "a", " "):
            text = glue.join(points[start : start + 5000])
            assert codec.encode(text) == reference.encode_ordinary(text)


def test_bpe_split_characters_and_errors(reference):
    codec = bpe._codec(bpe.read_vocabulary(PATH), PATTERN)
    ids = codec.encode("😀")
    assert len(ids) > 1 and codec.decode_text(ids) == "😀" and codec.decode_text(ids[:1]).endswith("�")
    with pytest.raises(IndexError):
        codec.decode([codec.size])


def test_op5_equals_tiktoken_on_the_table(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op5_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)


# --- 7: language id ------------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    import zlib

    rows = [(i, "der die und das ist ein " * 5 if i % 2 else "the and of this is an " * 5, "de" if i % 2 else "en", "s", 0) for i in range(60)]
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "12 !! 3", "en", "s", 0), (None, "the of and", "xx", "s", 0), (103, "und die " * 30_000, None, "s", 0), (103, "the " * 3, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (100, 101, 102))
        assert r["lang_pred"] in ("de", "en", "und")
    assert langid.identify(docs.limit(0), langid.learn(docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


def test_language_sample_is_the_least_hashes(spark):
    """The bound before the window changes no choice: many rows, few rows, one id in a third of the rows, all rows of one id."""
    big = spark.range(30000).selectExpr("id AS doc_id", "'en' AS lang")
    hot = spark.range(6000).selectExpr("IF(id % 3 = 0, -5, id) AS doc_id", "'fr' AS lang")
    rows = big.unionByName(hot).unionByName(spark.range(40).selectExpr("id AS doc_id", "'no' AS lang"))
    rows = rows.unionByName(spark.range(900).selectExpr("7L AS doc_id", "'xx' AS lang"))
    met = langid._under_bound(rows, 100)
    assert met.where("lang = 'en'").count() < 600
    assert "hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    hashed = rows.withColumn("__h", F.xxhash64(F.col("doc_id").cast("string")))

    def least(df):
        w = W.partitionBy("lang").orderBy("__h", "doc_id")
        return Counter((r["lang"], r["doc_id"]) for r in df.withColumn("n", F.row_number().over(w)).where("n <= 100").collect())

    assert least(met) == least(hashed)


# --- 8: SimHash ----------------------------------------------------------------------------------------------------------


def brute_print(text, size=3):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))] if tokens else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, within=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= within:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_op8_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    prints = [brute_print(r["text"]) for r in docs]
    want = brute_components([r["doc_id"] for r in docs], prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash_dedup"](spark, SMALL).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(docs, prints, want)}


def test_simhash_odd_rows(spark):
    rows = doc_rows(["Same Text here now", "same text HERE now", None, "", " \n", "one", "a b", "a b", "Ä b c d", "ä b c d", "x y z " * 20_000])
    rows += [(None, "only null id here", "en", "s", 0), (0, "Same Text here now", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash"))
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    prints = [brute_print(r[1]) for r in rows]
    want = brute_components([r[0] for r in rows], prints)
    assert Counter(got) == Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("choices", [(2,), (3,), (4,), (6,)])
def test_pigeonhole_loses_no_link(spark, choices, monkeypatch):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)}
    # a dense chain: more members in one key than a block holds
    dense = rng.getrandbits(64)
    values |= {dense ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    monkeypatch.setattr(simhash, "BLOCK", 16)
    prints = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fp binary")
    roots = {bytes(r["fp"]): bytes(r["root"]) for r in simhash.near_groups(prints, 3, 3, choices).collect()}
    order = sorted(values)
    want = brute_components(order, order)
    for v, least in zip(order, want):
        assert int.from_bytes(roots.get(v.to_bytes(8, "big"), v.to_bytes(8, "big")), "big") == least


def test_thresholds_sum_to_the_principle():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (5000, 64)).astype(float)
    bits[:, 7] = bits[:, 3]
    joint = (bits.T @ bits)[None]
    for m in (2, 3, 4, 5):
        parts = simhash.plan_parts(5000, joint, 3, (m,))
        assert sum(t for _, t in parts) - (m - len(parts)) == 3 - m + 1
        assert len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)
    dealt = simhash.deal_bits(5000, joint, 4)
    assert sorted(b for p in dealt for b in p) == list(range(64)) and any({3, 7} <= set(p) for p in dealt)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(6)
    texts = [" ".join(sentence(rng, 15) for _ in range(20)) for _ in range(60)]
    near = []
    for t in texts[:30]:
        w = t.split()
        for at in rng.sample(range(len(w)), 4):
            w[at] = "changed"
        near.append(" ".join(w))
    rows = doc_rows([*texts, *near, *texts[30:40], None, "", "tiny"])
    rows += [rows[0], (None, "unlike all the others here", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mark", F.lit("clash"))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = Counter(r["doc_id"] for r in out.collect())
    assert all(kept[i] == 1 for i in range(60)) and not any(kept[i] for i in range(60, 100))
    assert kept[100] == 1 and kept[101] == 0 and kept[102] == 1 and kept[None] == 1


def brute_alike(texts, part=4, whole=5):
    """The least number of the component of each text, by the Jaccard similarity of the five-word shingles of every pair."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("block", [16, 1024])
def test_stage_drops_only_what_is_alike(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(16)
    texts = []
    # 4 to 11 of 304 words changed: similarities from 0.88 to 0.69
    for changes in range(4, 12):
        for _ in range(12):
            words = " ".join(sentence(rng, 16) for _ in range(19)).split()
            texts.append(" ".join(words))
            for at in rng.sample(range(2, 300, 5), changes):
                words[at] = "changed"
            texts.append(" ".join(words))
    # a chain whose neighbours alone are alike, one shingle over and over, a dense group, texts of a few words
    words = " ".join(sentence(rng, 16) for _ in range(19)).split()
    for step in range(6):
        texts.append(" ".join(words))
        for at in rng.sample(range(50 * step, 50 * step + 50), 3):
            words[at] = f"other{step}"
    texts += ["a b c d e " * 400 + sentence(rng, 12) for _ in range(4)]
    base = " ".join(sentence(rng, 16) for _ in range(19)).split()
    texts += [" ".join(f"w{k}" if i in at else x for i, x in enumerate(base)) for k in range(40) for at in [set(rng.sample(range(2, 300, 5), 3))]]
    texts += ["one two three four five six seven eight nine", "one two three four five six seven eight", "one two three four five", "ONE two  three four five", "one two"]
    docs = spark.createDataFrame(doc_rows(texts), DOCS)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(brute_alike(texts)))


# --- 10: WARC ------------------------------------------------------------------------------------------------------------


def brute_warc(rows):
    first = {}
    for page, html in rows:
        body = (html or "").encode()
        if page is not None:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = body in first and first[body] != page
        out.append((page, len(body), digest, "revisit" if again else "response", first[body] if again else None))
    return out


def warc_rows(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


def test_op10_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert warc_rows(QUERIES["op10_warc"](spark, SMALL)) == Counter(brute_warc([(r["page_id"], r["html"]) for r in pages]))


def test_warc_odd_rows_and_selected_reads(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(i, f"http://h/{i}?a b\r\nX: y", f"<p>{i % 7}</p>" * (i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (7, "u", "<p>0</p>"), (7, "u", "<p>0</p>"), (None, "u", "<p>1</p>"), (None, "n", "alone"), (200, "ü", "é\r\n\r\nWARC/1.1 " * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    folder = warc.archive_folder(spark)
    index = warc.write_archives(df, folder)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 1
    assert warc_rows(warc.read_records(index, folder)) == Counter(brute_warc([(r[0], r[2]) for r in rows]))
    some = warc.read_records(index.where("page_id = 200"), folder).collect()
    assert [bytes(r["payload"]).decode() for r in some] == [rows[-1][2]]
    by_page = {r["page_id"]: r for r in index.where("page_id in (3, 10)").collect()}
    assert by_page[10]["record_type"] == "revisit" and by_page[10]["refers_to"] == 3 and by_page[10]["payload_digest"] == by_page[3]["payload_digest"]
    empty = warc.write_archives(df.limit(0), warc.archive_folder(spark))
    assert empty.count() == 0 and warc.read_records(empty, folder).count() == 0


def test_ranges_are_coalesced():
    ranges = [(0, 10), (10, 5), (15 + warc.GAP, 5), (21 + 2 * warc.GAP, 5), (22 + 3 * warc.GAP, warc.READ_BYTES)]
    assert [(b, e, len(m)) for b, e, m in warc.coalesced(ranges)] == [
        (0, 20 + warc.GAP, 3), (21 + 2 * warc.GAP, 26 + 2 * warc.GAP, 1), (22 + 3 * warc.GAP, 22 + 3 * warc.GAP + warc.READ_BYTES, 1),
    ]


# --- the pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_is_its_stages_one_after_the_other(spark, reference):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.store(stage(spark, before, SMALL), f"stage{place}")
        if place < 4:
            assert after.columns == columns, name
        if place == 2:
            rows = [(r["doc_id"], r["text"], r["h"]) for r in before.withColumn("h", F.xxhash64("text")).collect()]
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {r[0]: t for r, t in zip(rows, brute_cut(rows))}
        if place == 4:
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in after.collect():
                assert list(r["ids"]) == reference.encode_ordinary(texts[r["doc_id"]])
        before = after
    whole = corpus_pipeline.run(spark, SMALL)
    digest = lambda df: Counter((r["doc_id"], r["ids_sha256"]) for r in df.select("doc_id", "ids_sha256").collect())
    assert digest(whole) == digest(before)


def near_family(rng, n, length=120, changed=9):
    """Texts that differ from one text in a few words each: most pairs lie at a similarity of 0.5 to 0.8."""
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for place in rng.sample(range(length), rng.choice([1, changed])):
            own[place] = "".join(rng.choice("klmnop") for _ in range(6))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [512, 37])
def test_stage_compares_whole_families_but_sends_forests(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "FAMILY_BLOCK", block)
    rng = random.Random(21)
    sizes = (200, 400)
    texts = [t for n in sizes for t in near_family(rng, n)] + [sentence(rng, 40) for _ in range(50)]
    rows = []
    compared = simhash.family_links

    def counted(tables):
        out = compared(tables)
        rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "family_links", counted)
    docs = spark.createDataFrame(doc_rows(texts), DOCS).repartition(4)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(brute_alike(texts)))
    blocks = sum(-(-n // block) for n in sizes)
    assert rows[0] <= sum(sizes) * blocks
