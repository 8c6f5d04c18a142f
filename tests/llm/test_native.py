"""URL filters, sharding, quality rules and mixing against brute force and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from recordshield.llm import mixing, quality, sharding, url_filter
from recordshield.llm.common import words
from recordshield.llm.queries import QUERIES, SQL, URL_RULES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def python_nodes(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    result = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], SQL[name])
    assert result.startswith("ok"), result


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- 1: URL filters ------------------------------------------------------------------------------------------------------

URLS = [
    ("https://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/"),
    ("http://m.example.org/en/12?x=/y", "m.example.org", "/en/12", "example.org/en/1"),
    ("http://notexample.org/es/1#a", "notexample.org", "/es/1", "org/"),
    ("https://a.com/fr/", "a.com", "/fr/", "com/fr/"),
    ("https://a.com/fr", "a.com", "/fr", None),
    ("https://a.com/de/x", "a.com", "/de/x", "com/de/"),
    ("https://org", "org", "", None),
    ("https://org?a=://b/", "org", "", None),
    ("x://com:80/de/", "com:80", "/de/", None),
    ("nothing", "", "", None),
    (None, "", "", None),
    ("", "", "", None),
    ("a://ÄB.Org/Es/\n#x", "Äb.org", "/Es/\n", "org/"),
    ("a://b://c", "b:", "//c", None),
]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)], "page_id long, url string")
    rows = url_filter.judge_urls(df, URL_RULES, F.lit(None).cast("int")).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in rows] == [tuple(x[1:]) for x in URLS]
    for r in rows:
        assert r["verdict"] == (URL_RULES[r["rule"]] if r["rule"] else "allow")


def test_url_templates_merge_and_reject(spark):
    rows = []
    for i in range(300):
        rows.append((f"http://h.net/en/{i}", 0 if i % 10 else 1))
        rows.append((f"http://h.net/fr/{i}", 0 if i % 11 else 1))
        rows.append((f"http://h.net/junk/{i}", 1))
    rows += [("http://h.net/en/same", None)] * 200
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    out = {r["path"]: r for r in url_filter.judge_urls(df, {}, F.col("bad")).collect()}
    assert out["/en/5"]["template"] == out["/fr/7"]["template"] == "/{en|fr}/*"
    assert out["/junk/5"]["template"] == "/junk/*"
    assert out["/en/same"]["template"] == "/{en|fr}/same"
    assert out["/junk/5"]["verdict"] == "block" and out["/en/5"]["verdict"] == "allow"


def _judged(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    return {r["path"]: r for r in url_filter.judge_urls(df, {}, F.col("bad")).collect()}


def test_url_thin_sections_join_no_clusters(spark):
    """A section with two labels between a clean and a bad one leaves both as they are."""
    rows = [(f"http://h.net/clean/{i}", int(i % 10 == 0)) for i in range(1000)]
    rows += [(f"http://h.net/spam/{i}", int(i % 20 != 0)) for i in range(1000)]
    rows += [("http://h.net/thin/1", 0), ("http://h.net/thin/2", 1)] + [(f"http://h.net/thin/u{i}", None) for i in range(500)]
    out = _judged(spark, rows)
    assert (out["/clean/5"]["template"], out["/clean/5"]["verdict"]) == ("/clean/*", "allow")
    assert (out["/spam/5"]["template"], out["/spam/5"]["verdict"]) == ("/spam/*", "block")
    assert out["/thin/u5"]["template"] == "/thin/*"


def test_url_small_section_is_told_by_its_labels(spark):
    """200 pages, all bad, beside 12,300 good ones are 1.6 % of the rows, yet a branch; many sections of noise are not."""
    rows = [(f"http://h.net/s{i % 123}/{i}", int(i % 100 == 0)) for i in range(12300)]
    rows += [(f"http://h.net/casino/{i}", 1) for i in range(200)]
    out = _judged(spark, rows)
    assert (out["/casino/7"]["template"], out["/casino/7"]["verdict"]) == ("/casino/*", "block")
    assert {r["verdict"] for p, r in out.items() if not p.startswith("/casino/")} == {"allow"}


def test_url_deep_sections_with_labels_are_opened(spark):
    """Below DEPTH segments a node with labels goes on; one without ends in ``**``."""
    rows = [(f"http://h.net/a/b/c/d/good/{i}", 0) for i in range(300)] + [(f"http://h.net/a/b/c/d/bad/{i}", 1) for i in range(300)]
    rows += [(f"http://plain.net/a/b/c/d/e/{i}", None) for i in range(20)]
    out = _judged(spark, rows)
    assert (out["/a/b/c/d/bad/1"]["template"], out["/a/b/c/d/bad/1"]["verdict"]) == ("/a/b/c/d/bad/*", "block")
    assert (out["/a/b/c/d/good/1"]["template"], out["/a/b/c/d/good/1"]["verdict"]) == ("/a/b/c/d/good/*", "allow")
    assert out["/a/b/c/d/e/1"]["template"] == "/a/b/c/d/**"


def test_url_merging_equals_the_sql(spark, tmp_path):
    """Sections of many shares, ties and thin ones against the SQL of the definition, with a clashing extra column."""
    rows, labels = [], []
    for s in range(60):
        for i in range(5 + 13 * (s % 9)):
            doc = s * 1000 + i
            rows.append((len(rows), f"http://{'h' if s % 3 else 'k'}.net/s{s}/x{i % 3}/{doc}", "x"))
            if i % 4:
                labels.append((doc, int((i * 7 + s) % 11 < s % 12), 0))
    rows += [(len(rows) + i, None, None) for i in range(3)]
    spark.createDataFrame(rows, "page_id long, url string, template string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op1_url_filters"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        for t in ("pages", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        found = con.sql(SQL["op1_url_filters"])
        want = {tuple(r) for r in found.project(", ".join(got[0].asDict())).fetchall()}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert len({r["template"] for r in got}) > 6 and {r["verdict"] for r in got} == {"allow", "block"}


def test_url_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(df, URL_RULES, F.lit(None).cast("int")).count() == 0


# --- 3: sharding ---------------------------------------------------------------------------------------------------------


def jump(key: int, n: int) -> int:
    key, last, following = key % 2**64, -1, 0
    while following < n:
        last = following
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        following = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 63, 200, 1000])
def test_jump_equals_brute_force(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345, *range(50, 250), *(k * 7919**4 % 2**62 for k in range(100))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()}
    assert got == {k: jump(k, shards) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    out = sharding.assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", 8)
    moved = out.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 8").count() == 0
    assert abs(moved.count() / 20_000 - 1 / 9) < 0.02


def test_shard_table_on_odd_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (None, None, None), (None, "", "y"), (2, "ä" * 50_000, "z"), (-3, "c", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").withColumn("slot", F.lit("clash"))
    got = sharding.shard_table(df, "doc_id", "text", 8).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["shard"] == jump(r["doc_id"] or 0, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(1, None), (1, 0)}
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 2} == {(100_001, zlib.crc32(("ä" * 50_000).encode()))}
    assert sharding.shard_table(df.limit(0), "doc_id", "text", 8).count() == 0


# --- 6: quality rules ----------------------------------------------------------------------------------------------------


def measures(text):
    text = text or ""
    tokens = WORD.findall(text)
    windows = Counter(tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2))
    repeated = {p for i in range(len(tokens) - 2) if windows[tuple(tokens[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(tokens), sum(map(len, tokens)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(repeated),
    )


ODD_TEXTS = [
    None, "", "   ", "\n\n", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "a b c x a b c", "x\x85y\u00a0z \u2003w", "\x0b\x0ca\rb\tc\n",
    "one line\none line\n\none line ", "#*$%&|<> # 😀 ä", "a b c d " * 400, " ".join(str(i) for i in range(3000)) + " 1 2 3", ("w " * 5000), "😀😀 é",
    " ".join(f"a{i % 700}" for i in range(2000)),
]


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.describe(df).collect():
        assert tuple(r[n] for n in names) == measures(ODD_TEXTS[r["doc_id"]]), ODD_TEXTS[r["doc_id"]]


def test_op6_base_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    judged = QUERIES["op6_quality_rules"](spark, SMALL)
    assert not python_nodes(judged)
    rows = judged.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        failed = n < 50 or 100 * repeats > 50 * n
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        body = " ".join(f"w{(i * 37 + k * k) % 991}{k}" for k in range(80))
        bad = i % 4 == 0
        if bad:
            body = " ".join(w + "%%%" for w in body.split())
        rows.append((i, body, "en", "s", len(body)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_rules_are_learned_and_applied(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = quality.quality_table(docs, marks).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in judged)
    learned = quality.learn_rules(quality.describe(docs), marks)
    # symbols and longer words tell the classes apart alike; one condition midway between them is enough
    assert len(learned) == 1 and len(learned[0]) == 1 and learned[0][0].above and learned[0][0].measure in ("word_length", "symbol_rate")
    kept = quality.keep_good(docs.withColumn("n_words", F.lit("own")), marks)
    assert kept.columns == [*docs.columns, "n_words"] and kept.where("n_words = 'own'").count() == 450


def test_rules_without_labels_or_rows(spark):
    rows, _ = corpus(20)
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_table(docs, none).where("kept").count() == 20
    assert quality.quality_table(docs.limit(0), none).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert quality.keep_good(docs, nulls).count() == 20


# --- 9: mixing -----------------------------------------------------------------------------------------------------------


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    held, total = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in held]
        level = (total - sum(most * sizes[s] for s in held)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in held else weight[s] * level for s in order}
        held |= over


def mixed_docs(spark):
    rows = []
    for i in range(900):
        source = ["a", "b", "B", "ä", None, "z"][min(i % 9, 5)]
        rows.append((i, " ".join(["w"] * (1 + i * i % 97)), "en", source, 0))
    rows += [(900, None, "en", "a", 0), (901, " ", None, "empty", 0), (None, "x y", "en", "a", 0), (5, "twice same", "en", "b", 0), (5, "twice same", "en", "b", 0)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_mix_reaches_targets(spark):
    rows, docs = mixed_docs(spark)
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    first = mixing.mix(docs, (5, 2, 1), 1.5).collect()
    assert len(first) == len(rows)
    taken = Counter()
    for r in first:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 50 for s in want)
    again = mixing.mix(docs.repartition(3), (5, 2, 1), 1.5).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_mix_documents_repeats_rows(spark):
    rows, docs = mixed_docs(spark)
    plan = mixing.mix(docs, (5, 2, 1), 1.5, keep=("doc_id", "text")).groupBy("doc_id", "source", "text").agg(F.sum("copies").alias("n"))
    out = mixing.mix_documents(docs.withColumn("size", F.lit("own")), (5, 2, 1), 1.5)
    assert out.columns == [*docs.columns, "size"]
    assert abs(out.select(F.sum(F.size(words(F.col("text"))))).first()[0] - plan.select(F.sum(F.size(words(F.col("text"))) * F.col("n"))).first()[0]) < 300
    most = out.groupBy("doc_id", "source", "text").count().agg(F.max("count")).first()[0]
    assert most <= 4


def test_repeated_rows_share_copies_exactly(spark):
    """Pairs of equal rows in partitions of their own: the running id of both is then 0 modulo their number."""
    rows = [(i, " ".join([f"w{i}"] * 10), "en", "s", 1) for i in range(40)]
    half = spark.createDataFrame(rows, DOCS).coalesce(1)
    docs = half.unionByName(half)
    drawn = mixing.mix(docs.withColumn("__mark", F.xxhash64("text")), (1,), 0.5, keep=("doc_id", "__mark"))
    want = {r["doc_id"]: r["n"] for r in drawn.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    got = Counter(r["doc_id"] for r in mixing.mix_documents(docs, (1,), 0.5).collect())
    assert got == want and sum(want.values()) == 40


def test_mix_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty, (5, 2, 1), 1.5).count() == 0 and mixing.mix_documents(empty, (5, 2, 1), 1.5).count() == 0


def chances(sizes, levels, due):
    """Probabilities in proportion to the levels, at most 1, whose expected words are those due."""
    sure = set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in sure]
        weighted = sum(levels[i] * sizes[i] for i in open_)
        factor = (due - sum(sizes[i] for i in sure)) / weighted if weighted else 0.0
        over = {i for i in open_ if sizes[i] and levels[i] * factor >= 1}
        if not over:
            return [1.0 if i in sure else levels[i] * factor for i in range(len(sizes))]
        sure |= {i for i in open_ if levels[i] >= min(levels[j] for j in over)}


def drawn_by_hand(rows, level, weights, share):
    """(id, text) -> words taken, summed over repeated rows, drawn source by source in plain Python."""
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken, seen = targets(sizes, weights, share), Counter(), Counter()
    for source in sizes:
        own = [r for r in rows if r[3] == source]
        n = [len(WORD.findall(r[1] or "")) for r in own]
        whole = math.floor(want[source] / sizes[source]) if sizes[source] else 0
        due = want[source] - whole * sizes[source]
        p = chances(n, [level(r[1]) for r in own], due)
        assert not sizes[source] or sum(a * b for a, b in zip(p, n)) == pytest.approx(due)
        due -= sum(n[i] for i in range(len(own)) if p[i] == 1)
        order = []
        for i, r in enumerate(own):
            parts = ["mix", r[0], hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else None, seen[r]]
            seen[r] += 1
            u = (int(hashlib.md5("|".join(str(x) for x in parts if x is not None).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            taken[r[0], r[1], source] += n[i] * (whole + (p[i] == 1 and n[i] > 0))
            if p[i] < 1:
                odds = max(p[i], 1e-9) / (1 - max(p[i], 1e-9))
                order.append((u / (1 - u) / odds, i))
        before = 0
        for _, i in sorted(order):
            taken[own[i][0], own[i][1], source] += n[i] * (n[i] > 0 and before + n[i] / 2 <= due)
            before += n[i]
    return taken


@pytest.mark.parametrize("share", [0.3, 1.5])
def test_mix_draws_by_importance_as_by_hand(spark, monkeypatch, share):
    """Unequal odds, some certain; a third of the rows without an id, a third one repeated row, in pieces of 7."""
    monkeypatch.setattr(mixing, "PIECE", 7)
    rows = [(i, " ".join(f"w{j % (1 + i % 7)}" for j in range(1 + i * i % 31)), "en", "ab"[i % 2], 0) for i in range(150)]
    rows += [(None, f"none {i} " * (1 + i % 4), "en", "a", 0) for i in range(149)] + [(None, None, "en", "a", 0)]
    rows += [(7000, "one and the same row", "en", "b", 0)] * 150

    def level(text):
        found = WORD.findall(text or "")
        return 1 + 4 * len(set(found)) // len(found) if found else 1

    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = mixing.mix(docs, (5, 2), share, importance=mixing.variety(F.col("text"))).collect()
    assert len(out) == len(rows)
    want, got = Counter(), Counter()
    for (number, _, source), n in drawn_by_hand(rows, level, (5, 2), share).items():
        want[number, source] += n
    for r in out:
        got[r["doc_id"], r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert +got == +want


def test_important_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * 10, "en", "s", 1 + 8 * (i % 2)) for i in range(4000)]
    docs, weight = spark.createDataFrame(rows, DOCS), F.col("n_chars")
    drawn = Counter(r["doc_id"] % 2 for r in mixing.mix(docs, (1,), 0.25, importance=weight).collect() if r["copies"])
    assert sum(drawn.values()) == 1000 and 860 <= drawn[1] <= 940  # nine in ten
    sure = Counter(r["doc_id"] % 2 for r in mixing.mix(docs, (1,), 0.75, importance=weight).collect() if r["copies"])
    assert sure[1] == 2000 and sure[0] == 1000


def test_unit_is_even():
    values = [(int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(5000)]
    assert math.isclose(sum(values) / 5000, 0.5, abs_tol=0.02)
