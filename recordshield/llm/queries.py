"""The registered queries of this subpackage with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_bpe, langid, lexical, mixing, neighbours, prefix_trie, quality, sharding, simhash, substring, url_filter, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


#: The rules that go before the method.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

#: levels that the SQL writes out; the query itself goes on as long as nodes have labels
URL_LEVELS = 6


def _url_sql() -> str:
    """The levels of the tree written out one after the other."""
    u = url_filter
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'"
        for r in sorted(URL_RULES, key=lambda r: (-len(r), r))
        for h, _, p in [r.partition("/")]
    ) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items()) + " END"
    parts = [
        f"""
        rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split1 AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
        split2 AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                          regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split1),
        marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
        urls AS (SELECT page_id, host, path, bad FROM split2 LEFT JOIN marks
                 ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\\.[A-Za-z]+)?/?$', 1), '') AS BIGINT)),
        paths0 AS (SELECT host, path, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, '' AS template, false AS ended,
                          CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS segments FROM urls GROUP BY host, path)"""
    ]
    for d in range(URL_LEVELS):
        few = f"""CASE WHEN NOT ended AND len(segments) > {d} AND {d} >= {u.DEPTH}
                     AND sum(labelled) FILTER (NOT ended AND len(segments) > {d}) OVER (PARTITION BY host, template) < {u.MIN_LABELS} THEN true ELSE false END"""
        parts.append(f"""
        few{d} AS (SELECT *, {few} AS few FROM paths{d}),
        open{d} AS (SELECT host, path, n, labelled, bad, segments, CASE WHEN few THEN template || '/**' ELSE template END AS template, ended OR few AS ended
                    FROM few{d}),
        child{d} AS (SELECT host, template, segments[{d + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad
                     FROM open{d} WHERE NOT ended AND len(segments) > {d} GROUP BY 1, 2, 3),
        node{d} AS (SELECT host, template, sum(n) AS total, CASE WHEN sum(labelled) > 0 THEN sum(bad) / sum(labelled) END AS pool,
                     sqrt(ln(greatest(count(*) FILTER (labelled > 0), 1) * 2 / {u.CONFIDENCE}::DOUBLE) / 2) AS reach FROM child{d} GROUP BY 1, 2),
        apart{d} AS (SELECT * FROM (SELECT c.*, total, reach, CASE WHEN labelled > 0 AND abs(bad / labelled - pool) > reach / sqrt(labelled)
                     THEN floor(bad / labelled * {u.BINS}) END AS bin FROM child{d} c JOIN node{d} USING (host, template))
                     WHERE bin IS NOT NULL OR (n >= {u.MIN_ROWS} AND n >= total * {u.MIN_SHARE}::DOUBLE)),
        bin{d} AS (SELECT *, row_number() OVER (PARTITION BY host, template ORDER BY bin) AS i FROM
                   (SELECT host, template, bin, count(*) AS k, sum(labelled) AS l, sum(bad) AS b, max(reach) AS reach FROM apart{d} WHERE bin IS NOT NULL GROUP BY 1, 2, 3)),
        fold{d} AS (SELECT host, template, bin, i, bin AS start, k, l, b FROM bin{d} WHERE i = 1
                    UNION ALL SELECT host, template, bin, i, CASE WHEN differs THEN bin ELSE start END,
                      CASE WHEN differs THEN k2 ELSE k + k2 END, CASE WHEN differs THEN l2 ELSE l + l2 END, CASE WHEN differs THEN b2 ELSE b + b2 END
                    FROM (SELECT n.host, n.template, n.bin, n.i, f.start, f.k, f.l, f.b, n.k AS k2, n.l AS l2, n.b AS b2,
                          n.b / n.l - f.b / f.l > n.reach * (sqrt(n.k / n.l) + sqrt(f.k / f.l)) AS differs
                          FROM fold{d} f JOIN bin{d} n ON n.host = f.host AND n.template = f.template AND n.i = f.i + 1)),
        member{d} AS (SELECT a.host, a.template, segment, coalesce(start, -1) AS start FROM apart{d} a LEFT JOIN fold{d} f
                      ON a.host = f.host AND a.template = f.template AND a.bin = f.bin),
        name{d} AS (SELECT host, template, start, CASE count(*) WHEN 1 THEN min(segment) WHEN 2 THEN '{{' || min(segment) || '|' || max(segment) || '}}'
                     ELSE '{{' || min(segment) || '|..|' || max(segment) || '}}' END AS branch FROM member{d} GROUP BY 1, 2, 3),
        branch{d} AS (SELECT host, template, segment, branch FROM member{d} JOIN name{d} USING (host, template, start)),
        paths{d + 1} AS (SELECT p.host, p.path, p.n, p.labelled, p.bad, ended,
                     CASE WHEN NOT ended AND len(segments) > {d} THEN p.template || '/' || coalesce(b.branch, '*') ELSE p.template END AS template, segments
                     FROM open{d} p LEFT JOIN branch{d} b ON p.host = b.host AND p.template = b.template AND p.segments[{d + 1}] = b.segment)""")
    parts.append(f"""
        templates AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM paths{URL_LEVELS} GROUP BY 1, 2),
        every AS (SELECT coalesce(sum(bad) / sum(labelled), 0) AS rate FROM templates),
        hosts AS (SELECT host, (sum(bad) + {u.PRIOR}::DOUBLE * any_value(rate)) / (sum(labelled) + {u.PRIOR}::DOUBLE) AS host_bad
                  FROM templates, every GROUP BY host),
        purity AS (SELECT t.host, t.template, 1 - (bad + {u.PRIOR}::DOUBLE * host_bad) / (labelled + {u.PRIOR}::DOUBLE) AS purity
                   FROM templates t JOIN hosts h ON t.host = h.host),
        ruled AS (SELECT page_id, host, path, {rule} AS rule FROM urls)
        SELECT page_id, r.host, r.path, rule, coalesce({verdict}, CASE WHEN purity < {u.MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
               d.template, round(purity, 6) AS purity
        FROM ruled r JOIN paths{URL_LEVELS} d ON r.host = d.host AND r.path = d.path JOIN purity p ON d.host = p.host AND d.template = p.template""")
    return "WITH RECURSIVE " + ",".join(parts)


@query("op1_url_filters", _url_sql())
def op1(spark: SparkSession, sf: str) -> DataFrame:
    pages = url_filter.label_pages(table(spark, sf, "pages"), table(spark, sf, "labels"))
    return url_filter.judge_urls(pages, URL_RULES, F.col("bad"))


SHARDS = 8


def _crc_table() -> str:
    """The table of the checksum, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return ", ".join(map(str, out))


_SHARD_SQL = f"""
    WITH RECURSIVE jumps(doc_id, key, last, next, n) AS (
        SELECT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END, -1::BIGINT, 0::BIGINT, n
        FROM (SELECT DISTINCT coalesce(doc_id, 0) AS doc_id FROM documents), (VALUES ({SHARDS}), ({SHARDS + 1})) v(n)
        UNION ALL
        SELECT doc_id, key2, next, floor((next + 1) * (2147483648.0::DOUBLE / ((key2 // 8589934592) + 1)::DOUBLE))::BIGINT, n
        FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS key2 FROM jumps WHERE next < n)
    ),
    shards AS (SELECT doc_id, max(last) FILTER (n = {SHARDS}) AS shard, max(last) FILTER (n = {SHARDS + 1}) AS grown_shard FROM jumps GROUP BY doc_id),
    crc AS (SELECT [{_crc_table()}]::BIGINT[] AS t),
    facts AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, CASE WHEN text IS NOT NULL THEN
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
                        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) END AS text_crc32 FROM documents, crc)
    SELECT f.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY f.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
    FROM facts f JOIN shards s ON s.doc_id = coalesce(f.doc_id, 0)
"""


@query("op3_sharding", _SHARD_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_table(table(spark, sf, "documents"), "doc_id", "text", SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.quality_table(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


#: Weights of the sources in turn, share of all words, most copies.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = (5, 2, 1), 1.5, 2
MIX_SEED = "mix"

_MIX_SQL = f"""
    WITH texts AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS found,
                          row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS place FROM documents),
    docs AS (SELECT doc_id, source, len(found)::BIGINT AS size,
                    CASE WHEN len(found) > 0 THEN 1 + (4 * len(list_distinct(found))) // len(found) ELSE 1 END AS level,
                    (('0x' || substr(md5(concat_ws('|', '{MIX_SEED}', doc_id, md5(text), place)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM texts),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    ranked AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM totals),
    ordered AS (SELECT *, {MIX_MOST} * source_size::DOUBLE AS cap, {MIX_MOST} * source_size / weight AS ratio FROM ranked),
    heads AS (SELECT ratio, ({MIX_SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
              FROM ordered WINDOW p AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    water AS (SELECT min_by(level, ratio) FILTER (ratio >= level) AS level FROM heads),
    plan AS (SELECT source, source_size, least(cap, weight * level) AS target,
                    CASE WHEN source_size > 0 THEN floor(least(cap, weight * level) / source_size) ELSE 0 END AS whole FROM ordered, water),
    levels AS (SELECT source, level, sum(size)::BIGINT AS n FROM docs GROUP BY source, level),
    steps AS (SELECT l.source, level, n, target - whole * source_size AS open,
                     coalesce(sum(n) OVER (PARTITION BY l.source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
                     (sum(level * n) OVER (PARTITION BY l.source ORDER BY level))::BIGINT AS rest
              FROM levels l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source),
    marked AS (SELECT *, rest > 0 AND level * (open - above) >= rest AS is_full FROM steps),
    solved AS (SELECT source, min(level) FILTER (is_full) AS certain, open - coalesce(sum(n) FILTER (is_full), 0)::BIGINT AS due,
                      (sum(level * n) FILTER (NOT is_full))::BIGINT AS weighted FROM marked GROUP BY source, open),
    chances AS (SELECT doc_id, size, u, p.source, source_size, target, whole, due, coalesce(level >= certain, false) AS sure,
                       least(greatest(CASE WHEN weighted > 0 THEN level * (due / weighted) ELSE 0 END, {mixing.EDGE}::DOUBLE), 1 - {mixing.EDGE}::DOUBLE) AS chance
                FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source JOIN solved s ON d.source IS NOT DISTINCT FROM s.source),
    ranks AS (SELECT *, sum(CASE WHEN sure THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (chance / (1 - chance)), doc_id
                                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM chances)
    SELECT doc_id, size, source_size, target,
           (size * (whole + CASE WHEN size > 0 AND (sure OR coalesce(earlier, 0) + size / 2 <= due) THEN 1 ELSE 0 END))::BIGINT AS taken FROM ranks
"""


@query("op9_mix_sources", _MIX_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST, MIX_SEED, mixing.variety(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return substring.dedup_table(table(spark, sf, "documents"))


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = vocabulary()
    return bpe.encode_table(table(spark, sf, "documents"), path, pattern, ["n_tokens", "ids_sha256", "decoded_sha256"])


@query("op7_language_id")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return langid.identify(docs, langid.learn(docs))


@query("op10_warc")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_records(index, folder, payloads=False).drop("url", "payload")


_TRIE_SQL = f"""
    WITH own AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM
                 (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
                         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
                  FROM conversations WHERE conv_id IS NOT NULL)),
    crc AS (SELECT [{_crc_table()}]::BIGINT[] AS t),
    convs AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base,
                     xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
                                     lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) % 4 AS h
              FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY 1), crc),
    starts AS (SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) AS taken, c.h FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
    rebuilt AS (SELECT c.conv_id, o.pos AS place, o.key, o.words FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
                UNION ALL SELECT s.conv_id, taken + pos - h AS place, key, words FROM starts s JOIN own o ON o.conv_id = s.conv_id AND o.pos >= s.h),
    lists AS (SELECT conv_id, coalesce(keys, []) AS keys, coalesce(counts, []) AS counts FROM convs LEFT JOIN
              (SELECT conv_id, list(key ORDER BY place) AS keys, list(words ORDER BY place) AS counts FROM rebuilt GROUP BY 1) USING (conv_id)),
    members AS (SELECT conv_id, d, keys[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE counts[d] END AS words, d = len(keys) AS ends
                FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM lists)),
    nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
    children AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path),
    totals AS (SELECT path[1:up] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
               FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM valued) GROUP BY 1)
    SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
    FROM valued v JOIN totals t ON t.path = v.path LEFT JOIN nodes p ON v.d > 0 AND p.path = v.path[1:v.d - 1]
"""


@query("op11_prefix_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.turns(table(spark, sf, "conversations"))))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LEXICAL_SQL = f"""
    WITH doc_terms AS (SELECT doc_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_TERM}') AS terms FROM documents),
    item_terms AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_TERM}')) AS term FROM benchmark),
    total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc_terms WHERE len(terms) > 0),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms)
               WHERE term IN (SELECT term FROM item_terms) GROUP BY 1, 2),
    weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
                FROM (SELECT term, count(*) AS df FROM counts GROUP BY 1), total),
    sizes AS (SELECT doc_id, 100 - 25 + (25 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM doc_terms, total),
    scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
               FROM (SELECT item_id, term, count(*) AS times FROM item_terms GROUP BY 1, 2) JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id)
               GROUP BY 1, 2),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 20
"""


@query("op12_lexical_search", _LEXICAL_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 20)


@query("op13_bpe")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return chunk_bpe.encode_table(table(spark, sf, "documents"), path, ["n_tokens", "ids_sha256", "decoded_sha256"])
