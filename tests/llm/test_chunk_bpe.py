"""BPE with chunk reuse against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordshield.llm import chunk_bpe
from recordshield.llm.bpe import read_vocabulary
from recordshield.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
RESULTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def check(spark, library, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in chunk_bpe.encode_table(docs, PATH, RESULTS).collect()}
    assert got == {i: want(library, t) for i, t in enumerate(texts)}


def odd_text(rng, n):
    signs = "aB1 .,'’\n\t  \u0085\x1ćéﬁ가İßΣς̣ͅ‍漢字😀'll're<|endoftext|><|startoftext|>　\x00"
    return "".join(rng.choice(signs) for _ in range(n))


def test_query_equals_library(spark, library):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_bpe"](spark, SMALL).collect()}
    assert got == {r["doc_id"]: want(library, r["text"]) for r in rows}


def test_odd_texts(spark, library):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "é ́e", "x" * 5000, "漢" * 3000, "İ" * 700]
    texts += [odd_text(rng, rng.randint(1, 3000)) for _ in range(60)]
    check(spark, library, texts + texts[:20])


def test_shared_passages_are_encoded_once(spark, library):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(900), "".join(rng.choice("abcdefgh漢字") for _ in range(6000)), odd_text(rng, 5000)]
    texts = [prose(rng.randint(0, 200)) + rng.choice(["", " ", "x"]) + passages[i % 3] + rng.choice(["", " ", "y"]) + prose(rng.randint(0, 200)) for i in range(60)]
    check(spark, library, texts + [texts[0]] * 40 + [passages[0]])
    codec = chunk_bpe.Vocabulary(read_vocabulary(PATH))
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "body binary").select(F.unhex(F.md5("body")).alias("digest"), "body")
    chunks = chunk_bpe.chunk_table(docs)
    found = chunk_bpe.shared_chunks(chunks).collect()
    marks = [x for r in found for x in r["shared"]]
    owners = [x["chunk"] for x in marks if x["here"]]
    assert len(found) >= 40 and len(owners) == len(set(owners)) and {x["chunk"] for x in marks} == set(owners)
    by_digest = {hashlib.md5(t.encode()).digest(): t.encode() for t in texts}
    pool, plans = {}, {}
    for r in found:
        plans[r["digest"]], own = chunk_bpe.encode_parts(codec, by_digest[bytes(r["digest"])], [(x["place"], bytes(x["chunk"]), x["here"]) for x in r["shared"]])
        pool.update(own)
    assert len(pool) == len(owners)
    for digest, parts in plans.items():
        ids = b"".join(pool[chunk] if chunk else ids for chunk, ids in parts)
        assert codec.ids(ids).tolist() == library.encode(by_digest[bytes(digest)].decode(), add_special_tokens=False).ids


def test_cuts_follow_from_the_bytes_around(monkeypatch):
    rng = random.Random(7)
    body = bytes(rng.choice(b"abcdef ") for _ in range(60_000))
    whole = chunk_bpe.cuts(body)
    assert whole[0] == 0 and whole[-1] == len(body) and len(whole) > 50 and whole == sorted(set(whole))
    moved = [c - 777 for c in chunk_bpe.cuts(bytes(rng.choice(b"xyz") for _ in range(777)) + body)]
    assert len(set(whole) & set(moved)) > 0.9 * len(whole)
    monkeypatch.setattr(chunk_bpe, "SLICE", 5000)
    assert chunk_bpe.cuts(body) == whole
    assert chunk_bpe.cuts(b"") == [0] and chunk_bpe.cuts(b"a") == [0, 1]
    assert b"".join(chunk_bpe.slices(body, 10, 59_000)) == body[10:59_000]


def test_ids_pass_through_and_decode(spark, library):
    docs = spark.createDataFrame([(1, "Hello World", "x"), (None, None, "y")], "doc_id long, text string, `chunk` string")
    out = chunk_bpe.encode_table(docs, PATH, ["ids", "n_tokens"], keep=["doc_id", "chunk"])
    rows = {r["chunk"]: r for r in chunk_bpe.decode_table(out, PATH, keep=["doc_id", "chunk", "ids", "n_tokens"]).collect()}
    ids = library.encode("Hello World", add_special_tokens=False).ids
    assert rows["x"]["ids"] == ids and rows["x"]["decoded"] == library.decode(ids, skip_special_tokens=False) and rows["x"]["n_tokens"] == len(ids)
    assert rows["y"]["ids"] == [] and rows["y"]["decoded"] == "" and rows["y"]["doc_id"] is None
    assert chunk_bpe.encode_table(docs.limit(0), PATH, RESULTS).count() == 0
    with pytest.raises(ValueError):
        chunk_bpe.encode_table(docs, PATH, RESULTS, keep=["n_tokens"])
