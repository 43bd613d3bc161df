import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from treeloom.llm import tokens as K

TEXTS = [None, "", " ", "Hello, world!  I'll say it's 12345 done.\n\n  x", "thtitiontion thhastre Onndor", "Ünïcode 字字     x\x85y ᠎\x1c end   ", "a" * 3000, "🙂🙃 don't DON'T", "\t\n \r\n  end\t", "https://x.y/z?q=1&r=%20"]


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=K.ranks(path), special_tokens={})


@pytest.mark.parametrize("words", [0, 40])
def test_tokens_are_those_of_the_library(spark, encoding, words):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = K.tokenize(df, K.vocabulary(), words=words, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert K.tokenize(df.limit(0), K.vocabulary(), words=words).count() == 0


def test_long_words_grow_with_their_length(spark, encoding):
    rnd = random.Random(3)
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    texts = ["a" * 61, "ab" * 700, "=" * 700, "-=" * 300, pick("ab", 2000), pick("etaoinshr", 100_000), "ÄÖ字" * 200, "1" * 999, " " * 500 + "x", pick("aä字🙂", 300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in K.tokenize(df, K.vocabulary(), words=0).collect():
        assert r["ids"] == encoding.encode_ordinary(r["text"]) and bytes(r["decoded"]).decode() == r["text"]


def test_every_token_is_the_merge_of_its_own_bytes(spark, encoding):
    v = K.vocabulary()
    tables = K._tables(spark, v)
    sample = [i for i in range(0, len(v.tokens), 7) if v.tokens[i]]
    df = spark.createDataFrame([(i, bytearray(v.tokens[i])) for i in sample], "i int, b binary")
    made = df.select("i", K.bound(tables, K._FOLD, lambda t: K.fold(df["b"], t, v)).alias("ids")).collect()
    assert all(r["ids"] == [r["i"]] for r in made)


def test_a_span_is_hashed_once_for_each_of_its_places(spark):
    # lambdas are interpreted: what is named twice is computed twice, at every span of every rare word
    tables = {k: F.col(k) for k in ("spans", "pieces")}
    assert str(K._found(F.col("span"), tables, K.vocabulary())).count("xxhash64") == 2


def test_lengths_that_go_beyond_the_end(spark, encoding):
    v = K.vocabulary()
    rnd = random.Random(5)
    tokens = [t for t in v.tokens if t and t.isascii() and t.isalpha()]
    heads = [t[: rnd.randint(4, len(t) - 1)] for t in tokens if len(t) > 8]  # longer tokens begin so, but the word ends
    words = [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 4))) + rnd.choice(heads) for _ in range(400)]
    words += [(b"".join(rnd.choice(tokens) for _ in range(60)))[:n] for n in (57, 58, 59, 60, 61) for _ in range(8)]
    tables = K._tables(spark, v)
    df = spark.createDataFrame([(w.decode(),) for w in words], "w string")
    for r in df.select("w", K.bound(tables, K._FOLD, lambda t: K.fold(df["w"], t, v)).alias("ids")).collect():
        assert r["ids"] == encoding.encode_ordinary(r["w"])


def test_full_tables_leave_keys_out():
    at = K._places([0] * 5 + [3], [1] * 5 + [4], 7)
    assert sorted(x for x in at.tolist() if x >= 0)[-1] == 5 and (at >= 0).sum() == 3


def test_query(spark, encoding):
    out = K.op5_bpe(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in out.collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
