import hashlib

import corpus_pipeline as C
import public_tokenizers
import tiktoken
from treeloom.llm import leakage, secrets, simhash, tokens

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    """Each stage on all that the one before kept, its result as Parquet, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"]: r for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "language":
            want = {i for i, r in kept.items() if any(c.isalpha() for c in r["text"] or "")}
        elif name == "near_duplicates":
            fps = {i: simhash.fingerprint((r["text"] or "").encode()) for i, r in kept.items()}
            root = {i: i for i in fps}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a in fps:
                for b in fps:
                    if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
            want = {i for i in fps if find(i) == i}
        elif name == "decontamination":
            words = lambda t: [w for w in "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t or "").split(" ") if w]
            wins = {tuple(w[j : j + min(10, len(w))]) for t in bench if (w := words(t)) for j in range(max(1, len(w) - 9))}
            sizes = {len(w) for w in wins}
            want = {i for i, r in kept.items() if not any(tuple(w[j : j + n]) in wins for w in [words(r["text"])] for n in sizes for j in range(len(w) - n + 1))}
        else:
            want = set(kept)
        assert set(got) == want, name
        if name == "secrets":
            changed = [i for i in want if got[i]["text"] != kept[i]["text"]]
            assert all(secrets.MASK in got[i]["text"] and len(got[i]["text"]) == got[i]["n_chars"] for i in changed)
        if name == "tokens":
            e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            for i in want:
                assert got[i]["ids"] == e.encode_ordinary(kept[i]["text"])
        kept = got
    assert leakage.WINDOW == 10


def test_run_is_registered(spark):
    assert "pipeline" in entry.queries() and [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert entry.queries()["pipeline"](spark, SF).count() > 0


def test_odd_documents(spark, tmp_path):
    """Nulls in any column, repeated rows and empty tables through every stage."""
    long = "plain words of a long text about rivers and woods " * 4000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, "one two three four five", "en", "a", 23), (4, "one two three four five", "en", "a", 23), (None, "another text without an id", None, "b", 26), (5, long, "en", "b", len(long)), (6, long, "en", "b", len(long))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    bench = spark.createDataFrame([("q", "nothing that is here"), ("r", None)], "item_id string, text string")
    for name, docs, items in (("odd", rows, bench), ("none", [], bench), ("nobench", rows, bench.limit(0))):
        sf = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
        items.write.parquet(f"{sf}/benchmark.parquet")
        out = C.run(spark, sf).collect()
        assert sorted((r["doc_id"] or 0) for r in out) == ([0, 4, 5] if docs else [])
        for r in out:
            text = next(t for i, t, *_ in rows if i == r["doc_id"])
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
