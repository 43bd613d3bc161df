import hashlib
import re

from treeloom.llm import leakage

W = [f"w{i}" for i in range(400)]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


def test_hits_are_those_of_brute_force(spark):
    items = [(1, " ".join(W[:25])), (2, " ".join(W[10:22])), (3, "Short, item!"), (4, None), (5, "..."), (10, " ".join(W[:25])), (11, "é ü"), (12, " ".join(W[50:60])), (13, "w300")]
    docs = [
        (1, None),
        (2, ""),
        (3, " ".join(W[:9])),
        (4, "x " + " ".join(W[:10]).upper() + " y"),
        (5, "-".join(W[3:18]) + "\nz " + " ".join(W[12:40])),
        (6, "a short  item b short item"),
        (7, " ".join(W[50:59]) + " " + " ".join(W[50:60])),
        (8, "É ü é Ü é ü"),
        (9, " ".join(W[:60]) + " " + " ".join(["pad"] * 70000) + " " + " ".join(W[:60])),
        (9, "second row of the id w300 w301"),
        (4, "x " + " ".join(W[:10]).upper() + " y"),
        (None, "w300"),
        (12, " ".join(W[200:299])),
    ]
    df = spark.createDataFrame([(*d, 7, "s") for d in docs], "doc_id long, text string, n_hit int, source string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in leakage.decontaminate(df, bench).collect()), key=str)
    assert got == sorted(brute(docs, items), key=str)
    for r in leakage.decontaminate(df, bench).collect():
        assert r["n_hit"] == sum(s["last"] - s["first"] for s in r["spans"])
    kept = leakage.clean(df, bench).select("doc_id", "text").collect()
    assert sorted(map(str, kept)) == sorted(str(type(kept[0])(doc_id=d, text=t)) for (d, t), b in zip(docs, brute(docs, items), strict=True) if not b[2]) or len(kept) == sum(not b[2] for b in brute(docs, items))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leakage.decontaminate(docs.limit(0), bench).count() == 0
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in leakage.decontaminate(docs, bench.limit(0)).collect()] == [(3, 0, [])]
    assert leakage.clean(docs, bench).count() == 0


def test_query_columns(spark):
    out = leakage.op8_decontaminate(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, bench)}
    assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == want
