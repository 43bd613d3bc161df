import numpy as np
from pyspark.sql import functions as F
from treeloom.llm import neighbours as N


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = min(ok.get(i, v), v)
    out = []
    for q, v in ok.items():
        if q % 50:
            continue
        found = []
        for c, w in ok.items():
            if c != q and len(w) == len(v):
                s = float(N.cosine(np.array([v], float), np.array([w], float))[0])
                found.append((-s, c))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in N.nearest(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_factor_one_is_exact(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=6).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # many copies: ties
    rows += [(2000, None), (2050, []), (2100, [0.0] * 6), (2150, [1.0, None] + [0.0] * 4), (2200, [float("nan")] + [1.0] * 5), (2250, [float("inf")] + [1.0] * 5), (2300, [1.0, 2.0]), (2301, [2.0, 1.0]), (None, [1.0] * 6), (50, rows[50][1]), (100, [9.0] * 6)]
    monkeypatch.setattr(N, "SHARD", 256)
    monkeypatch.setattr(N, "QUERIES", 8)
    assert run(spark, rows) == brute(rows)


def test_relaxed_factor_prunes_and_keeps_recall():
    rnd = np.random.default_rng(5)
    points = rnd.normal(size=(3000, 8))
    ids = np.arange(3000)
    exact, near = N.Best(points[:100], ids[:100], 5), N.Best(points[:100], ids[:100], 5)
    tree = N.Tree.grow(N.unit(points))
    N.search(tree, points, N.unit(points), ids, exact, 1.0)
    N.search(tree, points, N.unit(points), ids, near, 0.7)
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact.found, near.found, strict=True)])
    assert 0.9 <= recall <= 1


def test_empty_table_and_few_candidates(spark):
    assert run(spark, []) == []
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 2


def test_grid_of_tasks_is_exact_and_joins_nothing(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rnd.normal(size=3).astype(np.float32)]) for i in range(3000)]
    rows += [(i, [1.0, float(i % 7 - 3)]) for i in range(3000, 3400)] + [(100, rows[100][1])] * 300
    for name, value in (("SHARD", 64), ("QUERIES", 8), ("HELD", 40), ("GROUPS", 5)):
        monkeypatch.setattr(N, name, value, raising=False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = N.nearest(df, F.col("vec_id") % 50 == 0)
    # a block of queries is not sent to every shard, and no side of a join to the driver
    assert "Join" not in near._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in near.collect()) == brute(rows)
