import numpy as np
import pytest
from treeloom.llm import toxicity as X

BAD = ["idiot", "scum", "moron"]


def texts(n, seed):
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = list(rnd.choice([f"w{k}" for k in range(60)], 40))
        g = int(rnd.choice([0, 0, 0, 1, 2]))
        for _ in range(0 if g == 0 else 1 if g == 1 else 3):
            w.insert(int(rnd.integers(len(w))), str(rnd.choice(BAD[:1] if g == 1 else BAD)))
        out.append((i, " ".join(w), g))
    return out


def test_grades_on_held_out_texts(spark):
    train, held = texts(600, 1), texts(200, 2)
    df = spark.createDataFrame(train, "doc_id long, text string, grade int")
    model = X.learn(df.select("doc_id", "text"), df.select("doc_id", "grade"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = X.grade(spark.createDataFrame(held, "doc_id long, text string, label int"), model).collect()
    assert np.mean([r["toxic"] == (r["label"] > 0) for r in out]) > 0.97
    mean = [np.mean([r["severity"] for r in out if r["label"] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_fit_is_near_the_likelihoods_top():
    rnd = np.random.default_rng(3)
    x = (rnd.random((3000, 2)) < 0.4).astype(int)
    score = x @ np.array([1.5, -1.0])
    u = rnd.logistic(size=3000)
    grade = ((score + u) > 0.5).astype(int) + ((score + u) > 2.0).astype(int)
    rows = [np.flatnonzero(r) for r in x]
    w, th = X._fit_links(rows, grade, np.array([0, 1]), 2)
    assert np.allclose(w, [1.5, -1.0], atol=0.25) and np.allclose(th, [0.5, 2.0], atol=0.25)


def test_yes_or_no_labels_are_graded_by_models_that_have_not_seen_the_row(spark):
    train, held = texts(1500, 5), texts(300, 6)
    df = spark.createDataFrame(train, "doc_id long, text string, grade int")
    model = X.learn(df.select("doc_id", "text"), df.selectExpr("doc_id", "cast(grade > 0 as int) as grade"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = X.grade(spark.createDataFrame(held, "doc_id long, text string, label int"), model).collect()
    mean = [np.mean([r["severity"] for r in out if r["label"] == g]) for g in range(3)]
    assert mean[0] < 0.2 < mean[1] < mean[2]
    pairs = [(a["severity"], b["severity"]) for a in out for b in out if a["label"] == 1 and b["label"] == 2]
    assert np.mean([a < b for a, b in pairs]) > 0.8


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "idiot " * 50_000, 1), (None, "scum", 1), (3, "idiot " * 50_000, 1)], "doc_id long, text string, grade int")
    for model in (X.learn(df, df.limit(0)), X.learn(df, df)):
        out = X.grade(df, model).collect()
        assert len(out) == 5 and [r["severity"] for r in out[:2]] == [0.0, 0.0]
    assert X.grade(df.limit(0), model).count() == 0


def test_query_catches_the_words_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    out = X.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    words = {"idiot", "clown", "scum", "pathetic", "worthless", "disgusting", "trash", "stupid", "moron", "loser"}
    bad = [bool(words & set("".join(c if c.isalpha() else " " for c in r["text"].lower()).split())) for r in out]
    hit = [r["toxic"] for r in out]
    assert sum(b and h for b, h in zip(bad, hit, strict=True)) >= 0.8 * sum(bad)
    assert sum(h and not b for b, h in zip(bad, hit, strict=True)) == 0
    assert pytest.approx(len(out)) == 1000
