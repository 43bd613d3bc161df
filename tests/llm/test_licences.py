import math

from treeloom.llm import licences as L


def test_headers_files_and_inheritance(spark):
    mit = "Released under the MIT License."
    rows = [
        ("lib/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        ("lib/a/x.py", "# some code without a header\nprint(1)\n" * 20),
        ("lib/a/b/y.py", "code\n" * 30 + "Licensed under the Apache License, Version 2.0.\n" + "code\n" * 30),
        ("lib/a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("lib/a/c/d/z.py", "nothing here"),
        ("other/q.py", "plain words and a licence plate"),
        ("other/r.py", None),
        (None, "text without a path"),
        ("top", ""),
        ("lib/a/x.py", "# some code without a header\nprint(1)\n" * 20),
        ("big/p.py", "word " * 100_000 + "\n" + mit + "\n" + "word " * 100_000),
    ]
    df = spark.createDataFrame([(i, p, t, 1) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, how int")
    got = {r["doc_id"]: (r["licence"], r["how"]) for r in L.scan(df).collect()}
    none = (None, "none")
    assert got == {0: ("MIT", "file"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "header"), 3: ("GPL-3.0", "file"), 4: ("GPL-3.0", "inherited"), 5: none, 6: none, 7: none, 8: none, 9: ("MIT", "inherited"), 10: ("MIT", "header")}
    assert L.scan(df.limit(0)).count() == 0


def test_every_template_is_its_own_licence():
    m = L.Matcher({}, 100)
    for name, variants in L.TEMPLATES.items():
        for v in variants:
            assert m.best(v)[1] == name


def test_frequencies_count_all_documents(spark):
    df = spark.createDataFrame([("the license",), ("license license",), (None,), ("",)], "text string")
    counts, n = L.frequencies(df)
    assert n == 4 and counts["license"] == 2 and counts["the"] == 1


def _mit(name):
    return f"MIT License\n\nCopyright (c) 2020 {name}\n\n" + L._MIT.split("Copyright (c) ")[1].replace(", ", ",\n").replace(". ", ".\n\n")


def test_whole_licences_with_line_breaks_are_files(spark):
    bsd2, bsd3 = (f"Copyright (c) 2021, A B\n{L._BSD_HEAD}\n{x}{L._BSD_END}".replace(". ", ".\n").replace(", ", ",\n") for x in ("", L._BSD_THIRD + "\n"))
    apache = L.TEMPLATES["Apache-2.0"][1]
    rows = [("a/LICENSE", _mit("Jane Doe")), ("a/x/y.c", "int x;"), ("b/COPYING", bsd2), ("b/q.c", "int q;"), ("c/LICENSE.txt", bsd3), ("d/one", _mit("J D").replace("\n", " ")), ("e/LICENSE", "word " * 900 + apache), ("e/f.c", "int f;")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = [(r["licence"], r["how"]) for r in L.scan(df).orderBy("doc_id").collect()]
    assert got == [("MIT", "file"), ("MIT", "inherited"), ("BSD-2-Clause", "file"), ("BSD-2-Clause", "inherited"), ("BSD-3-Clause", "file"), ("MIT", "file"), ("Apache-2.0", "file"), ("Apache-2.0", "inherited")]


def test_notices_within_long_lines():
    m = L.Matcher({}, 100)
    for notice, name in ((L._MIT, "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), (L.TEMPLATES["GPL-3.0"][1], "GPL-3.0")):
        for before, after in (("word " * 30_000, " word" * 30_000), ("x();" * 9000, ";y();" * 9000), ("", " word" * 30_000)):
            assert m.licence(before + notice + after)[::2] == (name, False)


def test_cosines_are_those_of_plain_vectors():
    """Against dictionaries, words outside the templates with the weight of common ones."""
    df, n = {"license": 3, "the": 90, "software": 7}, 100
    m = L.Matcher(df, n)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in L.VOCABULARY}
    vector = lambda t: {w: (1 + math.log(c)) * idf.get(w, 1.0) for w, c in L.terms(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for text in ("Released under the MIT license by Jane", L._MIT + " Jane", "the software software is in the public domain", "free software"):
        v = vector(text)
        best = max((round(sum(x * v.get(w, 0.0) for w, x in u.items()) / norm(u) / norm(v), 9), name) for name, ts in L.TEMPLATES.items() for t in ts for u in [vector(t)])
        assert (round(m.best(text)[0], 9), m.best(text)[1]) == best


def test_query_against_the_matcher(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df, n = L.frequencies(spark.read.parquet(f"{sf}/documents.parquet"))
    m = L.Matcher(df, n)
    own = {i: m.licence(r["text"]) for i, r in docs.items()}
    best = {}
    for i, (name, score, file) in own.items():
        if file:
            best[docs[i]["source"]] = max(best.get(docs[i]["source"], (0.0, "")), (score, name))
    out = L.op6_licences(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        name, score, file = own[r["doc_id"]]
        above = best.get(docs[r["doc_id"]]["source"])
        want = (name, score, "file" if file else "header") if name else (above[1], above[0], "inherited") if above else (None, 0.0, "none")
        assert (r["licence"], r["score"], r["how"]) == want
