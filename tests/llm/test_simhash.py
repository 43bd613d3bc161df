import re
from itertools import combinations

import xxhash
from treeloom.llm import simhash

LOREM = "the quick brown fox jumps over the lazy dog and runs away from the angry bear into deep woods near a river"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fp)."""
    root = {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
            root[find(b)] = find(a)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_fingerprints():
    for t in ("", "  \n", "One", "ONE two", LOREM, LOREM * 50, "ÄÖ ü x y z\x0bq", "a\x1cb c d e"):
        assert simhash.fingerprint(t.encode()) == brute_fp(t), t[:40]


def test_groups_of_documents(spark):
    texts = [None, "", "  ", LOREM, LOREM.upper(), LOREM + " now", LOREM * 3, LOREM * 3 + " x", "one", "two words", LOREM] + [f"{LOREM} {i % 7} {LOREM} {i}" for i in range(60)]
    rows = [(100 - i, t, i, "z") for i, t in enumerate(texts)] + [(None, LOREM, 0, "n"), (90, LOREM, 0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, __id string")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    want = dict(zip([(r[0], r[1]) for r in rows], zip([brute_fp(r[1]) for r in rows], brute_components([(r[0], brute_fp(r[1])) for r in rows]), strict=True), strict=True))
    for r in out:
        fp, comp = want[r["doc_id"], r["text"]]
        assert (int(r["fingerprint"], 16), len(r["fingerprint"]), r["component_id"]) == (fp, 16, comp)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_join_what_brute_force_joins(spark):
    """Crowded halves too: a ball of fingerprints about one centre, a long chain and lone ones."""
    import random

    rnd = random.Random(7)
    ball = {0x123456789ABCDEF0 ^ sum(1 << b for b in rnd.sample(range(20), k)) for k in (0, 1, 2, 3) for _ in range(120)}
    chain = [sum(1 << b for b in range(32, 32 + i)) for i in range(30)]
    fps = sorted(ball | set(chain) | {rnd.getrandbits(63) for _ in range(100)})
    assert len(ball) > 2 * simhash.CROWD
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    want = brute_components([(f, f) for f in fps])
    assert [got.get(f, f) for f in fps] == want


def test_one_of_each_group_stays(spark):
    rows = [(4, None, "e"), (5, "", "f"), (3, LOREM, "a"), (1, LOREM, "b"), (1, LOREM, "b"), (2, "other text here", "c"), (None, "no id here at all", "d"), (None, "no id here at all", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["__id"]) for r in out.collect()) == [(0, "d"), (0, "d"), (1, "b"), (2, "c"), (4, "e")]
    assert simhash.keep_one(df.where("doc_id > 1")).count() == 3 and simhash.keep_one(df.limit(0)).count() == 0
