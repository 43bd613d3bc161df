import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from treeloom.functions import alleles
from treeloom.functions.epochs import binned_epochs, default_epochs, refined
from treeloom.operators import cleaning, extract, intervals, mutation, tables, trees, windows
from treeloom.plans import inference, views
from treeloom.sources import read, write

DATA = "/root/testdata/sf0.001"


def test_epochs():
    e = default_epochs()
    assert len(e) == 31 and e[0] == 0 and e[1] == pytest.approx(1000 / 28) and e[30] == pytest.approx(1e8 / 28) and e[29] == pytest.approx(10 ** (3 + 4) / 28)
    b = binned_epochs("3,4,0.5", 1.0)
    assert b == pytest.approx([0, 1000, 10**3.5, 10**4, 1e8]) and refined([0, 5], [3, 3, 0]) == [0, 3, 5]
    with pytest.raises(ValueError):
        binned_epochs("4,3,0.5")


def test_contexts_and_bases(spark):
    rows = [(a, d, u, v) for a in "ACGT" for d in "ACGT" if a != d for u in "ACGT" for v in "ACGT"]
    df = spark.createDataFrame(rows, "a string, d string, u string, v string")
    got = df.select(alleles.context(*(F.col(c) for c in "aduv")).alias("c")).groupBy("c").count().collect()
    assert len(got) == 96 and {r["count"] for r in got} == {2}
    r = spark.sql("select 'acgTn' s, 'a' x, null y").select(alleles.reverse_complement("s").alias("r"), alleles.normal_base(F.col("y")).alias("n"), alleles.base_at(F.col("s"), F.lit(4)).alias("b"), alleles.base_at(F.col("s"), F.lit(9)).alias("o"), alleles.safe_name(F.lit("a;b")).alias("i")).first()
    assert tuple(r) == ("nAcgt", "N", "T", None, "a,b")


def test_selection_p(spark):
    def brute(n, fn, k, fk):
        return math.log10(sum(math.comb(f - 1, fk - 1) * math.comb(n - f - 1, k - fk - 1) for f in range(fn, n - k + fk + 1)) / math.comb(n - 1, k - 1))

    cases = [(20, 5, 6, 2), (20, 2, 3, 2), (20, 12, 8, 4), (20, 9, 19, 5)]
    df = spark.createDataFrame([c[1:] for c in cases], "fn int, k int, fk int")
    got = [r[0] for r in df.select(alleles.selection_log_p(20, F.col("fn"), F.col("k"), F.col("fk"))).collect()]
    for c, g in zip(cases, got, strict=True):
        n, fn, k, fk = c
        assert g == (pytest.approx(brute(*c), abs=1e-9) if fn <= n - k + fk else 1.0)
    assert spark.sql("select 1 fn, 5 k, 1 fk").select(alleles.selection_log_p(20, F.col("fn"), F.col("k"), F.col("fk"))).first()[0] == 1.0


def test_interval_join_is_brute_force(spark):
    rnd = np.random.default_rng(1)
    a = [(int(c), float(x), float(x + w)) for c, x, w in zip(rnd.integers(0, 2, 60), rnd.integers(-50, 300, 60), rnd.integers(0, 40, 60), strict=True)]
    b = [(int(c), float(x), float(x + w)) for c, x, w in zip(rnd.integers(0, 2, 60), rnd.integers(-50, 300, 60), rnd.integers(1, 90, 60), strict=True)]
    l, r = (spark.createDataFrame(x, "chrom int, lo double, hi double") for x in (a, b))
    want = sorted((*x, *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2])
    for bucket in (7, 50, 1000):
        got = sorted(tuple(t) for t in intervals.interval_join(l, r, bucket, ["chrom"]).select("chrom", "lo", "hi", "lo_r", "hi_r").collect())
        assert got == want


def test_interpolation_and_as_of(spark):
    m = spark.createDataFrame([(1, 10, 0.0), (1, 20, 1.0), (1, 20, 2.0), (1, 40, 4.0)], "chrom int, bp long, cm double")
    s = spark.createDataFrame([(1, p) for p in (5, 10, 15, 20, 30, 40, 50)], "chrom int, pos long")
    got = {r["pos"]: r["rpos"] * 100 for r in intervals.interpolate(s, m, ["chrom"]).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {5: 0, 10: 0, 15: 0.5, 20: 2, 30: 3, 40: 4, 50: 4}
    back = {r["pos"]: r["at"] for r in intervals.as_of(s, m, ["chrom"], "pos", "bp", ["cm"]).collect()}
    on = {r["pos"]: r["at"] for r in intervals.as_of(s, m, ["chrom"], "pos", "bp", ["cm"], forward=True).collect()}
    assert back == {5: None, 10: 10, 15: 10, 20: 20, 30: 20, 40: 40, 50: 40} and on == {5: 10, 10: 10, 15: 20, 20: 20, 30: 40, 40: 40, 50: None}
    runs = intervals.runs(spark.createDataFrame([(1, p, p % 5 > 1) for p in range(12)], "chrom int, p int, ok boolean"), ["chrom"]).where("ok").orderBy("lo").collect()
    assert [(r["lo"], r["hi"]) for r in runs] == [(2, 5), (7, 10)]


SITES = [("1", "r1", 10, "A", "C", "01100000"), ("1", "r2", 20, "G", "T", "11111111"), ("1", "r3", 20, "A", "G", "00000000"), ("1", "r4", 35, "AT", "C", "01010101"), ("1", "r5", 60, "C", "T", "00011110")]


@pytest.fixture()
def sites(spark):
    return spark.createDataFrame([(*s[:2], i, *s[2:]) for i, s in enumerate(SITES)], "chrom string, rsid string, snp_id int, pos long, anc string, alt string, gt string")


def test_cleaning(spark, sites):
    assert [r["rsid"] for r in cleaning.unique_positions(sites).orderBy("pos").collect()] == ["r1", "r4", "r5"]
    assert [r["rsid"] for r in cleaning.segregating(sites).orderBy("pos").collect()] == ["r1", "r4", "r5"]
    assert [r["rsid"] for r in cleaning.single_bases(sites).orderBy("snp_id").collect()] == ["r1", "r2", "r3", "r5"]
    flipped = cleaning.polarise(sites, F.lit("T"))
    assert {r["rsid"]: r["gt"] for r in flipped.collect()} == {"r2": "00000000", "r5": "11100001"}
    twice = sites.select(alleles.flip(alleles.flip(F.col("gt"))).alias("g"), "gt").where("g <> gt")
    assert twice.count() == 0
    kept = cleaning.remove_haplotypes(sites, [1, 2, 3])
    assert {r["rsid"]: r["gt"] for r in kept.collect()} == {"r1": "110", "r4": "101", "r5": "001"}
    with pytest.raises(Exception, match="unknown group"):
        cleaning.groups_of_interest(spark.createDataFrame([(0, "a")], "hap int, grp string"), "a,zz").collect()
    lines = spark.createDataFrame([("##x",), ("1\t5\trs;1\tA\tC\t.\t.\t.\tGT\t0|1\t1/1",), ("1\t6\tr\tA\tCG\t.\t.\t.\tGT\t0|1\t1|1",), ("1\t7\tr\tA\tC\t.\t.\t.\tGT:X\t0/0:1\t0|0:2",)], "value string")
    assert [tuple(r) for r in read.vcf(lines).collect()] == [("1", 5, "rs,1", "A", "C", "0111")]
    assert read.vcf(lines, polymorphic=False).count() == 2
    with pytest.raises(Exception, match="rise"):
        windows.check_rising(sites, ["chrom"]).collect()


def test_mask_filter(spark):
    bases = spark.createDataFrame([(1, p, p not in (3, 4, 5)) for p in range(1, 13)], "chrom int, p long, ok boolean")
    s = spark.createDataFrame([(1, p) for p in (1, 2, 3, 6, 9)], "chrom int, pos long")
    got = {r["pos"]: r["dist"] for r in cleaning.filter_by_mask(s, bases, reach=2, most=3).collect()}
    assert got == {1: 1, 2: 1, 6: 3, 9: 1}


def test_chunks_cover_every_site_once(spark):
    for n, size, overlap in ((10, 4, 2), (23, 10, 4), (5, 10, 4), (100, 30, 10)):
        s = spark.range(n).select(F.col("id").alias("snp_id"))
        got = windows.chunks(s, size, overlap, n - 1).where("core").groupBy("snp_id").count().collect()
        assert len(got) == n and {r["count"] for r in got} == {1}, (n, size, overlap)


def test_text_formats_round_trip(spark, sites, tmp_path):
    p = lambda x: str(tmp_path / x)
    write.write(write.haps_lines(sites), p("a.haps"), ["pos"], gzip=True)
    assert sorted(tuple(r) for r in read.haps(read.read(spark, p("a.haps"))).select("rsid", "pos", "gt").collect()) == sorted((s[1], s[2], s[5]) for s in SITES)
    (tmp_path / "plain").write_bytes(gzip.compress(b"1 x 5 A C 0 1 1 x\n"))
    assert read.haps(read.read_any(spark, p("plain"))).first()["gt"] == "011"
    t = views.trees(spark, DATA).where("chrom = 0")
    write.write(write.anc_lines(t), p("a.anc"), ["tree_id"], write.anc_header(8, t.count(), [0.0] * 8))
    back = {r["tree_id"]: r for r in read.anc(read.read(spark, p("a.anc"))).collect()}
    for i, r in enumerate(t.orderBy("tree_id").collect()):
        assert back[i]["start_snp"] == r["start_snp"] and [tuple(x) for x in back[i]["nodes"]] == [tuple(x) for x in r["nodes"]]
    assert read.anc_ages(read.read(spark, p("a.anc"))).count() == 8
    m = spark.createDataFrame([(0, 5, 3, "r0", 0, [4], False, 0.0, 2.5, "A/C", "G", None, {"x": 1, "y": 2}), (1, 8, 1, "r1", 0, [1, 2], True, 0.0, 0.0, "A/G", None, "T", {"x": 0, "y": 1})], "snp int, pos long, dist long, rsid string, tree_id int, branches array<int>, flipped boolean, age_begin double, age_end double, mutation_type string, upstream string, downstream string, freq map<string,int>")
    write.write(write.mut_lines(m, ["x", "y"]), p("a.mut"), ["snp"], write.mut_header(["x", "y"]))
    got = read.mut(read.read(spark, p("a.mut"))).orderBy("snp").collect()
    assert [(r["branches"], r["unmapped"], r["flipped"], r["age_end"], r["upstream"], r["downstream"], r["freq"]) for r in got] == [([4], False, False, 2.5, "G", None, {"x": 1, "y": 2}), ([1, 2], True, True, 0.0, None, "T", {"x": 0, "y": 1})]
    rates = spark.createDataFrame([("a", "b", e, r) for e, r in enumerate([0.5, None])], "group1 string, group2 string, epoch int, rate double")
    lines, header = write.coal_lines(rates, ["a", "b"], [0.0, 10.0])
    write.write(lines, p("a.coal"), ["line"], header)
    assert sorted((r["group1"], r["group2"], r["epoch"], r["lo"], r["rate"]) for r in read.coal(read.read(spark, p("a.coal"))).collect()) == [("a", "b", 0, 0.0, 0.5), ("a", "b", 1, 10.0, None)]
    rows = spark.createDataFrame([(5, "A", "C", 2, 4, [1.0, 2.0], [0.5])], "pos int, anc string, der string, daf int, n int, ancestral_times array<double>, derived_times array<double>")
    data = write.timeb(rows, 1).first()["data"]
    (tmp_path / "t.timeb").write_bytes((1).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(data))
    r = read.timeb(spark, p("t.timeb")).first()
    assert (r["pos"], r["anc"], r["daf"], r["ancestral_times"], r["derived_times"]) == (5, "A", 2, [1.0, 2.0], [0.5])


def test_small_formats(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string").coalesce(1)
    assert [(r["id"], r["ploidy"]) for r in read.samples(lines("ID_1 ID_2 missing", "0 0 0", "a a 0", "b NA 0")).orderBy("line").collect()] == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in read.genetic_map(lines("pos r cm", "10 0.5 0", "20 1 2.5")).orderBy("bp").collect()] == [(10, 0.5, 0.0), (20, 1.0, 2.5)]
    assert read.fasta(lines(">1", "acg", "TTn")).first()["sequence"] == "ACGTTN"
    pop = read.poplabels(lines("sample population group sex", "s1 A x NA", "s2 B x NA"))
    assert [tuple(r) for r in read.haplotype_groups(pop).orderBy("hap").collect()] == [(0, "A", "x"), (1, "A", "x"), (2, "B", "x"), (3, "B", "x")]
    with pytest.raises(Exception, match="one and of two"):
        read.poplabels(lines("h", "s1 A x 1", "s2 B x NA")).collect()
    assert [tuple(r) for r in read.dist(lines("#pos dist", "5 3")).collect()] == [(5, 3)]
    hap = read.hap_legend(lines("0 1", "1 1"), lines("id pos a0 a1 type", "r 5 A C Biallelic_SNP", "q 6 A C Multi"), "1")
    assert [tuple(r) for r in hap.collect()] == [("1", "r", 5, "A", "C", "01")]
    assert read.sample_ages(lines("0", "5", "7"), 3) == [0.0, 5.0, 7.0] and read.sample_ages(lines("1"), 3) == [0.0] * 3
    assert [tuple(r) for r in read.simulated(lines("ms 2 1", "//", "segsites: 3", "positions: 0.1 0.5 0.5", "010", "110"), 100).collect()] == [(0, 10, "01")]
    p, le, _ = read.parse_newick("((0:1,1:1):2,2:3);")
    assert p == [4, 4, 3, -1, 3] or p == [3, 3, 4, 4, -1]
    assert sorted(le) == [0.0, 1.0, 1.0, 2.0, 3.0]
    nw = read.newick_intervals(lines("h", "1\t0\t10\t0\t((0:1,1:1):2,2:3);")).first()
    assert trees.from_nodes(nw["nodes"]).heights().max() == 3
    assert read.coalescence_lists(lines("[10](0:1,1:1);", "[5](0:2,1:2);")).agg(F.max("end")).first()[0] == 15
    table = spark.createDataFrame([(u, v, a, d, i % 2) for i, (a, d) in enumerate((a, d) for a in "CA" for d in "ACGT" if a != d) for u in "ACGT" for v in "ACGT"], "up string, down string, anc string, der string, category int")
    assert mutation.checked_categories(table) is table
    with pytest.raises(ValueError):
        mutation.checked_categories(table.where("up <> 'A'"))


def test_subset_of_all_tips_is_the_tree(spark):
    t = views.trees(spark, DATA)
    s = trees.subtrees(t, list(range(8)))
    a = trees.with_heights(trees.packed(s.withColumns({"snp_begin": F.lit(0), "snp_end": F.lit(0)}))).groupBy("tree_id").agg(F.sum("height").alias("h")).collect()
    b = trees.with_heights(t).groupBy("tree_id").agg(F.sum("height").alias("h")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert extract.divided(t, t, 1, 2).agg(F.countDistinct("chrom", "part")).first()[0] >= 5
    nw = extract.tree_at(t, views.muts(spark, DATA), 0, 0, 25_000_000).collect()
    assert nw and all(r["newick"].endswith(";") for r in nw)
    m = views.muts(spark, DATA)
    moved = extract.moved_branches(m, t, [0, 3, 6]).agg(F.max("branch")).first()[0]
    assert moved <= 4


def test_tree_tables_are_sound(spark):
    t, m = views.trees(spark, DATA), views.muts(spark, DATA)
    ends = t.select("chrom", "tree_id", (F.col("tree_id") * 100.0).alias("lo"), (F.col("tree_id") * 100.0 + 500).alias("hi"))
    tab = tables.from_trees(t, m, ends)
    assert tables.check(tab).collect() == []
    assert tab["edges"].count() == 25 * 14 and tab["nodes"].where("is_sample = 1").count() == 40
    assert tables.sorted_edges(tab["edges"]).agg(F.max("rank")).first()[0] == 5 * 14
    assert tables.squashed(tab["edges"]).count() <= 25 * 14
    assert tables.edge_differences(tab["edges"]).agg(F.sum("n_in")).first()[0] == 25 * 14
    h = views.haps(spark, DATA).where("snp_id < 12 and hap < 40").select("snp_id", "hap", "allele")
    x = h.toPandas().pivot(index="snp_id", columns="hap", values="allele").to_numpy()
    ld = tables.linkage(h, 4).collect()
    assert len(ld) == sum(1 for a in range(12) for b in range(a + 1, 12) if b - a < 4)
    for r in ld:
        assert r["r2"] == pytest.approx(np.corrcoef(x[r["a"]], x[r["b"]])[0, 1] ** 2, abs=1e-9)
    gnn = tables.nearest_neighbours(t, [[0, 1, 2, 3], [4, 5, 6, 7]]).groupBy("tree_id", "tip").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9")
    assert gnn.count() == 0
    g = tables.genotypes_from_trees(m, trees.clade_rows(t), 8).select(F.length("gt").alias("n")).distinct().collect()
    assert [r["n"] for r in g] == [8]


def simulated_sites(spark, n=6, length=60, seed=4):
    """Sites of two trees, one after the other."""
    from treeloom.kernels import building

    rnd = np.random.default_rng(seed)
    rows = []
    for half in range(2):
        t = building.upgma(rnd.random((n, n)))
        c = [x for x in t.clades()[:-1]]
        for i in range(length // 2):
            k = half * length // 2 + i
            rows.append((1, k, 1000 * (k + 1), f"r{k}", "A", "C", "".join(str(c[(3 * i + half) % len(c)] >> j & 1) for j in range(n))))
    return spark.createDataFrame(rows, "chrom int, snp_id int, pos long, rsid string, anc string, alt string, gt string")


def test_inference_end_to_end(spark, tmp_path):
    s = simulated_sites(spark)
    gen, muts = inference.infer(s, 1e-6, 1000, chunk=40, overlap=10, most=300)
    gen.write.parquet(str(tmp_path / "g"))
    gen = spark.read.parquet(str(tmp_path / "g"))
    got = inference.mutations(gen).collect()
    assert sorted(r["snp_id"] for r in got) == list(range(60))
    assert sum(r["n_branches"] == 1 for r in got) >= 50
    assert all(r["age_end"] >= r["age_begin"] for r in got if r["branch"] is not None)
    h = trees.with_heights(gen.select("chrom", "tree_id", "nodes"))
    assert h.where("branch_length < 0").count() == 0
    ready = inference.prepare(s)
    chunks = inference.make_chunks(ready, 40, 10)
    assert inference.paint(chunks).where(F.size("topology") != 6).count() == 0
    best = inference.optimise(chunks, [0.001, 0.01], [1.0]).collect()
    assert len(best) == 2
    links = inference.equivalent_branches(gen)
    chains = inference.branch_chains(gen, links)
    assert chains.count() == h.count()
    kept = inference.map_sites(gen, s.withColumn("tree_id", F.lit(0))).where("kind < 3").count()
    assert kept >= 20
    rates, dated = inference.population_size(gen, ready, 1e-6, 1000, [0.0, 500.0, 2000.0], iterations=1, threshold=0.0, store=str(tmp_path / "loop"))
    assert rates.count() == 3 and rates.where("rate <= 0").count() == 0 and dated.count() == gen.count()


def test_streaming_windows_equal_batch(spark, tmp_path):
    from treeloom.streaming import events as E

    src = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1)
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = E.windowed(stream, "1 day", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("treeloom_events").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = spark.table("treeloom_events").select("start", "event_type", "n")
    want = E.windowed(src, "1 day").select("start", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert E.sessions(src).agg(F.sum("n")).first()[0] == src.count()


def test_registered_queries_read_all_haplotypes(spark):
    from treeloom.plans import more_queries, views

    d = "/root/testdata/sf0.001"
    n = views.haps(spark, d).select("hap").distinct().count()
    assert {r[0] for r in more_queries._sites(spark, d).select(F.length("gt")).collect()} == {n} and n > 24
    trees = views.trees(spark, d).count()
    assert trees > 3 and more_queries.m01(spark, d).select("tree_id").distinct().count() == trees


def test_dating_is_not_cut_below_the_kernel(spark, monkeypatch):
    from treeloom.kernels import dating

    g = spark.createDataFrame([(1, 0, [(2, 1.0), (2, 2.0), (-1, 0.0)])], "chrom int, tree_id int, nodes array<struct<parent:int,num_events:double>>")
    node = "transform(nodes, x -> struct(x.parent as parent, 0.0D as branch_length, x.num_events as num_events, 0 as snp_begin, 0 as snp_end))"
    g = g.withColumn("nodes", F.expr(node))
    s = spark.createDataFrame([(1, 10, 5)], "chrom int, pos long, dist long")
    own = int(np.random.SeedSequence([1, 0, *b"1"]).generate_state(1)[0])
    t = dating.Tree([2, 2, -1])
    want = dating.posterior_samples(t, [1.0, 2.0, 0.0], np.zeros(3), 1, None, own) * 2000.0
    got = inference.dated(g, s, 0.0, 1000.0, samples=1).first()["samples"]
    assert np.allclose(got, want)

    def move(self):
        self.moves = getattr(self, "moves", 0) + 1
        self.proposals[:] = dating.PROPOSALS if self.moves > 250_000 else 0
        ended.append(self.moves) if self.moves > 250_000 else None

    ended = []
    monkeypatch.setattr(dating.Chain, "move", move)
    dating.posterior_mean(t, [1.0, 2.0, 0.0], np.zeros(3))
    assert ended


def test_stretches_hand_on_what_whole_chromosomes_have(spark):
    """As-of joins, interpolation, distances and masks: any width of stretches gives what one stretch gives."""
    import random

    rnd = random.Random(4)
    rows = sorted({(rnd.randint(0, 1), rnd.randint(0, 400)) for _ in range(90)})
    s = spark.createDataFrame([(c, p, i) for i, (c, p) in enumerate(rows)], "chrom int, pos long, snp_id int")
    m = spark.createDataFrame([(c, b, float(b * b)) for c in (0, 1) for b in sorted(rnd.sample(range(400), 12))], "chrom int, bp long, cm double")
    bases = spark.createDataFrame([(c, p, rnd.random() < 0.7) for c in (0, 1) for p in range(300)], "chrom int, p long, ok boolean")
    key = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()), key=str)

    def all_of(width):
        return (
            key(intervals.as_of(s, m, ["chrom"], "pos", "bp", ["cm"], width=width), "snp_id", "at", "cm"),
            key(intervals.as_of(s, m, ["chrom"], "pos", "bp", ["cm"], True, width), "snp_id", "at", "cm"),
            key(intervals.interpolate(s, m, ["chrom"], width=width), "snp_id", "rpos"),
            key(windows.distances(s, ["chrom"], "pos", "snp_id", width=width), "snp_id", "dist"),
            key(cleaning.pass_mask(bases, reach=7, most=5, width=width), "chrom", "p", "failing_near", "failing_before"),
        )

    whole = all_of(10_000)
    for width in (8, 13, 50):
        assert all_of(width) == whole
    flags = {(c, p): ok for c, p, ok in map(tuple, bases.collect())}
    want = []
    for (c, p), ok in flags.items():
        near = sum(not flags.get((c, q), True) for q in range(p - 7, p + 8))
        if ok and near < 5:
            want.append((c, p, near, sum(not flags[c, q] for q in range(p))))
    assert whole[4] == sorted(want, key=str)


def test_pairs_are_summed_as_one_by_one(spark):
    from treeloom.functions.epochs import epochs
    from treeloom.operators import rates, trees
    from treeloom.plans import views

    t = views.trees(spark, "/root/testdata/sf0.001")
    spans = t.select("tree_id", (F.col("tree_id") + 1.5).alias("span"))
    grid = epochs(spark, [0.0, 4.0, 9.0, 20.0, 60.0], 1e9)
    get = lambda df: {(r["i"], r["j"], r["epoch"]): (r["num"], r["denom"]) for r in df.collect()}
    a, b = get(rates.pair_sums(t, spans, grid)), get(rates.pair_events(trees.pair_times(t), grid, spans))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_lines_from_a_shuffle_are_all_numbered(spark):
    from treeloom.sources import read

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        head = spark.createDataFrame([("head",)], "value string").coalesce(1)
        rows = spark.range(20000).select("id", F.concat_ws(";", F.col("id").cast("string"), F.repeat(F.lit("x"), 40)).alias("value")).repartition("id").drop("id")
        got = read.numbered(head.unionByName(rows)).select("line", F.substring_index("value", ";", 1).alias("value")).collect()
        assert sorted(r["line"] for r in got) == list(range(20001)) and len({r["value"] for r in got}) == 20001
        assert [r["value"] for r in got if r["line"] == 0] == ["head"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_mutation_parents_pair_branches_not_mutations(spark):
    from threading import Timer

    from treeloom.operators import tables

    clades = spark.createDataFrame([(1, 0, 0, [0]), (1, 0, 1, [1]), (1, 0, 2, [2]), (1, 0, 3, [0, 1]), (1, 0, 4, [0, 1, 2])], "chrom int, tree_id int, node int, tips array<int>")
    n = 60000
    rows = spark.range(n).select(F.col("id").alias("snp_id"), F.lit(1).alias("chrom"), F.lit(0).alias("tree_id"), F.lit(7).alias("pos"), (F.col("id") % 5).cast("int").alias("branch"))
    # a number on two branches, a position with no branch above, a mutation on no branch
    more = spark.createDataFrame([(-1, 1, 0, 9, 0), (-2, 1, 0, 9, 3), (-1, 1, 0, 9, 3), (-3, 1, 0, 9, 9)], "snp_id long, chrom int, tree_id int, pos int, branch int")
    timer = Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = tables.mutation_parents(rows.unionByName(more), clades).collect()
    finally:
        timer.cancel()
    want = {0: 3, 1: 3, 2: 4, 3: 4, 4: None}
    assert len(got) == n + 4 and all(r["parent"] == want[r["snp_id"] % 5] for r in got if r["snp_id"] >= 0)
    assert sorted(((r["snp_id"], r["parent"]) for r in got if r["snp_id"] < 0), key=str) == [(-1, -2), (-1, -2), (-2, None), (-3, None)]


def test_strings_of_many_haplotypes_take_linear_time(spark):
    from threading import Timer

    from treeloom.functions import alleles
    from treeloom.operators import cleaning, tables

    n = 200001
    gt = "".join("01"[i * i % 7 % 2] for i in range(n))
    keep = [i for i in range(n) if i % 5]
    sites = spark.createDataFrame([(1, s, s + 1, f"r{s}", "A", "C", gt) for s in range(4)], "chrom int, snp_id int, pos int, rsid string, anc string, alt string, gt string")
    timer = Timer(40, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        back = cleaning.genotypes(tables.vcf_lines(sites).select("value")).select("gt").collect()
        picked = cleaning.remove_haplotypes(sites, keep).select("gt").collect()
        odd = spark.createDataFrame([("01",), ("",), (None,)], "gt string").select(alleles.pick(F.col("gt"), [1, 0, 5]), alleles.pick(F.col("gt"), [])).collect()
    finally:
        timer.cancel()
    assert [r["gt"] for r in back] == [gt[:-1]] * 4
    assert [r["gt"] for r in picked] == ["".join(gt[i] for i in keep)] * 4
    assert [r[0] for r in odd] == ["10", "", ""] and [r[1] for r in odd] == [""] * 3
