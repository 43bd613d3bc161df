"""Queries by operator key, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import alleles
from treeloom.functions.epochs import epochs as epoch_table
from treeloom.operators import cleaning, intervals, mutation, rates, selection, trees, windows
from treeloom.plans import views
from treeloom.plans.views import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
N = views.TIPS
BY = ["chrom"]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def grid(spark: SparkSession) -> DataFrame:
    """Ten epochs of width five, the last open."""
    return epoch_table(spark, [5.0 * e for e in range(10)], 1e9)


def heights(spark: SparkSession, d: str) -> DataFrame:
    return trees.with_heights(views.trees(spark, d))


def dists(spark: SparkSession, d: str) -> DataFrame:
    return windows.distances(views.muts(spark, d), BY, "pos", "snp_id")


def aged(spark: SparkSession, d: str) -> DataFrame:
    return trees.mutation_ages(dists(spark, d), heights(spark, d).select("tree_id", "node", "parent", "height"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return windows.tree_spans(dists(spark, d), BY, "tree_id", "pos", "snp_id")


def branches(spark: SparkSession, d: str) -> DataFrame:
    h = heights(spark, d)
    top = h.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("age_end"))
    return h.where("parent >= 0").withColumnRenamed("height", "age_begin").join(top, ["tree_id", "parent"])


SPANS = """spans AS (SELECT chrom, tree_id, 0.5 * min_by(before, (pos, snp_id)) + sum(dist) - 0.5 * max_by(dist, (pos, snp_id)) AS span
  FROM (SELECT *, coalesce(lag(dist) OVER (PARTITION BY chrom ORDER BY pos, snp_id), 0) AS before FROM dists) GROUP BY 1, 2)"""
views.SQL["spans"] = SPANS
views._NEEDS["spans"] = ["dists"]
views.SQL["branches"] = "branches AS (SELECT n.chrom, n.tree_id, n.node, n.parent, h.height AS age_begin, a.height AS age_end FROM nodes n JOIN heights h USING (tree_id, node) JOIN heights a ON a.tree_id = n.tree_id AND a.node = n.parent WHERE n.parent >= 0)"
views._NEEDS["branches"] = ["heights"]
views.SQL["segments"] = """steps AS (SELECT chrom, tree_id, height, sum(CASE WHEN node < 8 THEN 1 ELSE -1 END) AS d, sum(CASE WHEN node >= 8 THEN 1 ELSE 0 END) AS ev FROM nodes JOIN heights USING (tree_id, node) GROUP BY 1, 2, 3),
lins AS (SELECT *, sum(d) OVER (PARTITION BY tree_id ORDER BY height) AS k FROM steps),
segments AS (SELECT * FROM (SELECT chrom, tree_id, height AS age_begin, lead(height) OVER w AS age_end, k, lead(ev) OVER w AS ends FROM lins WINDOW w AS (PARTITION BY tree_id ORDER BY height)) WHERE age_end IS NOT NULL)"""
views._NEEDS["segments"] = ["heights"]
views.SQL["pairs"] = """pairs AS (SELECT a.tree_id, a.leaf AS i, b.leaf AS j, min(h.height) AS tmrca FROM clades a JOIN clades b ON a.tree_id = b.tree_id AND a.node = b.node AND a.leaf < b.leaf
  JOIN heights h ON h.tree_id = a.tree_id AND h.node = a.node GROUP BY 1, 2, 3)"""
views._NEEDS["pairs"] = ["heights", "clades"]
views.SQL["events_ij"] = """pair_exposure AS (SELECT i, j, epoch, sum((least(hi, tmrca) - greatest(lo, 0)) * span) AS denom FROM pairs JOIN spans USING (tree_id) JOIN epochs ON lo < tmrca AND hi > 0 GROUP BY 1, 2, 3),
pair_events AS (SELECT i, j, epoch, sum(span) AS num FROM pairs JOIN spans USING (tree_id) JOIN epochs ON lo <= tmrca AND tmrca < hi GROUP BY 1, 2, 3),
events_ij AS (SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.epoch, b.epoch) AS epoch, coalesce(num, 0.0) AS num, coalesce(denom, 0.0) AS denom
  FROM pair_exposure a FULL JOIN pair_events b ON a.i = b.i AND a.j = b.j AND a.epoch = b.epoch)"""
views._NEEDS["events_ij"] = ["pairs", "spans", "epochs"]
views.SQL["tree_events"] = """tree_blocks AS (SELECT chrom, tree_id, span, CAST((row_number() OVER (PARTITION BY chrom ORDER BY tree_id) - 1) // 2 AS INTEGER) AS block FROM spans),
t_exp AS (SELECT s.chrom, block, epoch, sum((least(hi, age_end) - greatest(lo, age_begin)) * k * (k - 1) / 2 * span) / 1e9 AS denom FROM segments s JOIN tree_blocks USING (chrom, tree_id) JOIN epochs ON lo < age_end AND hi > age_begin GROUP BY 1, 2, 3),
t_ev AS (SELECT s.chrom, block, epoch, sum(ends * span) / 1e9 AS num FROM segments s JOIN tree_blocks USING (chrom, tree_id) JOIN epochs ON lo < age_end AND age_end <= hi GROUP BY 1, 2, 3),
tree_events AS (SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.block, b.block) AS block, coalesce(a.epoch, b.epoch) AS epoch, coalesce(num, 0.0) AS num, coalesce(denom, 0.0) AS denom
  FROM t_exp a FULL JOIN t_ev b ON a.chrom = b.chrom AND a.block = b.block AND a.epoch = b.epoch)"""
views._NEEDS["tree_events"] = ["spans", "segments", "epochs"]
_GROUPS = "grp_of AS (SELECT CAST(i AS INTEGER) AS hap, 'g' || (i % 3) AS grp FROM range(8) r(i))"
views.SQL["grp_of"] = _GROUPS


def groups(spark: SparkSession) -> DataFrame:
    """Tips in three groups."""
    return spark.range(N).select(F.col("id").cast("int").alias("hap"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("grp"))


# ---- projections, filters ----
@query("f01_unique_positions", sql("SELECT chrom, pos // 1000 AS pos, min(snp_id) AS snp_id FROM muts GROUP BY 1, 2 HAVING count(*) = 1", "muts"))
def f01(spark, d):
    return cleaning.unique_positions(views.muts(spark, d).select("chrom", F.floor(F.col("pos") / 1000).alias("pos"), "snp_id"))


@query("f02_biallelic_legend", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'Biallelic_SNP' ELSE 'Biallelic_INDEL' END AS type FROM part WHERE p_size % 3 IN (0, 1)")
def f02(spark, d):
    s = F.col("p_size") % 3
    return cleaning.biallelic(views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(s == 1, "Biallelic_SNP").when(s == 2, "Biallelic_INDEL").alias("type")))


@query("f04_segregating", sql("SELECT snp_id, sum(allele)::BIGINT AS carriers FROM haps WHERE hap < 6 GROUP BY 1 HAVING sum(allele) BETWEEN 1 AND 5", "haps"))
def f04(spark, d):
    kept = cleaning.remove_haplotypes(views.sites(spark, d), list(range(6)))
    return kept.select("snp_id", alleles.carriers(F.col("gt")).cast("long").alias("carriers"))


@query("f05_mask_filter", sql("SELECT chrom, p, failing_near FROM (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY p RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS BIGINT) AS failing_near FROM mask) WHERE ok AND failing_near < 8", "mask"))
def f05(spark, d):
    return cleaning.pass_mask(views.mask(spark, d), reach=20, most=8).select("chrom", F.col("p").cast("long").alias("p"), "failing_near")


_ANCESTOR = "substr('ACGT', (snp_id * 3) % 4 + 1, 1)"


@query("f06_polarise", sql(f"SELECT snp_id, CASE WHEN {_ANCESTOR} = anc THEN anc ELSE alt END AS anc, CASE WHEN {_ANCESTOR} = anc THEN alt ELSE anc END AS alt, CASE WHEN {_ANCESTOR} = anc THEN gt ELSE translate(gt, '01', '10') END AS gt FROM sites WHERE {_ANCESTOR} IN (anc, alt)", "sites"))
def f06(spark, d):
    a = F.substring(F.lit("ACGT"), (F.col("snp_id") * 3 % 4 + 1).cast("int"), F.lit(1))
    return cleaning.polarise(views.sites(spark, d), a).select("snp_id", "anc", "alt", "gt")


@query("f07_transversions", sql("SELECT snp_id, CASE WHEN anc || der IN ('CT', 'TC', 'AG', 'GA') THEN 0 ELSE 1 END AS state FROM muts", "muts"))
def f07(spark, d):
    return cleaning.transversions(views.muts(spark, d).withColumnRenamed("der", "alt")).select("snp_id", "state")


@query("f08_mapped", sql("SELECT tree_id, count(*) AS n FROM muts WHERE n_branches = 1 GROUP BY 1", "muts"))
def f08(spark, d):
    return mutation.mapped(views.muts(spark, d)).groupBy("tree_id").agg(F.count("*").alias("n"))


@query("f09_well_defined", sql("SELECT anc, der, count(*) AS n FROM muts WHERE anc <> der GROUP BY 1, 2", "muts"))
def f09(spark, d):
    m = views.muts(spark, d)
    return m.where(alleles.well_defined(*(F.col(c) for c in ("anc", "der", "upstream", "downstream")))).groupBy("anc", "der").agg(F.count("*").alias("n"))


@query("f10_selection_filter", sql("SELECT m.snp_id, count(*) AS n_tips FROM muts m JOIN clades c ON c.tree_id = m.tree_id AND c.node = m.branch WHERE n_branches = 1 AND NOT flipped AND branch <> 14 GROUP BY 1 HAVING count(*) > 2", "muts", "clades"))
def f10(spark, d):
    tips = heights(spark, d).select("tree_id", F.col("node").alias("branch"), "n_tips")
    return selection.eligible(views.muts(spark, d).join(tips, ["tree_id", "branch"]), 14).select("snp_id", F.col("n_tips").cast("long").alias("n_tips"))


@query("f11_region", sql("SELECT chrom, snp_id, pos, tree_id - min(tree_id) OVER (PARTITION BY chrom) AS tree_id FROM muts WHERE pos BETWEEN 5000000 AND 25000000", "muts"))
def f11(spark, d):
    from treeloom.operators import extract

    return extract.region(views.muts(spark, d), 5_000_000, 25_000_000).select("chrom", "snp_id", "pos", "tree_id")


@query(
    "f12_tree_quality",
    sql(
        """ev AS (SELECT chrom, tree_id, sum(num_events) AS events FROM nodes GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY events, tree_id) - 1 AS k, count(*) OVER (PARTITION BY chrom) AS n FROM ev),
cut AS (SELECT chrom, events AS c FROM rk WHERE k = CAST(floor(n * 0.5) AS BIGINT))
SELECT chrom, tree_id, events, CAST(dense_rank() OVER (PARTITION BY chrom ORDER BY tree_id) - 1 AS INTEGER) AS new_id FROM ev JOIN cut USING (chrom) WHERE events >= c""",
        "nodes",
    ),
)
def f12(spark, d):
    ev = trees.exploded(views.trees(spark, d)).groupBy("chrom", "tree_id").agg(F.sum("num_events").alias("events"))
    return selection.well_supported(ev, 0.5).select("chrom", "tree_id", "events", "new_id")


_RUNS = """marked AS (SELECT *, p - row_number() OVER (PARTITION BY chrom, ok ORDER BY p) AS g FROM mask),
runs AS (SELECT chrom, min(p)::DOUBLE AS lo, (max(p) + 1)::DOUBLE AS hi FROM marked WHERE ok GROUP BY chrom, g)"""
_WIDE = "ranges AS (SELECT DISTINCT chrom, tree_id, (tree_id // 5 * 300)::DOUBLE AS lo, (tree_id // 5 * 300 + 300)::DOUBLE AS hi FROM nodes)"


@query("f13_mask_coverage", sql(f"{_RUNS}, {_WIDE} SELECT r.chrom, tree_id, round(sum(least(r.hi, m.hi) - greatest(r.lo, m.lo)) / 300, 6) AS coverage FROM ranges r JOIN runs m ON r.chrom = m.chrom AND r.lo < m.hi AND m.lo < r.hi GROUP BY 1, 2 HAVING sum(least(r.hi, m.hi) - greatest(r.lo, m.lo)) / 300 >= 0.1", "mask", "nodes"))
def f13(spark, d):
    t = views.trees(spark, d).select("chrom", "tree_id", (F.floor(F.col("tree_id") / 5) * 300).cast("double").alias("lo")).withColumn("hi", F.col("lo") + 300)
    ok = intervals.runs(views.mask(spark, d), BY).where("ok").select("chrom", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    return rates.covered_trees(t, ok, 100, 0.1).select("chrom", "tree_id", r6("coverage").alias("coverage"))


@query("f14_segregating_in_group", sql("SELECT m.snp_id FROM muts m JOIN clades c ON c.tree_id = m.tree_id AND c.node = m.branch GROUP BY 1 HAVING count(*) > 1 AND sum(CASE WHEN leaf IN (0, 3, 6) THEN 1 ELSE 0 END) > 0", "muts", "clades"))
def f14(spark, d):
    return mutation.segregating_in(views.muts(spark, d), trees.clade_rows(views.trees(spark, d)), [0, 3, 6]).select("snp_id")


@query("f15_positions", sql("SELECT chrom, pos, dist FROM dists", "dists"))
def f15(spark, d):
    return dists(spark, d).select("chrom", "pos", "dist")


@query("f17_groups_of_interest", sql("SELECT hap, grp FROM grp_of WHERE grp IN ('g0', 'g2')", "grp_of"))
def f17(spark, d):
    g = groups(spark)
    return cleaning.samples_of_groups(g, cleaning.groups_of_interest(g, "g0, g2,g0"))


# ---- joins ----
@query("j01_trees_with_mutations", sql("SELECT t.chrom, t.tree_id, count(m.snp_id) AS n FROM (SELECT DISTINCT chrom, tree_id FROM nodes) t LEFT JOIN muts m ON m.chrom = t.chrom AND m.tree_id = t.tree_id AND m.pos % 7 = 0 GROUP BY 1, 2", "nodes", "muts"))
def j01(spark, d):
    t = views.trees(spark, d).select("chrom", "tree_id")
    return t.join(views.muts(spark, d).where("pos % 7 = 0"), ["chrom", "tree_id"], "left").groupBy("chrom", "tree_id").agg(F.count("snp_id").alias("n"))


@query("j02_mutations_with_trees", sql("SELECT m.snp_id, n.parent, n.branch_length FROM muts m JOIN nodes n ON n.tree_id = m.tree_id AND n.node = m.branch", "muts", "nodes"))
def j02(spark, d):
    n = trees.exploded(views.trees(spark, d)).select("tree_id", F.col("node").alias("branch"), "parent", "branch_length")
    return views.muts(spark, d).join(n, ["tree_id", "branch"]).select("snp_id", "parent", "branch_length")


@query("j03_distance_override", sql("SELECT m.snp_id, coalesce(o.dist, m.dist) AS dist FROM dists m LEFT JOIN (SELECT chrom, pos, dist * 2 AS dist FROM dists WHERE pos % 3 = 0) o ON o.chrom = m.chrom AND o.pos = m.pos", "dists"))
def j03(spark, d):
    m = dists(spark, d)
    o = m.where("pos % 3 = 0").select("chrom", "pos", (F.col("dist") * 2).alias("__dist"))
    return m.join(o, ["chrom", "pos"], "left").select("snp_id", F.coalesce("__dist", "dist").alias("dist"))


@query("j06_zip_by_line", "SELECT p_partkey AS line, p_name, s_name FROM part JOIN supplier ON p_partkey = s_suppkey")
def j06(spark, d):
    a = views.table(spark, d, "part").select(F.col("p_partkey").alias("line"), "p_name")
    return a.join(views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), "s_name"), "line")


@query(
    "j07_interpolate_map",
    sql(
        """b AS (SELECT m.snp_id, m.pos, g.bp AS x0, g.cm AS y0 FROM muts m ASOF LEFT JOIN genmap g ON m.chrom = g.chrom AND m.pos >= g.bp),
a AS (SELECT m.snp_id, g.bp AS x1, g.cm AS y1 FROM muts m ASOF LEFT JOIN genmap g ON m.chrom = g.chrom AND m.pos <= g.bp)
SELECT snp_id, round(0.01 * CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (pos - x0) / (x1 - x0) END, 6) AS rpos FROM a JOIN b USING (snp_id)""",
        "muts",
        "genmap",
    ),
)
def j07(spark, d):
    return intervals.interpolate(views.muts(spark, d).select("chrom", "snp_id", "pos"), views.genmap(spark, d), BY).select("snp_id", r6("rpos").alias("rpos"))


@query(
    "j08_nearest_bases",
    sql(
        """s AS (SELECT chrom, tree_id, pos // 20000 AS pos, min(snp_id) AS snp_id FROM muts GROUP BY 1, 2, 3),
v AS (SELECT chrom, tree_id, coalesce((lag(pos) OVER w + pos) / 2.0, pos) AS lo, coalesce((lead(pos) OVER w + pos) / 2.0, pos) AS hi FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos, snp_id))
SELECT v.chrom, v.tree_id, count(*) AS n FROM v JOIN mask m ON m.chrom = v.chrom AND m.p >= v.lo AND m.p < v.hi WHERE m.ok GROUP BY 1, 2""",
        "muts",
        "mask",
    ),
)
def j08(spark, d):
    s = views.muts(spark, d).groupBy("chrom", "tree_id", F.floor(F.col("pos") / 20000).alias("pos")).agg(F.min("snp_id").alias("snp_id"))
    v = intervals.nearest_ranges(s.withColumn("pos", F.col("pos")), BY)
    bases = views.mask(spark, d).where("ok").select("chrom", "p", F.lit("x").alias("kind"))
    return mutation.bases_by_type(v, bases, 50.0).select("chrom", "tree_id", "n")


@query("j09_first_at_or_after", sql("q AS (SELECT chrom, tree_id, tree_id * 1234567 AS at FROM (SELECT DISTINCT chrom, tree_id FROM nodes)) SELECT q.tree_id, m.pos FROM q ASOF LEFT JOIN (SELECT chrom, pos FROM muts) m ON q.chrom = m.chrom AND q.at <= m.pos", "nodes", "muts"))
def j09(spark, d):
    q = views.trees(spark, d).select("chrom", "tree_id", (F.col("tree_id") * 1234567).cast("long").alias("pos0"))
    return intervals.as_of(q, views.muts(spark, d), BY, "pos0", "pos", ["snp_id"], forward=True).select("tree_id", F.col("at").alias("pos"))


@query("j10_newest_before", sql("q AS (SELECT chrom, tree_id, tree_id * 1234567 AS at FROM (SELECT DISTINCT chrom, tree_id FROM nodes)) SELECT q.tree_id, m.pos FROM q ASOF LEFT JOIN (SELECT chrom, pos FROM muts) m ON q.chrom = m.chrom AND q.at >= m.pos", "nodes", "muts"))
def j10(spark, d):
    q = views.trees(spark, d).select("chrom", "tree_id", (F.col("tree_id") * 1234567).cast("long").alias("pos0"))
    return intervals.as_of(q, views.muts(spark, d), BY, "pos0", "pos", ["snp_id"]).select("tree_id", F.col("at").alias("pos"))


@query("j11_within_branch_span", sql("SELECT m.snp_id, n.node FROM muts m JOIN nodes n ON n.tree_id = m.tree_id WHERE m.snp_id % 300 BETWEEN n.snp_begin AND n.snp_end", "muts", "nodes"))
def j11(spark, d):
    n = trees.exploded(views.trees(spark, d)).select("tree_id", "node", "snp_begin", "snp_end")
    return views.muts(spark, d).join(n, "tree_id").where((F.col("snp_id") % 300).between(F.col("snp_begin"), F.col("snp_end"))).select("snp_id", "node")


@query("j12_epoch_overlap", sql("SELECT epoch, count(*) AS n, round(sum(least(hi, age_end) - greatest(lo, age_begin)), 6) AS shared FROM ages JOIN epochs ON lo < age_end AND hi > age_begin GROUP BY 1", "ages", "epochs"))
def j12(spark, d):
    return intervals.with_epochs(aged(spark, d), grid(spark)).groupBy("epoch").agg(F.count("*").alias("n"), r6(F.sum("shared")).alias("shared"))


@query("j13_pattern_category", sql("SELECT m.snp_id, CASE WHEN anc IN ('C', 'G') THEN 0 ELSE 1 END AS category FROM muts m WHERE anc <> der", "muts"))
def j13(spark, d):
    rows = [(u, v, a, e, 0 if a in "CG" else 1) for u in "ACGT" for v in "ACGT" for a in "CA" for e in "ACGT" if a != e]
    table = spark.createDataFrame(rows, "up string, down string, anc string, der string, category int")
    return mutation.categorised(views.muts(spark, d), table).select("snp_id", "category")


@query("j14_haplotype_group", sql("SELECT grp, sum(allele)::BIGINT AS n FROM haps JOIN (SELECT vec_id, 'p' || label AS grp FROM embeddings) g ON g.vec_id = haps.hap GROUP BY 1", "haps").replace("SELECT grp, sum", "SELECT g.grp, sum"))
def j14(spark, d):
    g = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("hap"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("grp"))
    return views.haps(spark, d).drop("grp").join(g, "hap").groupBy("grp").agg(F.sum("allele").alias("n"))


@query("j16_remove_samples", sql("SELECT snp_id, sum(allele)::BIGINT AS carriers, count(*) AS n FROM haps WHERE hap % 3 <> 0 GROUP BY 1", "haps"))
def j16(spark, d):
    gone = views.table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("hap"))
    return cleaning.allele_counts(cleaning.remove_samples(views.haps(spark, d), gone))


@query("j17_new_positions", sql("SELECT snp_id FROM muts WHERE NOT EXISTS (SELECT 1 FROM muts k WHERE k.pos % 5 = 0 AND k.chrom = muts.chrom AND k.pos = muts.pos)", "muts"))
def j17(spark, d):
    m = views.muts(spark, d)
    return cleaning.new_positions(m, m.where("pos % 5 = 0")).select("snp_id")


@query("j18_group_semi_join", sql("SELECT hap FROM grp_of WHERE grp = 'g1'", "grp_of"))
def j18(spark, d):
    return cleaning.samples_of_groups(groups(spark), spark.createDataFrame([("g1",)], "grp string")).select("hap")


@query("j19_pairs_below_node", sql("SELECT tree_id, i, j, round(tmrca, 6) AS tmrca FROM pairs", "pairs"))
def j19(spark, d):
    return trees.pair_times(views.trees(spark, d)).select("tree_id", "i", "j", r6("tmrca").alias("tmrca"))


@query("j20_adjacent_trees", sql("t AS (SELECT DISTINCT chrom, tree_id FROM nodes) SELECT * FROM (SELECT chrom, tree_id, lead(tree_id) OVER (PARTITION BY chrom ORDER BY tree_id) AS next_tree_id FROM t) WHERE next_tree_id IS NOT NULL", "nodes"))
def j20(spark, d):
    return trees._adjacent(views.trees(spark, d).select("chrom", "tree_id"), []).select("chrom", "tree_id", "next_tree_id")


# ---- aggregations ----
@query("a01_derived_counts", sql("SELECT snp_id, sum(allele)::BIGINT AS carriers, count(*) AS n FROM haps GROUP BY 1", "haps"))
def a01(spark, d):
    return cleaning.allele_counts(views.haps(spark, d))


@query("a02_group_counts", sql("SELECT snp_id, grp, sum(allele)::BIGINT AS carriers, count(*) AS n FROM haps GROUP BY 1, 2", "haps"))
def a02(spark, d):
    return cleaning.group_counts(views.haps(spark, d))


@query("a03_group_counts_from_trees", sql("SELECT m.snp_id, g.grp, count(*) AS carriers FROM muts m JOIN clades c ON c.tree_id = m.tree_id AND c.node = m.branch JOIN grp_of g ON g.hap = c.leaf GROUP BY 1, 2", "muts", "clades", "grp_of"))
def a03(spark, d):
    from treeloom.operators import extract

    return extract.group_carriers(views.muts(spark, d), trees.clade_rows(views.trees(spark, d)), groups(spark)).select("snp_id", "grp", "carriers")


def pair_table(spark, d):
    return rates.pair_sums(views.trees(spark, d), spans(spark, d), grid(spark))


@query("a04_total_rates", sql("SELECT epoch, round(sum(num), 3) AS num, round(sum(denom), 3) AS denom, round(sum(num) / nullif(sum(denom), 0), 9) AS rate FROM events_ij GROUP BY 1", "events_ij"))
def a04(spark, d):
    return rates.total_rates(pair_table(spark, d)).select("epoch", F.round("num", 3).alias("num"), F.round("denom", 3).alias("denom"), F.round("rate", 9).alias("rate"))


@query("a05_group_pair_rates", sql("SELECT least(a.grp, b.grp) AS g1, greatest(a.grp, b.grp) AS g2, epoch, round(sum(num) / nullif(sum(denom), 0), 9) AS rate FROM events_ij e JOIN grp_of a ON a.hap = e.i JOIN grp_of b ON b.hap = e.j GROUP BY 1, 2, 3", "events_ij", "grp_of"))
def a05(spark, d):
    return rates.group_rates(pair_table(spark, d), groups(spark)).select("g1", "g2", "epoch", F.round("rate", 9).alias("rate"))


@query("a06_haplotype_pair_rates", sql("SELECT i, j, epoch, round(num / nullif(denom, 0), 9) AS rate FROM events_ij", "events_ij"))
def a06(spark, d):
    return rates.haplotype_rates(pair_table(spark, d)).select("i", "j", "epoch", F.round("rate", 9).alias("rate"))


@query(
    "a04_a06_grouping_sets",
    sql(
        """x AS (SELECT least(a.grp, b.grp) AS g1, greatest(a.grp, b.grp) AS g2, i, j, epoch, num, denom FROM events_ij e JOIN grp_of a ON a.hap = e.i JOIN grp_of b ON b.hap = e.j)
SELECT CASE WHEN g1 IS NOT NULL THEN 1 WHEN i IS NOT NULL THEN 2 ELSE 0 END AS level, g1, g2, i, j, epoch, round(sum(num) / nullif(sum(denom), 0), 9) AS rate FROM x GROUP BY GROUPING SETS ((epoch), (g1, g2, epoch), (i, j, epoch))""",
        "events_ij",
        "grp_of",
    ),
)
def a0406(spark, d):
    return rates.all_rates(pair_table(spark, d), groups(spark)).select("level", "g1", "g2", "i", "j", "epoch", F.round("rate", 9).alias("rate"))


@query("a07_weighted_counts", sql("SELECT epoch, round(sum(span / 1e6), 6) AS count FROM pairs JOIN spans USING (tree_id) JOIN epochs ON lo <= tmrca AND tmrca < hi GROUP BY 1", "pairs", "spans", "epochs"))
def a07(spark, d):
    p = intervals.at_epoch(trees.pair_times(views.trees(spark, d)), grid(spark), "tmrca")
    return rates.weighted_counts(p.select("tree_id", "epoch"), spans(spark, d).select("tree_id", "span")).select("epoch", r6("count").alias("count"))


@query("a08_sum_of_chromosomes", sql("SELECT epoch, round(sum(num), 6) AS num, round(sum(denom), 6) AS denom FROM tree_events GROUP BY 1", "tree_events"))
def a08(spark, d):
    e = tree_table(spark, d)
    parts = [e.where(f"chrom = {c}") for c in range(5)]
    return rates.summed(parts, ["epoch"], ["num", "denom"]).select("epoch", r6("num").alias("num"), r6("denom").alias("denom"))


def tree_table(spark, d):
    return rates.tree_events(heights(spark, d), grid(spark), spans(spark, d), block=2)


@query("a12_events_per_tree", sql("SELECT tree_id, sum(num_events) AS events FROM nodes GROUP BY 1", "nodes"))
def a12(spark, d):
    return views.trees(spark, d).select("tree_id", F.aggregate("nodes", F.lit(0.0), lambda acc, x: acc + x["num_events"]).alias("events"))


@query("a13_sample_ages", "SELECT CAST(label * 100 AS DOUBLE) AS age, count(*) AS n FROM embeddings GROUP BY 1")
def a13(spark, d):
    return views.table(spark, d, "embeddings").groupBy((F.col("label") * 100).cast("double").alias("age")).agg(F.count("*").alias("n"))


@query("a14_tree_events", sql("SELECT chrom, block, epoch, num::DOUBLE AS num, denom::DOUBLE AS denom FROM tree_events", "tree_events"))
def a14(spark, d):
    return tree_table(spark, d).select("chrom", "block", "epoch", "num", "denom")


@query("a15_block_bootstrap")
def a15(spark, d):
    e = tree_table(spark, d).withColumn("block", F.col("chrom") * 1000 + F.col("block"))
    return rates.bootstrap_rates(e, rates.bootstrap_weights(e.select("block").distinct(), 20)).select("replicate", "epoch", F.round("rate", 9).alias("rate"))


@query("a18_totals", sql("SELECT sum(CASE WHEN n_branches <> 1 THEN 1 ELSE 0 END)::BIGINT AS unmapped, sum(CASE WHEN flipped THEN 1 ELSE 0 END)::BIGINT AS flipped FROM muts", "muts"))
def a18(spark, d):
    return views.muts(spark, d).agg(F.sum((F.col("n_branches") != 1).cast("int")).alias("unmapped"), F.sum(F.col("flipped").cast("int")).alias("flipped"))


@query(
    "a19_absorbed_distances",
    sql(
        """k AS (SELECT *, sum(CASE WHEN snp_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos, snp_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM dists)
SELECT chrom, min(CASE WHEN snp_id % 3 = 0 THEN snp_id END) AS snp_id, sum(dist)::BIGINT AS dist FROM k WHERE g > 0 GROUP BY chrom, g""",
        "dists",
    ),
)
def a19(spark, d):
    from treeloom.operators import extract

    return extract.absorbed(dists(spark, d), F.col("snp_id") % 3 == 0, BY, "pos", "snp_id").select("chrom", "snp_id", "dist")


@query("a20_population_size", sql("t AS (SELECT epoch, sum(num) / nullif(sum(denom), 0) AS rate FROM tree_events GROUP BY 1) SELECT round(0.5 / avg(rate), 6) AS ne FROM t WHERE rate > 0", "tree_events"))
def a20(spark, d):
    return rates.population_size(rates.total_rates(tree_table(spark, d))).select(r6("ne").alias("ne"))


# ---- windows ----
@query("w01_distances", sql("SELECT snp_id, dist FROM dists", "dists"))
def w01(spark, d):
    return dists(spark, d).select("snp_id", "dist")


@query("w02_recombination", sql("SELECT chrom, bp, round(greatest(coalesce((lead(cm) OVER (PARTITION BY chrom ORDER BY bp) - cm) * 0.01, 0), 1e-10) * 2500, 6) AS r FROM genmap", "genmap"))
def w02(spark, d):
    g = views.genmap(spark, d).withColumn("rpos", F.col("cm") * 0.01)
    return windows.recombination(g, BY, "bp").select("chrom", "bp", r6("r").alias("r"))


@query("w03_tree_spans", sql("SELECT chrom, tree_id, span::DOUBLE AS span FROM spans", "spans"))
def w03(spark, d):
    return spans(spark, d).select("chrom", "tree_id", F.col("span").cast("double").alias("span"))


@query("w04_site_spans", sql("SELECT snp_id, (coalesce(lag(dist) OVER (PARTITION BY chrom ORDER BY pos, snp_id), 0) + dist) / 2.0 AS span FROM dists", "dists"))
def w04(spark, d):
    return windows.site_spans(dists(spark, d), BY, "pos", "snp_id").select("snp_id", "span")


@query(
    "w05_unmapped_nearby",
    sql(
        """k AS (SELECT chrom, snp_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY chrom) AS n, CASE WHEN n_branches = 1 THEN 0 ELSE 1 END AS u FROM muts WINDOW w AS (PARTITION BY chrom ORDER BY pos, snp_id)),
c AS (SELECT *, sum(u) OVER (PARTITION BY chrom ORDER BY k) AS run, least(greatest(k + 50, 100), n) AS hi FROM k)
SELECT a.snp_id, (h.run - coalesce(l.run, 0))::BIGINT AS n_unmapped FROM c a JOIN c h ON h.chrom = a.chrom AND h.k = a.hi LEFT JOIN c l ON l.chrom = a.chrom AND l.k = greatest(a.hi - 100, 0)""",
        "muts",
    ),
)
def w05(spark, d):
    return windows.unmapped_nearby(views.muts(spark, d), BY, F.col("n_branches") != 1, 50, "pos", "snp_id").select("snp_id", "n_unmapped")


@query("w06_failing_nearby", sql("SELECT chrom, p, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY p ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS BIGINT) AS n FROM mask", "mask"))
def w06(spark, d):
    return windows.neighbourhood(views.mask(spark, d), BY, (~F.col("ok")).cast("int"), "n", 100, 100, "p").select("chrom", F.col("p").cast("long").alias("p"), "n")


@query(
    "w07_passing_distance",
    sql(
        """f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY p RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY p) - CASE WHEN ok THEN 0 ELSE 1 END AS before FROM mask),
k AS (SELECT chrom, p AS pos, before FROM f WHERE ok AND near < 8 AND p % 3 = 0)
SELECT chrom, pos, greatest(coalesce((lead(pos) OVER w - pos) - (lead(before) OVER w - before), 1), 1)::BIGINT AS dist FROM k WINDOW w AS (PARTITION BY chrom ORDER BY pos)""",
        "mask",
    ),
)
def w07(spark, d):
    bases = views.mask(spark, d).withColumn("p", F.col("p").cast("long"))
    s = bases.where("p % 3 = 0").select("chrom", F.col("p").alias("pos"))
    return cleaning.filter_by_mask(s, bases, reach=20, most=8).select("chrom", "pos", "dist")


@query("w08_tree_runs", sql("m AS (SELECT chrom, tree_id, pos, snp_id, row_number() OVER (PARTITION BY chrom ORDER BY pos, snp_id) - row_number() OVER (PARTITION BY chrom, tree_id ORDER BY pos, snp_id) AS g FROM muts) SELECT chrom, tree_id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM m GROUP BY chrom, tree_id, g", "muts"))
def w08(spark, d):
    return windows.tree_runs(views.muts(spark, d), BY, "tree_id", "pos", "snp_id").select("chrom", "tree_id", "n", "first", "last")


@query("w09_budget_windows", sql("SELECT snp_id, CAST(floor(sum(branch) OVER (PARTITION BY chrom ORDER BY pos, snp_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 500.0) AS INTEGER) AS window FROM muts", "muts"))
def w09(spark, d):
    return windows.budget_windows(views.muts(spark, d), BY, F.col("branch"), 500.0, "pos", "snp_id").select("snp_id", "window")


@query("w10_chunks", "s AS (SELECT o_orderkey AS k FROM orders)".join(["WITH ", " SELECT k AS snp_id, CAST(c AS INTEGER) AS chunk, (k - c * 800 >= CASE WHEN c = 0 THEN 0 ELSE 100 END AND k - c * 800 < CASE WHEN c < (SELECT greatest(0, CAST(ceil((max(k) + 1 - 1000) / 800.0) AS BIGINT)) FROM s) THEN 900 ELSE 1000 END) AS core FROM s, range(100000) r(c) WHERE c <= (SELECT greatest(0, CAST(ceil((max(k) + 1 - 1000) / 800.0) AS BIGINT)) FROM s) AND k >= c * 800 AND k < c * 800 + 1000"]))
def w10(spark, d):
    s = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("snp_id"))
    return windows.chunks(s, 1000, 200, s.agg(F.max("snp_id")).first()[0])


@query("w11_lineages", sql("SELECT tree_id, node, CAST(sum(CASE WHEN node < 8 THEN 1 ELSE -1 END) OVER (PARTITION BY tree_id ORDER BY height) AS BIGINT) AS lineages FROM heights", "heights"))
def w11(spark, d):
    return windows.lineages(heights(spark, d), ["chrom", "tree_id"], "height", F.col("n_children") == 0).select("tree_id", "node", "lineages")


@query("w13_carried_rates", sql("r AS (SELECT chrom, epoch, sum(CASE WHEN epoch % 3 = 1 THEN 0.0 ELSE num END) / nullif(sum(denom), 0) AS rate FROM tree_events GROUP BY 1, 2) SELECT chrom, epoch, round(coalesce(last_value(CASE WHEN rate > 0 THEN rate END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(CASE WHEN rate > 0 THEN rate END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 9) AS rate FROM r", "tree_events"))
def w13(spark, d):
    e = tree_table(spark, d).groupBy("chrom", "epoch").agg(F.sum(F.when(F.col("epoch") % 3 == 1, 0.0).otherwise(F.col("num"))).alias("n"), F.sum("denom").alias("denom"))
    return windows.carried_rates(e.select("chrom", "epoch", rates.ratio(F.col("n"), F.col("denom")).alias("rate")), BY).select("chrom", "epoch", F.round("rate", 9).alias("rate"))


@query("w15_forced_breaks", sql("SELECT snp_id, coalesce(lead(pos) OVER (PARTITION BY chrom ORDER BY pos, snp_id) // 100000 - pos // 100000 >= 1, false) AS breaks FROM muts", "muts"))
def w15(spark, d):
    return windows.forced_breaks(views.muts(spark, d), BY, 100000).select("snp_id", "breaks")


# ---- sort, top-k, sets ----
@query("t01_index_sort", sql("SELECT tree_id, node, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY height, node) AS INTEGER) AS rank FROM heights", "heights"))
def t01(spark, d):
    from pyspark.sql import Window

    return heights(spark, d).select("tree_id", "node", F.row_number().over(Window.partitionBy("tree_id").orderBy("height", "node")).alias("rank"))


@query("t05_least_pair", sql("SELECT tree_id, arg_min(i * 100 + j, (tmrca, i, j)) AS pair FROM pairs GROUP BY 1", "pairs"))
def t05(spark, d):
    p = trees.pair_times(views.trees(spark, d))
    return p.groupBy("tree_id").agg(F.min_by(F.col("i") * 100 + F.col("j"), F.struct("tmrca", "i", "j")).alias("pair"))


@query("u05_merged_sites", sql("a AS (SELECT * FROM muts WHERE snp_id % 2 = 0), b AS (SELECT * FROM muts WHERE snp_id % 3 = 0), m AS (SELECT chrom, pos, snp_id FROM a UNION ALL SELECT chrom, pos, snp_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND a.pos = b.pos)) SELECT chrom, snp_id, CAST(row_number() OVER (PARTITION BY chrom ORDER BY pos, snp_id) AS INTEGER) AS rank FROM m", "muts"))
def u05(spark, d):
    m = views.muts(spark, d).select("chrom", "pos", "snp_id")
    return cleaning.merged_sites(m.where("snp_id % 2 = 0"), m.where("snp_id % 3 = 0")).select("chrom", "snp_id", "rank")


@query("u07_shared_tips", sql("SELECT a.tree_id, a.node AS a, b.node AS b, count(*) AS n FROM clades a JOIN clades b ON a.tree_id = b.tree_id AND a.leaf = b.leaf AND a.node < b.node GROUP BY 1, 2, 3", "clades"))
def u07(spark, d):
    c = trees.clade_rows(views.trees(spark, d))
    a, b = c.select("tree_id", F.col("node").alias("a"), F.col("tips").alias("x")), c.select("tree_id", F.col("node").alias("b"), F.col("tips").alias("y"))
    n = F.size(F.array_intersect("x", "y")).cast("long")
    return a.join(b, "tree_id").where("a < b").select("tree_id", "a", "b", n.alias("n")).where("n > 0")


@query("u08_refined_epochs", "SELECT DISTINCT x::DOUBLE AS bound FROM (SELECT label * 7 AS x FROM embeddings UNION ALL SELECT e * 5 FROM range(10) r(e))")
def u08(spark, d):
    from treeloom.functions.epochs import refined

    ages = [r[0] for r in views.table(spark, d, "embeddings").select((F.col("label") * 7).alias("x")).distinct().collect()]  # ages of samples are few
    return spark.createDataFrame([(b,) for b in refined([5.0 * e for e in range(10)], ages)], "bound double")


# ---- functions ----
#: log10 of the chance that fn or more of n tips carry what fk of k lineages do; log k! as lgamma(k + 1).
_LOG_P = """CASE WHEN {fk} >= 2 AND {k} > {fk} AND {fn} <= {n} - {k} + {fk} THEN
  log10(list_sum(list_transform(range({fn}, {n} - {k} + {fk} + 1), lambda f: exp(lgamma(f) - lgamma({fk}) - lgamma(f - {fk} + 1) + lgamma({n} - f) - lgamma({k} - {fk}) - lgamma({n} - f - {k} + {fk} + 1) - lgamma({n}) + lgamma({k}) + lgamma({n} - {k} + 1)))))
  ELSE 1.0 END"""


@query("x04_selection_log_p", "SELECT k, fk, fn, round(" + _LOG_P.format(n=40, k="k", fk="fk", fn="fn") + ", 6) + 0.0 AS log_p FROM (SELECT DISTINCT CAST(o_orderkey % 19 + 2 AS INTEGER) AS k, CAST(o_custkey % 5 + 2 AS INTEGER) AS fk, CAST(o_orderkey % 30 + 3 AS INTEGER) AS fn FROM orders)")
def x04(spark, d):
    k = views.table(spark, d, "orders").select((F.col("o_orderkey") % 19 + 2).cast("int").alias("k"), (F.col("o_custkey") % 5 + 2).cast("int").alias("fk"), (F.col("o_orderkey") % 30 + 3).cast("int").alias("fn")).distinct()
    return k.select("k", "fk", "fn", r6(alleles.selection_log_p(40, F.col("fn"), F.col("k"), F.col("fk"))).alias("log_p"))


@query("x07_reverse_complement", "SELECT p_partkey AS id, translate(reverse(upper(regexp_replace(p_name, '[^acgtACGT]', '', 'g'))), 'ACGT', 'TGCA') AS s FROM part")
def x07(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), alleles.reverse_complement(F.upper(F.regexp_replace("p_name", "[^acgtACGT]", ""))).alias("s"))


_CONTEXT = """x AS (SELECT *, anc IN ('G', 'T') AS s FROM muts WHERE anc <> der), y AS (SELECT CASE WHEN s THEN translate(anc, 'ACGT', 'TGCA') ELSE anc END AS a, CASE WHEN s THEN translate(der, 'ACGT', 'TGCA') ELSE der END AS d,
  CASE WHEN s THEN translate(downstream, 'ACGT', 'TGCA') ELSE upstream END AS u, CASE WHEN s THEN translate(upstream, 'ACGT', 'TGCA') ELSE downstream END AS v FROM x)
SELECT CAST(((instr('ACGT', u) - 1) * 4 + instr('ACGT', v) - 1) * 6 + list_position(['CA', 'CG', 'CT', 'AT', 'AG', 'AC'], a || d) - 1 AS INTEGER) AS category, count(*) AS n FROM y GROUP BY 1"""


@query("x08_context", sql(_CONTEXT, "muts"))
def x08(spark, d):
    return mutation.with_context(views.muts(spark, d)).groupBy("category").agg(F.count("*").alias("n"))


@query("x13_flip", sql("SELECT snp_id, translate(gt, '01', '10') AS gt FROM sites", "sites"))
def x13(spark, d):
    return views.sites(spark, d).select("snp_id", alleles.flip(F.col("gt")).alias("gt"))


# ---- trees ----
@query("g01_heights", sql("SELECT tree_id, node, height FROM heights", "heights"))
def g01(spark, d):
    return heights(spark, d).select("tree_id", "node", "height")


@query("g02_clades", sql("SELECT tree_id, node, leaf FROM clades", "clades"))
def g02(spark, d):
    return trees.clade_rows(views.trees(spark, d)).select("tree_id", "node", F.explode("tips").alias("leaf"))


@query(
    "g03_subtree",
    sql(
        """k AS (SELECT tree_id, node, count(*) AS n, min(leaf) AS low, max(leaf) AS high FROM clades WHERE leaf IN (1, 4, 6) GROUP BY 1, 2),
p AS (SELECT k.tree_id, k.n, sum(o.branch_length) AS branch_length, k.low + 10 * k.high AS tips FROM k JOIN nodes o USING (tree_id, node) WHERE k.n < 3 GROUP BY 1, 2, 4)
SELECT tree_id, n, tips, branch_length FROM p""",
        "clades",
    ),
)
def g03(spark, d):
    s = trees.subtrees(views.trees(spark, d), [1, 4, 6])
    c = trees.clade_rows(trees.packed(s.withColumns({"snp_begin": F.lit(0), "snp_end": F.lit(0)})))
    old = F.array(F.lit(1), F.lit(4), F.lit(6))
    tips = F.get(old, F.array_min("tips")) + 10 * F.get(old, F.array_max("tips"))
    return s.join(c, ["chrom", "tree_id", "node"]).where("parent >= 0").select("tree_id", F.size("tips").cast("long").alias("n"), tips.alias("tips"), "branch_length")


@query("g07_mutation_ages", sql("SELECT snp_id, age_begin, age_end FROM ages", "ages"))
def g07(spark, d):
    return aged(spark, d).select("snp_id", "age_begin", "age_end")


@query("g08_total_length", sql("SELECT tree_id, sum(branch_length) AS total_length FROM nodes WHERE parent >= 0 GROUP BY 1", "nodes"))
def g08(spark, d):
    return trees.total_lengths(trees.exploded(views.trees(spark, d))).select("tree_id", "total_length")


@query("g09_tmrca", sql("SELECT tree_id, max(height) AS tmrca FROM heights GROUP BY 1", "heights"))
def g09(spark, d):
    return trees.tmrca(heights(spark, d)).select("tree_id", "tmrca")


@query("g10_pair_times", sql("SELECT i, j, round(avg(tmrca), 6) AS tmrca FROM pairs GROUP BY 1, 2", "pairs"))
def g10(spark, d):
    return trees.pair_times(views.trees(spark, d)).groupBy("i", "j").agg(r6(F.avg("tmrca")).alias("tmrca"))


_NEXT = """nx AS (SELECT * FROM (SELECT chrom, tree_id, lead(tree_id) OVER (PARTITION BY chrom ORDER BY tree_id) AS b FROM (SELECT DISTINCT chrom, tree_id FROM nodes)) WHERE b IS NOT NULL),
cl AS (SELECT tree_id, node, string_agg(leaf::VARCHAR, ',' ORDER BY leaf) AS c FROM clades GROUP BY 1, 2)"""


@query(
    "g12_partition_metric",
    sql(
        f"""{_NEXT}, one AS (SELECT nx.tree_id, count(*) AS n FROM nx JOIN cl x ON x.tree_id = nx.tree_id WHERE x.node BETWEEN 8 AND 13 AND NOT EXISTS (SELECT 1 FROM cl y WHERE y.tree_id = nx.b AND y.c = x.c) GROUP BY 1),
two AS (SELECT nx.tree_id, count(*) AS n FROM nx JOIN cl x ON x.tree_id = nx.b WHERE x.node BETWEEN 8 AND 13 AND NOT EXISTS (SELECT 1 FROM cl y WHERE y.tree_id = nx.tree_id AND y.c = x.c) GROUP BY 1)
SELECT nx.tree_id, CAST(coalesce(one.n, 0) + coalesce(two.n, 0) AS INTEGER) AS partitions FROM nx LEFT JOIN one USING (tree_id) LEFT JOIN two USING (tree_id)""",
        "clades",
    ),
)
def g12(spark, d):
    return trees.compare_adjacent(views.trees(spark, d)).select("tree_id", "partitions")


@query(
    "g13_branch_score",
    sql(
        f"""{_NEXT}, l AS (SELECT cl.tree_id, c, branch_length AS bl FROM cl JOIN nodes USING (tree_id, node)),
x AS (SELECT nx.tree_id, c, bl FROM nx JOIN l ON l.tree_id = nx.tree_id), y AS (SELECT nx.tree_id, c, bl FROM nx JOIN l ON l.tree_id = nx.b)
SELECT coalesce(x.tree_id, y.tree_id) AS tree_id, round(sqrt(sum((coalesce(x.bl, 0) - coalesce(y.bl, 0)) ** 2)), 6) AS branch_score FROM x FULL JOIN y ON x.tree_id = y.tree_id AND x.c = y.c GROUP BY 1""",
        "clades",
    ),
)
def g13(spark, d):
    return trees.compare_adjacent(views.trees(spark, d)).select("tree_id", r6("branch_score").alias("branch_score"))


_G11 = f"""{_NEXT}, sz AS (SELECT tree_id, node, count(*) AS n FROM clades GROUP BY 1, 2),
pr AS (SELECT nx.tree_id, x.node AS a, y.node AS b, x.n AS na, y.n AS nb FROM nx JOIN sz x ON x.tree_id = nx.tree_id JOIN sz y ON y.tree_id = nx.b),
sh AS (SELECT nx.tree_id, x.node AS a, y.node AS b, count(*) AS k FROM nx JOIN clades x ON x.tree_id = nx.tree_id JOIN clades y ON y.tree_id = nx.b AND y.leaf = x.leaf GROUP BY 1, 2, 3),
r AS (SELECT tree_id, a, b, CASE WHEN k = na AND na = nb THEN 1.0 WHEN na = 8 OR nb = 8 THEN 0.0 ELSE greatest(0.0, (coalesce(k, 0) - na * nb / 8.0) / sqrt(na * (8 - na) / 8.0 * (nb * (8 - nb) / 8.0))) END AS r FROM pr LEFT JOIN sh USING (tree_id, a, b)),
one AS (SELECT tree_id, a, max(r) AS best FROM r WHERE a BETWEEN 8 AND 13 GROUP BY 1, 2), two AS (SELECT tree_id, b, max(r) AS best FROM r WHERE b BETWEEN 8 AND 13 GROUP BY 1, 2),
l AS (SELECT cl.tree_id, c, branch_length AS bl FROM cl JOIN nodes USING (tree_id, node)),
x AS (SELECT nx.tree_id, c, bl FROM nx JOIN l ON l.tree_id = nx.tree_id), y AS (SELECT nx.tree_id, c, bl FROM nx JOIN l ON l.tree_id = nx.b),
score AS (SELECT coalesce(x.tree_id, y.tree_id) AS tree_id, sqrt(sum((coalesce(x.bl, 0) - coalesce(y.bl, 0)) ** 2)) AS branch_score FROM x FULL JOIN y ON x.tree_id = y.tree_id AND x.c = y.c GROUP BY 1),
st AS (SELECT tree_id, row_number() OVER w AS k, height - coalesce(lag(height) OVER w, 0) AS t FROM heights WHERE node >= 8 WINDOW w AS (PARTITION BY tree_id ORDER BY height)),
anc AS (SELECT nx.tree_id, sqrt(sum((p.t - q.t) ** 2)) / 7 AS ancestor_time FROM nx JOIN st p ON p.tree_id = nx.tree_id JOIN st q ON q.tree_id = nx.b AND q.k = p.k GROUP BY 1)
SELECT chrom, tree_id, b AS next_tree_id, round((SELECT avg(1 - best * best) FROM one WHERE one.tree_id = nx.tree_id), 6) AS correlation,
  CAST((SELECT count(*) FROM one WHERE one.tree_id = nx.tree_id AND best < 0.9) + (SELECT count(*) FROM two WHERE two.tree_id = nx.tree_id AND best < 0.9) AS INTEGER) AS partitions,
  round(branch_score, 6) AS branch_score, round(ancestor_time, 6) AS ancestor_time FROM nx JOIN score USING (tree_id) JOIN anc USING (tree_id)"""


@query("g11_g14_tree_distances", sql(_G11, "clades", "heights"))
def g11(spark, d):
    out = trees.compare_adjacent(views.trees(spark, d), 0.9)
    return out.select("chrom", "tree_id", "next_tree_id", r6("correlation").alias("correlation"), "partitions", r6("branch_score").alias("branch_score"), r6("ancestor_time").alias("ancestor_time"))


@query("g16_ancient_to_modern", sql("SELECT tree_id, node, branch_length + CASE WHEN node < 8 THEN node * 10 ELSE 0 END AS branch_length FROM nodes", "nodes"))
def g16(spark, d):
    ages = spark.range(N).select(F.col("id").cast("int").alias("node"), (F.col("id") * 10).cast("double").alias("age"))
    return trees.ancient_to_modern(trees.exploded(views.trees(spark, d)), ages).select("tree_id", "node", "branch_length")


@query("g18_path_to_root", sql("SELECT tree_id, above AS node FROM paths WHERE node = 3", "paths"))
def g18(spark, d):
    return trees.path_to_root(trees.clade_rows(views.trees(spark, d)), 3).select("tree_id", "node")


# ---- coalescence, mutation, selection ----
@query("c01_pair_events", sql("SELECT i, j, epoch, round(num, 3) AS num, round(denom, 3) AS denom FROM events_ij", "events_ij"))
def c01(spark, d):
    return pair_table(spark, d).select("i", "j", "epoch", F.round("num", 3).alias("num"), F.round("denom", 3).alias("denom"))


@query("c02_pair_events_with_ages", sql("SELECT i, j, epoch, round(sum(least(hi, tmrca) - greatest(lo, j)), 6) AS denom FROM pairs JOIN epochs ON lo < tmrca AND hi > j WHERE tmrca > j GROUP BY 1, 2, 3", "pairs", "epochs"))
def c02(spark, d):
    ages = spark.range(N).select(F.col("id").cast("int").alias("hap"), F.col("id").cast("double").alias("age"))
    p = trees.pair_times(views.trees(spark, d)).where("tmrca > j")
    return rates.pair_events(p, grid(spark), ages=ages).where("denom > 0").select("i", "j", "epoch", r6("denom").alias("denom"))


@query("c04_tree_rates", sql("SELECT epoch, round(sum(num) / nullif(sum(denom), 0), 9) AS rate FROM tree_events GROUP BY 1", "tree_events"))
def c04(spark, d):
    return rates.total_rates(tree_table(spark, d)).select("epoch", F.round("rate", 9).alias("rate"))


@query(
    "c08_epochs",
    """SELECT 'default' AS grid, CAST(e AS INTEGER) AS epoch, round(CASE WHEN e = 0 THEN 0.0 WHEN e = 1 THEN 1e3 / 28 WHEN e = 30 THEN 1e8 / 28 ELSE 10 ** (3 + 4 * (e - 1) / 28.0) / 28 END, 3) AS lo FROM range(31) r(e)
UNION ALL SELECT 'bins', CAST(e AS INTEGER), round(CASE WHEN e = 0 THEN 0.0 WHEN e <= 21 THEN 10 ** (3 + (e - 1) * 0.2) / 28 ELSE greatest(1e8, 10 * (1e7 / 28)) / 28 END, 3) FROM range(23) r(e)""",
)
def c08(spark, d):
    from treeloom.functions.epochs import binned_epochs, default_epochs

    both = epoch_table(spark, default_epochs()).select(F.lit("default").alias("grid"), "epoch", "lo").unionByName(epoch_table(spark, binned_epochs("3,7,0.2")).select(F.lit("bins").alias("grid"), "epoch", "lo"))
    return both.select("grid", "epoch", F.round("lo", 3).alias("lo"))


_R01 = """mf AS (SELECT epoch, sum((least(hi, age_end) - greatest(lo, age_begin)) / (age_end - age_begin)) AS mut FROM ages JOIN epochs ON lo < age_end AND hi > age_begin WHERE n_branches = 1 AND age_end > age_begin GROUP BY 1),
op AS (SELECT epoch, sum((least(hi, age_end) - greatest(lo, age_begin)) * k * span) AS opp FROM segments s JOIN spans USING (chrom, tree_id) JOIN epochs ON lo < age_end AND hi > age_begin GROUP BY 1)
SELECT epoch, round(coalesce(mut, 0), 6) AS mut, round(coalesce(opp, 0), 3) AS opp, round(coalesce(mut, 0) / nullif(opp, 0) * 1e6, 6) AS rate FROM op FULL JOIN mf USING (epoch)"""


@query("r01_average_rate", sql(_R01, "ages", "segments", "spans", "epochs"))
def r01(spark, d):
    out = mutation.average_rate(aged(spark, d), heights(spark, d), spans(spark, d), grid(spark))
    return out.select("epoch", r6("mut").alias("mut"), F.round("opp", 3).alias("opp"), r6(F.col("rate") * 1e6).alias("rate"))


@query("r02_segments", sql("SELECT tree_id, age_begin, age_end, k::BIGINT AS lineages FROM segments", "segments"))
def r02(spark, d):
    return rates.tree_segments(heights(spark, d)).select("tree_id", "age_begin", "age_end", "lineages")


@query("r03_branch_time", sql("SELECT tree_id, epoch, round(sum((least(hi, age_end) - greatest(lo, age_begin)) * k), 6) AS time FROM segments JOIN epochs ON lo < age_end AND hi > age_begin GROUP BY 1, 2", "segments", "epochs"))
def r03(spark, d):
    return mutation.branch_time(heights(spark, d), grid(spark)).select("tree_id", "epoch", r6("time").alias("time"))


@query("r04_tip_density", sql("pp AS (SELECT p.tree_id, p.above AS node, h.height AS age_begin, a.height AS age_end FROM paths p JOIN nodes n ON n.tree_id = p.tree_id AND n.node = p.above JOIN heights h ON h.tree_id = p.tree_id AND h.node = p.above JOIN heights a ON a.tree_id = p.tree_id AND a.node = n.parent WHERE p.node = 2) SELECT a.tree_id, epoch, round(sum((least(hi, a.age_end) - greatest(lo, a.age_begin)) / (a.age_end - a.age_begin)), 6) AS mut FROM ages a JOIN pp ON pp.tree_id = a.tree_id AND pp.node = a.branch JOIN epochs ON lo < a.age_end AND hi > a.age_begin WHERE n_branches = 1 GROUP BY 1, 2", "ages", "epochs"))
def r04(spark, d):
    path = branches(spark, d).join(trees.path_to_root(trees.clade_rows(views.trees(spark, d)), 2).select("tree_id", "node"), ["tree_id", "node"])
    out = mutation.tip_density(aged(spark, d), path, grid(spark), spans(spark, d).select("tree_id", "span"))
    return out.where("mut > 0").select("tree_id", "epoch", r6("mut").alias("mut"))


@query("r05_context_mutations", sql(_CONTEXT.replace("FROM muts WHERE anc <> der", "FROM ages JOIN epochs ON lo < age_end AND hi > age_begin WHERE anc <> der AND n_branches = 1 AND age_end > age_begin").replace("y AS (SELECT", "y AS (SELECT epoch, (least(hi, age_end) - greatest(lo, age_begin)) / (age_end - age_begin) AS f,").replace("AS category, count(*) AS n FROM y GROUP BY 1", "AS category, epoch, round(sum(f), 6) AS mut FROM y GROUP BY 1, 2"), "ages", "epochs"))
def r05(spark, d):
    return mutation.fractions(mutation.mapped(mutation.with_context(aged(spark, d))), grid(spark), ["category"]).select("category", "epoch", r6("mut").alias("mut"))


@query("r09_expected_observed", sql("w AS (SELECT b.tree_id, epoch, sum((least(hi, age_end) - greatest(lo, age_begin)) * span * 1e-7) AS expected FROM branches b JOIN spans s ON s.tree_id = b.tree_id JOIN epochs ON lo < age_end AND hi > age_begin GROUP BY 1, 2), o AS (SELECT tree_id, epoch, sum((least(hi, age_end) - greatest(lo, age_begin)) / (age_end - age_begin)) AS observed FROM ages JOIN epochs ON lo < age_end AND hi > age_begin WHERE n_branches = 1 AND age_end > age_begin GROUP BY 1, 2) SELECT w.tree_id, w.epoch, round(expected, 4) AS expected, round(coalesce(observed, 0), 4) AS observed FROM w LEFT JOIN o USING (tree_id, epoch)", "branches", "ages", "spans", "epochs"))
def r09(spark, d):
    out = mutation.expected_and_observed(branches(spark, d), aged(spark, d), spans(spark, d).select("tree_id", "span"), grid(spark), 1e-7)
    return out.select("tree_id", "epoch", F.round("expected", 4).alias("expected"), F.round("observed", 4).alias("observed"))


def paths_table(spark, d):
    tips = heights(spark, d).select("tree_id", F.col("node").alias("branch"), "n_tips")
    m = selection.eligible(views.muts(spark, d).join(tips, ["tree_id", "branch"]), 14)
    return selection.trajectories(m, views.trees(spark, d), grid(spark)).join(tips, ["tree_id", "branch"])


_L01 = """el AS (SELECT m.snp_id, m.tree_id, m.branch, count(*) AS n_tips FROM muts m JOIN clades c ON c.tree_id = m.tree_id AND c.node = m.branch WHERE n_branches = 1 AND NOT flipped AND branch <> 14 GROUP BY 1, 2, 3 HAVING count(*) > 2),
live AS (SELECT tree_id, node, epoch FROM branches JOIN epochs ON age_begin <= lo AND lo < age_end),
lin AS (SELECT tree_id, epoch, count(*) AS lineages FROM live GROUP BY 1, 2),
car AS (SELECT p.tree_id, p.above AS branch, l.epoch, count(*) AS carriers FROM paths p JOIN live l ON l.tree_id = p.tree_id AND l.node = p.node GROUP BY 1, 2, 3),
path AS (SELECT snp_id, lin.epoch, lineages, coalesce(carriers, 0) AS carriers, n_tips FROM el JOIN lin USING (tree_id) LEFT JOIN car ON car.tree_id = el.tree_id AND car.branch = el.branch AND car.epoch = lin.epoch)"""


@query("l01_trajectories", sql(f"{_L01} SELECT snp_id, epoch, lineages, carriers FROM path", "muts", "clades", "branches", "epochs"))
def l01(spark, d):
    return paths_table(spark, d).select("snp_id", "epoch", "lineages", "carriers")


_L02 = f"""{_L01}, p AS (SELECT *, {_LOG_P.format(n=8, k="lineages", fk="carriers", fn="n_tips")} AS log_p FROM path),
lifetime AS (SELECT snp_id, coalesce(arg_max(log_p, epoch) FILTER (carriers >= 2), 1.0) AS log_p, coalesce(arg_max(log_p, epoch) FILTER (carriers >= 2 AND 2 * carriers >= n_tips), 1.0) AS log_p_half FROM p GROUP BY 1)
SELECT snp_id, round(log_p, 6) + 0.0 AS log_p, round(log_p_half, 6) + 0.0 AS log_p_half FROM lifetime"""


@query("l02_selection_p", sql(_L02, "muts", "clades", "branches", "epochs"))
def l02(spark, d):
    return selection.over_lifetime(selection.p_values(paths_table(spark, d), N)).select("snp_id", r6("log_p").alias("log_p"), r6("log_p_half").alias("log_p_half"))


@query("l03_rsds", sql("b AS (SELECT c.tree_id, c.node AS branch, count(*) AS k, avg(n.branch_length) AS dl FROM clades c JOIN nodes n ON n.tree_id = c.tree_id AND n.node = c.leaf GROUP BY 1, 2), w AS (SELECT tree_id, sum(branch_length) AS s FROM nodes WHERE node < 8 GROUP BY 1) SELECT snp_id, round(ln((((s - dl * k) / (8 - k)) / dl) * k) / (8 - k), 6) AS rsds FROM muts m JOIN b ON b.tree_id = m.tree_id AND b.branch = m.branch JOIN w ON w.tree_id = m.tree_id WHERE k > 2 AND k < 8", "muts", "clades"))
def l03(spark, d):
    tips = trees.exploded(views.trees(spark, d)).where(F.col("node") < N).select("tree_id", F.col("node").alias("tip"), F.col("branch_length").alias("length"))
    return selection.tip_lengths(views.muts(spark, d), tips, trees.clade_rows(views.trees(spark, d)), N).select("snp_id", r6("rsds").alias("rsds"))


@query("l04_frequency_changes", sql(f"{_L01}, ch AS (SELECT * FROM (SELECT snp_id, n_tips, epoch, carriers / lineages - lag(carriers / lineages) OVER (PARTITION BY snp_id ORDER BY epoch) AS change FROM path) WHERE change IS NOT NULL), st AS (SELECT n_tips, epoch, avg(change) AS mean, stddev_samp(change) AS sd FROM ch GROUP BY 1, 2) SELECT snp_id, epoch, round(change, 6) AS change, round(CASE WHEN sd > 1e-9 THEN (change - mean) / sd END, 4) AS z FROM ch JOIN st USING (n_tips, epoch)", "muts", "clades", "branches", "epochs"))
def l04(spark, d):
    out = selection.standardised(selection.frequency_changes(paths_table(spark, d)))
    return out.select("snp_id", "epoch", r6("change").alias("change"), F.when(F.col("sd") > 1e-9, F.round("z", 4)).alias("z"))


@query("l05_quality", sql("SELECT tree_id, sum(num_events) AS events, round(sum(CASE WHEN node >= 8 AND num_events >= 1 THEN 1 ELSE 0 END) / 7.0, 6) AS frac_branches_with_snp FROM nodes GROUP BY 1", "nodes"))
def l05(spark, d):
    return selection.quality(trees.exploded(views.trees(spark, d)), N).select("tree_id", "events", r6("frac_branches_with_snp").alias("frac_branches_with_snp"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Coalescence rates of whole trees by epoch: fold, lineage window, epoch overlap, ratio of sums."""
    return QUERIES["c04_tree_rates"](spark, d)
