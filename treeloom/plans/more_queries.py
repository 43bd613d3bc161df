"""Queries of formats, kernels, extraction and tree tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from treeloom.functions import alleles
from treeloom.operators import cleaning, extract, intervals, mutation, rates, tables, trees
from treeloom.plans import inference, views
from treeloom.plans.queries import _CONTEXT, _L02, BY, aged, branches, dists, grid, groups, heights, pair_table, query, r6, spans, tree_table
from treeloom.plans.views import sql
from treeloom.sources import binary, read, write
from treeloom.streaming import events as streams

TREE = ["chrom", "tree_id"]


# ---- formats: lines made from the tables, parsed again ----
@query("s03_sample_scan", "SELECT CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END AS ploidy, count(*) AS n FROM customer GROUP BY 1")
def s03(spark, d):
    c = views.table(spark, d, "customer").orderBy("c_custkey").coalesce(1)
    id_ = F.col("c_custkey").cast("string")
    rows = c.select(F.concat_ws(" ", id_, F.when(F.col("c_custkey") % 4 == 0, "NA").otherwise(id_), F.lit("0")).alias("value"))
    head = spark.createDataFrame([(h,) for h in write.SAMPLE_HEADER], "value string").coalesce(1)
    return read.samples(head.unionByName(rows)).groupBy("ploidy").agg(F.count("*").alias("n"))


@query("s04_k05_haps_lines", sql("SELECT CAST(chrom AS VARCHAR) AS chrom, rsid, pos, anc, alt, gt FROM sites", "sites"))
def s04(spark, d):
    lines = write.haps_lines(views.sites(spark, d)).select("value")
    return read.haps(lines).select(F.col("chrom").cast("string").alias("chrom"), "rsid", "pos", "anc", "alt", "gt")


@query("s05_genetic_map", "SELECT p_partkey * 10 AS bp, round(p_retailprice, 2) AS cm FROM part")
def s05(spark, d):
    p = views.table(spark, d, "part").select(F.concat_ws(" ", (F.col("p_partkey") * 10).cast("string"), F.lit("0"), F.round("p_retailprice", 2).cast("string")).alias("value"))
    head = spark.createDataFrame([("pos rate map",)], "value string").coalesce(1)
    return read.genetic_map(head.unionByName(p)).select("bp", "cm")


@query("s08_s09_k01_tree_lines", sql("SELECT tree_id, node, parent, branch_length, num_events, snp_begin, snp_end FROM nodes", "nodes"))
def s08(spark, d):
    lines = write.anc_lines(views.trees(spark, d))
    parsed = lines.select("tree_id", F.posexplode(read.tree_nodes(F.regexp_replace("value", r"^\s*\d+:\s", ""))).alias("node", "x"))
    return parsed.select("tree_id", "node", "x.parent", "x.branch_length", F.col("x.num_events").cast("double").alias("num_events"), "x.snp_begin", "x.snp_end")


@query("s12_k03_mutation_lines", sql("SELECT snp_id AS snp, pos, dist, tree_id, CASE WHEN n_branches = 2 THEN branch || ' ' || branch ELSE branch || '' END AS branches, flipped, 'r' AS rsid, (snp_id % 9)::DOUBLE AS age_begin, (snp_id % 9 + 1.5)::DOUBLE AS age_end, anc || '/' || der AS mutation_type FROM dists", "dists"))
def s12(spark, d):
    m = dists(spark, d).select(
        F.col("snp_id").alias("snp"), "pos", "dist", F.lit("r").alias("rsid"), "tree_id", F.when(F.col("n_branches") == 2, F.array("branch", "branch")).otherwise(F.array("branch")).alias("branches"), "flipped", (F.col("snp_id") % 9).cast("double").alias("age_begin"), (F.col("snp_id") % 9 + 1.5).cast("double").alias("age_end"), F.concat_ws("/", "anc", "der").alias("mutation_type")
    )
    head = spark.createDataFrame([(h,) for h in write.mut_header()], "value string").coalesce(1)
    got = read.mut(head.unionByName(write.mut_lines(m).select("value")))
    return got.select(F.col("snp").cast("long").alias("snp"), "pos", "dist", "tree_id", F.array_join(F.col("branches").cast("array<string>"), " ").alias("branches"), "flipped", "rsid", "age_begin", "age_end", "mutation_type")


@query("s16_vcf_scan", sql("SELECT snp_id, sum(allele)::BIGINT AS carriers FROM haps GROUP BY 1 HAVING sum(allele) BETWEEN 1 AND count(*) - 1", "haps"))
def s16(spark, d):
    got = read.vcf(tables.vcf_lines(views.sites(spark, d)).select("value"))
    return got.select(F.regexp_replace("rsid", "rs", "").cast("int").alias("snp_id"), alleles.carriers(F.col("gt")).cast("long").alias("carriers"))


@query("s21_k06_newick", sql("SELECT tree_id, sum(branch_length) AS total_length FROM nodes GROUP BY 1", "nodes"))
def s21(spark, d):
    nw = trees.newicks(views.trees(spark, d)).withColumnRenamed("newick", "tree")
    return read.newick_trees(nw).select("tree_id", F.aggregate("nodes", F.lit(0.0), lambda a, x: a + x["branch_length"]).alias("total_length"))


def _newick_sql(note: str, scale: str) -> str:
    """Trees of the view as text, level by level: tips, the nodes above two of them each, and so on; note(node) in each."""
    level = lambda k, below, first, last: f"l{k} AS (SELECT n.tree_id, n.node, n.parent, '(' || string_agg(c.text, ',' ORDER BY c.node) || ')' || {note} || printf(':%.5f', n.branch_length * {scale}) AS text FROM nodes n JOIN l{below} c ON c.tree_id = n.tree_id AND c.parent = n.node WHERE n.node BETWEEN {first} AND {last} GROUP BY n.tree_id, n.node, n.parent, n.branch_length)"
    tips = f"l0 AS (SELECT n.tree_id, n.node, n.parent, n.node || {note} || printf(':%.5f', n.branch_length * {scale}) AS text FROM nodes n WHERE n.node < 8)"
    root = f"newick AS (SELECT n.tree_id, '(' || string_agg(c.text, ',' ORDER BY c.node) || ')' || {note} || ';' AS newick FROM nodes n JOIN l2 c ON c.tree_id = n.tree_id AND c.parent = n.node WHERE n.node = 14 GROUP BY n.tree_id, n.node)"
    return ",\n".join([tips, level(1, 0, 8, 11), level(2, 1, 12, 13), root])


@query("k07_nhx", sql(_newick_sql("'[&&NHX:S=' || n.node || ']'", "1") + " SELECT CAST(tree_id % 5 AS INTEGER) AS chrom, tree_id, newick AS nhx, (SELECT string_agg(parent + 1, ',' ORDER BY node) FROM nodes WHERE nodes.tree_id = newick.tree_id) AS oriented FROM newick", "nodes"))
def k07(spark, d):
    def kernel(t, row):
        import pandas as pd

        return pd.DataFrame({"nhx": [t.nhx([str(v) for v in range(t.size)])], "oriented": [t.oriented()]})

    out = trees.map_trees(views.trees(spark, d), kernel, "nhx string, oriented array<int>", TREE)
    return out.withColumn("oriented", F.array_join(F.col("oriented").cast("array<string>"), ","))


@query("k12_rate_matrix", sql("r AS (SELECT epoch, round(sum(num) / nullif(sum(denom), 0), 9) AS rate FROM tree_events GROUP BY 1) SELECT 0 AS g, " + ", ".join(f'max(CASE WHEN epoch = {e} THEN rate END) AS "{e}"' for e in range(10)) + " FROM r", "tree_events"))
def k12(spark, d):
    return rates.matrix(rates.total_rates(tree_table(spark, d)).select(F.lit(0).alias("g"), "epoch", F.round("rate", 9).alias("rate")), ["g"], list(range(10)))


@query("k14_constant_rates", "SELECT CAST(e AS INTEGER) AS epoch, 1.0 / 30000 AS rate FROM range(10) r(e)")
def k14(spark, d):
    return rates.constant_rates(grid(spark), 30000.0)


#: Mutations of each context in each epoch, as a table named mutc.
_MUTC = _CONTEXT.replace("FROM muts WHERE anc <> der", "FROM ages JOIN epochs ON lo < age_end AND hi > age_begin WHERE anc <> der AND n_branches = 1 AND age_end > age_begin").replace("y AS (SELECT", "y AS (SELECT epoch, (least(hi, age_end) - greatest(lo, age_begin)) / (age_end - age_begin) AS f,")
_MUTC = _MUTC.replace("\nSELECT CAST(", ", mutc AS (SELECT CAST(").replace("AS category, count(*) AS n FROM y GROUP BY 1", "AS category, epoch, sum(f) AS mut FROM y GROUP BY 1, 2)")


@query("k15_category_matrix", sql(_MUTC + " SELECT epoch, " + ", ".join(f'max(CASE WHEN category = {c} THEN round(mut, 6) END) AS "{c}"' for c in range(96)) + " FROM mutc GROUP BY 1", "ages", "epochs"))
def k15(spark, d):
    m = mutation.fractions(mutation.mapped(mutation.with_context(aged(spark, d))), grid(spark), ["category"])
    return mutation.rate_matrix(m.withColumn("mut", r6("mut")), "mut")


@query("k23_dist_lines", sql("SELECT pos || ' ' || dist AS value FROM dists", "dists"))
def k23(spark, d):
    return write.dist_lines(dists(spark, d))[0].select("value")


# ---- more of trees and annotation ----
@query("g04_g06_drawing_orders")
def g04(spark, d):
    pairs = trees._adjacent(views.trees(spark, d).select("chrom", "tree_id", "nodes"), ["nodes"])

    def kernel(t, row):
        import pandas as pd

        u = trees.from_nodes(row["next_nodes"])
        own, other = t.tip_order(), u.tip_order()
        return pd.DataFrame({"crossings": [trees.crossings(own, other)], "aligned": [trees.crossings(own, trees.aligned_order(u, own))]})

    return trees.map_trees(pairs, kernel, "crossings int, aligned int", TREE)


@query("g15_relabel", sql("SELECT tree_id, node, CAST(CASE WHEN node < 8 THEN node ELSE 7 + row_number() OVER (PARTITION BY tree_id, node < 8 ORDER BY height, CASE WHEN node < 12 THEN 1 WHEN node < 14 THEN 2 ELSE 3 END, node) END AS INTEGER) AS label FROM heights", "heights"))
def g15(spark, d):
    def kernel(t, row):
        import numpy as np
        import pandas as pd

        return pd.DataFrame({"node": np.arange(t.size), "label": t.relabelled()})

    return trees.map_trees(views.trees(spark, d), kernel, "node int, label int", TREE).select("tree_id", "node", "label")


@query("g17_unlink_tips", sql("c AS (SELECT tree_id, branch AS node, count(*) AS k FROM muts WHERE n_branches = 1 GROUP BY 1, 2), e AS (SELECT tree_id, min(snp_id) AS b, max(snp_id) AS e FROM muts GROUP BY 1) SELECT n.chrom, n.tree_id, n.node, n.parent, n.branch_length, CAST(CASE WHEN n.node IN (1, 5) THEN coalesce(k, 0) ELSE num_events END AS FLOAT) AS num_events, CAST(CASE WHEN n.node IN (1, 5) THEN coalesce(b, snp_begin) ELSE snp_begin END AS BIGINT) AS snp_begin, CAST(CASE WHEN n.node IN (1, 5) THEN coalesce(e, snp_end) ELSE snp_end END AS BIGINT) AS snp_end FROM nodes n LEFT JOIN c USING (tree_id, node) LEFT JOIN e USING (tree_id)", "nodes", "muts"))
def g17(spark, d):
    tips = spark.createDataFrame([(1,), (5,)], "node int")
    return extract.unlinked(trees.exploded(views.trees(spark, d)), tips, views.muts(spark, d)).select(*TREE, "node", "parent", "branch_length", "num_events", "snp_begin", "snp_end")


@query("g19_coalescence_times", sql("b AS (SELECT p.tree_id, p.above AS branch, count(*) AS n, sum(h.height) AS t FROM paths p JOIN heights h ON h.tree_id = p.tree_id AND h.node = p.node WHERE p.node >= 8 GROUP BY 1, 2), a AS (SELECT tree_id, count(*) AS n, sum(height) AS t FROM heights WHERE node >= 8 GROUP BY 1) SELECT snp_id, CAST(coalesce(b.n, 0) AS INTEGER) AS n_derived, CAST(a.n - coalesce(b.n, 0) AS INTEGER) AS n_ancestral, coalesce(b.t, 0.0) AS derived, a.t - coalesce(b.t, 0.0) AS ancestral FROM muts m JOIN a USING (tree_id) LEFT JOIN b ON b.tree_id = m.tree_id AND b.branch = m.branch", "heights", "muts"))
def g19(spark, d):
    out = extract.coalescence_times(views.trees(spark, d), views.muts(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.select("snp_id", F.size("derived_times").alias("n_derived"), F.size("ancestral_times").alias("n_ancestral"), total("derived_times").alias("derived"), total("ancestral_times").alias("ancestral"))


@query("m13_branch_summary", sql("r AS (SELECT chrom, pos, dist, CAST(row_number() OVER (PARTITION BY chrom ORDER BY pos, snp_id) - 1 AS INTEGER) AS snp FROM dists), s AS (SELECT *, sum(dist) OVER (PARTITION BY chrom ORDER BY snp) AS run FROM r) SELECT n.tree_id, n.node, CAST(b.run - a.run + a.dist AS BIGINT) AS bases FROM nodes n LEFT JOIN s a ON a.chrom = n.chrom AND a.snp = n.snp_begin LEFT JOIN s b ON b.chrom = n.chrom AND b.snp = n.snp_end", "nodes", "dists"))
def m13(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("pos", "snp_id")
    s = dists(spark, d).select("chrom", (F.row_number().over(w) - 1).alias("snp"), "dist").withColumnRenamed("snp", "snp_id")
    return extract.branch_summary(trees.exploded(views.trees(spark, d)), s).select("tree_id", "node", "bases")


@query("m14_persistence", sql("s AS (SELECT chrom, tree_id, tree_id * 10 AS start_snp, lead(tree_id * 10) OVER (PARTITION BY chrom ORDER BY tree_id) AS nxt FROM (SELECT DISTINCT chrom, tree_id FROM nodes)) SELECT n.tree_id, n.node, coalesce(n.snp_end >= nxt, false) OR n.snp_begin < start_snp AS persists FROM nodes n JOIN s USING (tree_id)", "nodes"))
def m14(spark, d):
    t = views.trees(spark, d)
    return extract.persistence(trees.exploded(t), t.select("chrom", "tree_id", "start_snp")).select("tree_id", "node", "persists")


@query("m16_branches_below", sql("a AS (SELECT leaf FROM clades WHERE tree_id = 3 AND node = 12) SELECT node FROM clades c WHERE tree_id = 3 GROUP BY node HAVING bool_and(leaf IN (SELECT leaf FROM a))", "clades"))
def m16(spark, d):
    c = trees.clade_rows(views.trees(spark, d))
    return trees.below(c, F.col("tree_id") == 3, 12).select("node")


@query("v01_drawing", sql("SELECT tree_id, n.node, h.height AS y0, a.height AS y1 FROM nodes n JOIN heights h USING (tree_id, node) JOIN heights a ON a.tree_id = n.tree_id AND a.node = n.parent", "heights"))
def v01(spark, d):
    return trees.drawing(views.trees(spark, d)).where("kind = 'v'").select("tree_id", "node", "y0", "y1")


@query("e01_trees_of_interest", sql(_newick_sql("''", "28") + ", m AS (SELECT * FROM muts WHERE chrom = 2) SELECT tree_id, (SELECT min(pos) FROM m WHERE m.tree_id = newick.tree_id) AS start, newick FROM newick WHERE tree_id % 5 = 2 AND tree_id BETWEEN (SELECT arg_min(tree_id, pos) FROM m WHERE pos >= 1000000) AND (SELECT arg_min(tree_id, pos) FROM m WHERE pos >= 35000000)", "nodes", "muts"))
def e01(spark, d):
    return extract.tree_at(views.trees(spark, d), views.muts(spark, d), 2, 1_000_000, 35_000_000).select("tree_id", "start", "newick")


@query("e04_site_times", sql("""c8 AS (SELECT snp_id, string_agg(hap, ',' ORDER BY hap) AS c, count(*) AS daf FROM consensus8 WHERE allele = 1 GROUP BY 1),
cl AS (SELECT tree_id, node, string_agg(leaf, ',' ORDER BY leaf) AS c FROM clades GROUP BY 1, 2), s AS (SELECT snp_id, 1000 + 137 * snp_id AS pos, c, daf, least(4, (1000 + 137 * snp_id) // 2000) * 5 + 1 AS tree_id FROM c8),
b AS (SELECT p.tree_id, p.above AS node, count(*) AS n, sum(h.height) AS t FROM paths p JOIN heights h ON h.tree_id = p.tree_id AND h.node = p.node WHERE p.node >= 8 GROUP BY 1, 2), a AS (SELECT tree_id, sum(height) AS t FROM heights WHERE node >= 8 GROUP BY 1)
SELECT pos::BIGINT AS pos, CAST(daf AS INTEGER) AS daf, CAST(2 * coalesce(n, 0) AS INTEGER) AS n_derived, CAST(14 - 2 * coalesce(n, 0) AS INTEGER) AS n_ancestral, 3 * coalesce(b.t, 0.0) AS derived, 3 * (a.t - coalesce(b.t, 0.0)) AS ancestral
FROM s JOIN cl USING (tree_id, c) JOIN a USING (tree_id) LEFT JOIN b USING (tree_id, node)""", "consensus8", "clades", "heights"))
def e04(spark, d):
    """Two samples of the trees of a chromosome, the second twice as high, as newick lines, against sites of eight haplotypes."""
    t = views.trees(spark, d).where("chrom = 1").withColumn("sample", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = F.transform("nodes", lambda x: x.withField("branch_length", x["branch_length"] * (F.col("sample") + 1)))
    text = trees.newicks(t.withColumn("nodes", twice), keys=[*TREE, "sample"])
    rows = text.select(F.col("chrom").cast("string").alias("chrom"), (F.floor(F.col("tree_id") / 5) * 2000).alias("start"), (F.floor(F.col("tree_id") / 5) * 2000 + 2000).alias("end"), "sample", "newick")
    lines, head = write.newick_lines(rows)
    got = read.newick_intervals(spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(lines.select("value")))
    s = views.consensus(spark, d, views.TIPS).select(F.col("chrom").cast("string").alias("chrom"), "pos", "anc", F.col("alt").alias("der"), "gt")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return extract.site_times(got, s).select("pos", "daf", F.size("derived_times").alias("n_derived"), F.size("ancestral_times").alias("n_ancestral"), total("derived_times").alias("derived"), total("ancestral_times").alias("ancestral"))


#: The trees of the view for tips 0, 2, 5 and 7, which the view's other tips leave; what a mutation's branch has of them.
_E02 = """k AS (SELECT tree_id, node, string_agg(leaf, ',' ORDER BY leaf) AS c, count(*) AS n FROM clades WHERE leaf IN (0, 2, 5, 7) GROUP BY 1, 2),
top AS (SELECT k.tree_id, k.c, max(coalesce(a.height, h.height)) AS age_end FROM k JOIN heights h USING (tree_id, node) JOIN nodes o USING (tree_id, node) LEFT JOIN heights a ON a.tree_id = k.tree_id AND a.node = o.parent WHERE k.n < 4 GROUP BY 1, 2)
SELECT m.tree_id, k.c AS tips, count(*) AS n, max(CASE WHEN k.n = 4 THEN (SELECT min(h.height) FROM k q JOIN heights h USING (tree_id, node) WHERE q.tree_id = m.tree_id AND q.n = 4) ELSE t.age_end END) AS age_end
FROM muts m JOIN k ON k.tree_id = m.tree_id AND k.node = m.branch LEFT JOIN top t ON t.tree_id = k.tree_id AND t.c = k.c GROUP BY 1, 2"""


@query("e02_subpopulation", sql(_E02, "clades", "heights", "muts"))
def e02(spark, d):
    t = views.trees(spark, d)
    sub = extract.subpopulation(t, [0, 2, 5, 7])
    m = trees.mutation_ages(extract.moved_branches(views.muts(spark, d), t, [0, 2, 5, 7]), trees.with_heights(sub).select("tree_id", "node", "parent", "height"))
    own = trees.clade_rows(sub).select("tree_id", F.col("node").alias("branch"), F.array_join(F.transform("tips", lambda i: F.get(F.array(*map(F.lit, [0, 2, 5, 7])), i).cast("string")), ",").alias("tips"))
    return m.groupBy("tree_id", "branch").agg(F.count("*").alias("n"), F.max("age_end").alias("age_end")).join(own, ["tree_id", "branch"]).select("tree_id", "tips", "n", "age_end")


@query("u02_u04_split_and_combine", sql("SELECT tree_id, CAST(dense_rank() OVER (PARTITION BY chrom ORDER BY tree_id) - 1 AS INTEGER) AS new_id, node FROM nodes", "nodes"))
def u02(spark, d):
    t = extract.divided(views.trees(spark, d), views.muts(spark, d), 1, 2)
    whole = extract.combined([t.where(f"part = {k}") for k in range(3)]).withColumnRenamed("tree_id", "new_id")
    old = whole.withColumn("tree_id", (F.col("start_snp") / 10).cast("int"))
    return old.select("tree_id", "new_id", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1)).alias("node"))


@query("r06_r07_group_lineages", sql("g AS (SELECT tree_id, node, count(*) AS n, bool_or(leaf IN (0, 1, 2, 3)) AS has_some, bool_or(leaf NOT IN (4, 5)) AS has_more FROM clades GROUP BY 1, 2), b AS (SELECT br.* FROM branches br JOIN g USING (tree_id, node) WHERE n > 1 AND has_some AND has_more), d AS (SELECT chrom, tree_id, age, sum(d) AS d FROM (SELECT chrom, tree_id, age_begin AS age, 1 AS d FROM b UNION ALL SELECT chrom, tree_id, age_end, -1 FROM b) GROUP BY 1, 2, 3) SELECT chrom, tree_id, age, CAST(sum(d) OVER (PARTITION BY tree_id ORDER BY age) AS BIGINT) AS lineages FROM d", "clades", "branches"))
def r06(spark, d):
    return mutation.group_lineages(heights(spark, d), trees.clade_rows(views.trees(spark, d)), [0, 1, 2, 3], [4, 5])


@query("a22_mean_rate", sql("m AS (SELECT epoch, sum((least(hi, age_end) - greatest(lo, age_begin)) / (age_end - age_begin)) AS mut FROM ages JOIN epochs ON lo < age_end AND hi > age_begin WHERE anc <> der AND n_branches = 1 AND age_end > age_begin GROUP BY 1), o AS (SELECT epoch, sum((least(hi, age_end) - greatest(lo, age_begin)) * k) * 960 AS opp FROM segments JOIN epochs ON lo < age_end AND hi > age_begin GROUP BY 1) SELECT epoch, round(3 * coalesce(mut, 0) / nullif(opp, 0), 6) AS rate FROM o FULL JOIN m USING (epoch)", "ages", "segments", "epochs"))
def a22(spark, d):
    m = mutation.with_context(aged(spark, d))
    bases = views.trees(spark, d).select("chrom", "tree_id", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("category"), F.lit(10.0).alias("n"))
    out = mutation.category_rates(m, bases, mutation.branch_time(heights(spark, d), grid(spark)), grid(spark))
    return mutation.mean_rate(out).select("epoch", r6("rate").alias("rate"))


# ---- kernels on haplotypes that all embeddings make together; the kernels' time grows with the cube of their number ----
def _sites(spark, d):
    return cleaning.segregating(views.consensus(spark, d, 10))


def _chunks(spark, d):
    return inference.make_chunks(inference.prepare(_sites(spark, d)), 40, 10)


@query("p01_p02_painting")
def p01(spark, d):
    out = inference.paint(_chunks(spark, d))
    return out.select("chunk", "hap", "site", F.array_position("topology", F.array_max("topology")).alias("nearest"), r6("log_scale").alias("log_scale"))


@query("p06_p12_topology")
def p06(spark, d):
    out = inference.build_topology(_chunks(spark, d), 0.01)
    return out.select("chunk", "tree", "start_snp", F.size("nodes").alias("size"), F.size("muts").alias("n_muts"))


@query("o07_merged_genealogy")
def o07(spark, d):
    out = inference.merge_chunks(inference.build_topology(_chunks(spark, d), 0.01))
    return out.select("chrom", "tree_id", "start_snp", F.size("muts").alias("n_muts"))


@query("m01_m07_map_sites")
def m01(spark, d):
    t = views.trees(spark, d)
    s = cleaning.segregating(views.consensus(spark, d, views.TIPS)).select("snp_id", "gt", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("tree_id"))
    return inference.map_sites(t, s.join(t.select("chrom", "tree_id"), "tree_id"))


@query("m10_equivalent_branches")
def m10(spark, d):
    return inference.equivalent_branches(views.trees(spark, d))


@query("m11_m12_propagated")
def m11(spark, d):
    t = views.trees(spark, d)
    c = inference.branch_chains(t, inference.equivalent_branches(t))
    return extract.propagated(mutation.mapped(views.muts(spark, d)).select("chrom", "tree_id", "branch", "snp_id"), c)


@query("p19_posterior_lengths")
def p19(spark, d):
    s = inference.prepare(_sites(spark, d))
    g = inference.merge_chunks(inference.build_topology(inference.make_chunks(s, 40, 10), 0.01))
    out = inference.dated(g, s, 1e-5, 1000.0)
    return trees.tmrca(trees.with_heights(out.select("chrom", "tree_id", "nodes"))).select("tree_id", r6("tmrca").alias("tmrca"))


@query("p22_posterior_samples")
def p22(spark, d):
    s = inference.prepare(_sites(spark, d))
    g = inference.merge_chunks(inference.build_topology(inference.make_chunks(s, 40, 10), 0.01))
    out = inference.dated(g, s, 1e-5, 1000.0, samples=2)
    return out.select("tree_id", F.size("samples").alias("n"), r6(F.aggregate(F.col("samples")[1], F.lit(0.0), lambda a, x: a + x)).alias("total_length"))


@query("a24_optimise")
def a24(spark, d):
    return inference.optimise(_chunks(spark, d), [0.001, 0.02], [1.0])


# ---- tree tables ----
def _tables(spark, d):
    t = views.trees(spark, d)
    ends = t.select("chrom", "tree_id", (F.col("tree_id") * 100.0).alias("lo"), (F.col("tree_id") * 100.0 + 500).alias("hi"))
    return tables.from_trees(t, views.muts(spark, d), ends)


@query("tk01_k10_edges", sql("SELECT chrom, count(*) AS n, sum((tree_id * 100)::DOUBLE) AS lefts FROM nodes WHERE parent >= 0 GROUP BY 1", "nodes"))
def tk01(spark, d):
    return _tables(spark, d)["edges"].groupBy("chrom").agg(F.count("*").alias("n"), F.sum("left").alias("lefts"))


#: Nodes above tips with their numbers in the tables, and the edges of the tables.
_EDGES = """ids AS (SELECT n.chrom, n.tree_id, n.node, h.height, 7 + row_number() OVER (PARTITION BY n.chrom ORDER BY h.height, n.tree_id, n.node) AS id FROM nodes n JOIN heights h USING (tree_id, node) WHERE n.node >= 8),
edges AS (SELECT n.chrom, n.tree_id, n.tree_id * 100.0::DOUBLE AS "left", n.tree_id * 100.0::DOUBLE + 500 AS "right", p.id AS parent, coalesce(c.id, n.node) AS child, p.height AS parent_time
  FROM nodes n JOIN ids p ON p.tree_id = n.tree_id AND p.node = n.parent LEFT JOIN ids c ON c.tree_id = n.tree_id AND c.node = n.node)"""


@query("tk01_tables", sql(_EDGES + """, s AS (SELECT DISTINCT chrom, pos FROM muts), m AS (SELECT x.chrom, coalesce(ids.id, x.branch) AS node, pos, der FROM muts x LEFT JOIN ids ON ids.tree_id = x.tree_id AND ids.node = x.branch)
SELECT 'nodes' AS name, chrom, count(*) AS n, sum(id)::DOUBLE AS a, sum(height)::DOUBLE AS b FROM (SELECT chrom, id, height FROM ids UNION ALL SELECT DISTINCT chrom, node, 0.0 FROM nodes WHERE node < 8) GROUP BY 2
UNION ALL SELECT 'edges', chrom, count(*), sum(parent * 3 + child)::DOUBLE, sum(parent_time)::DOUBLE FROM edges GROUP BY 2
UNION ALL SELECT 'sites', chrom, count(*), sum(pos)::DOUBLE, 0.0 FROM s GROUP BY 2
UNION ALL SELECT 'mutations', chrom, count(*), sum(node)::DOUBLE, sum(pos * instr('ACGT', der))::DOUBLE FROM m GROUP BY 2""", "heights", "muts"))
def tk01b(spark, d):
    t = _tables(spark, d)
    total = lambda c: F.sum(c).cast("double")
    some = {
        "nodes": (total(F.col("id")), total(F.col("time"))),
        "edges": (total(F.col("parent") * 3 + F.col("child")), total(F.col("parent_time"))),
        "sites": (total(F.col("position")), F.lit(0.0)),
        "mutations": (total(F.col("node")), total(F.col("position") * F.instr(F.lit("ACGT"), F.col("derived_state")))),
    }
    out = None
    for name, (a, b) in some.items():
        own = t[name].groupBy("chrom").agg(F.count("*").alias("n"), a.alias("a"), b.alias("b")).withColumn("name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query("tk02_sorted_edges", sql(_EDGES + ' SELECT *, CAST(row_number() OVER (PARTITION BY chrom ORDER BY parent_time, parent, child, "left") AS INTEGER) AS rank FROM edges', "heights"))
def tk02(spark, d):
    return tables.sorted_edges(_tables(spark, d)["edges"])


@query("tk05_distinct_sites", sql("SELECT DISTINCT chrom, pos AS position FROM muts", "muts"))
def tk05(spark, d):
    return tables.distinct_sites(_tables(spark, d)["sites"]).select("chrom", "position")


@query("tk06_mutation_parents", sql("m AS (SELECT snp_id, tree_id, branch, pos // 100000 AS pos FROM muts), n AS (SELECT tree_id, node, count(*) AS n FROM clades GROUP BY 1, 2), u AS (SELECT a.snp_id, arg_min(b.snp_id, (n.n, b.snp_id)) AS parent FROM m a JOIN paths p ON p.tree_id = a.tree_id AND p.node = a.branch AND p.above <> a.branch JOIN m b ON b.tree_id = a.tree_id AND b.pos = a.pos AND b.branch = p.above JOIN n ON n.tree_id = b.tree_id AND n.node = b.branch GROUP BY 1) SELECT m.snp_id, parent FROM m LEFT JOIN u USING (snp_id)", "muts", "clades"))
def tk06(spark, d):
    m = views.muts(spark, d).withColumn("pos", F.floor(F.col("pos") / 100000))
    return tables.mutation_parents(m, trees.clade_rows(views.trees(spark, d)))


@query("tk08_edge_differences", sql("e AS (SELECT chrom, tree_id * 100.0 AS l, tree_id * 100.0 + 500 AS r FROM nodes WHERE parent >= 0), b AS (SELECT chrom, l AS p, 1 AS i, 0 AS o FROM e UNION ALL SELECT chrom, r, 0, 1 FROM e) SELECT chrom, p::DOUBLE AS at, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM b GROUP BY 1, 2", "nodes"))
def tk08(spark, d):
    return tables.edge_differences(_tables(spark, d)["edges"])


@query("tk10_diversity", sql("c AS (SELECT snp_id, sum(allele)::DOUBLE AS k, count(*)::DOUBLE AS n FROM haps GROUP BY 1) SELECT round(sum(2 * k / n * (1 - k / n) * n / (n - 1)), 6) AS diversity FROM c", "haps"))
def tk10(spark, d):
    return tables.diversity(cleaning.allele_counts(views.haps(spark, d))).select(r6("diversity").alias("diversity"))


@query("tk11_nearest_neighbours", sql("s AS (SELECT c.tree_id, c.leaf AS tip, n.parent FROM clades c JOIN nodes n ON n.tree_id = c.tree_id AND n.node = c.node WHERE c.node < 8) SELECT s.tree_id, s.tip, CAST(g AS INTEGER) AS grp, max(CASE WHEN c.leaf // 4 = g THEN 1.0 ELSE 0.0 END) AS share FROM s JOIN clades c ON c.tree_id = s.tree_id AND c.node = s.parent AND c.leaf <> s.tip, range(2) r(g) GROUP BY 1, 2, 3", "clades"))
def tk11(spark, d):
    return tables.nearest_neighbours(views.trees(spark, d), [[0, 1, 2, 3], [4, 5, 6, 7]]).select("tree_id", "tip", "grp", "share")


@query("tk12_mean_descendants", sql("SELECT c.tree_id, c.node, CAST(g AS INTEGER) AS grp, sum(CASE WHEN leaf // 4 = g THEN 1.0 ELSE 0.0 END)::DOUBLE AS n FROM clades c, range(2) r(g) GROUP BY 1, 2, 3", "clades"))
def tk12(spark, d):
    return tables.mean_descendants(views.trees(spark, d), [[0, 1, 2, 3], [4, 5, 6, 7]]).select("tree_id", "node", "grp", "n")


@query("tk13_linkage", sql("SELECT a.snp_id AS a, b.snp_id AS b, round(corr(a.allele, b.allele) ** 2, 6) AS r2 FROM haps a JOIN haps b ON a.hap = b.hap AND a.snp_id < b.snp_id AND b.snp_id - a.snp_id < 4 GROUP BY 1, 2", "haps"))
def tk13(spark, d):
    return tables.linkage(views.haps(spark, d), 4).select("a", "b", r6("r2").alias("r2"))


@query("tk14_genotypes", sql("g AS (SELECT t.tree_id, t.node, string_agg(CASE WHEN c.leaf IS NULL THEN '0' ELSE '1' END, '' ORDER BY i) AS gt FROM (SELECT DISTINCT tree_id, node FROM clades) t CROSS JOIN range(8) r(i) LEFT JOIN clades c ON c.tree_id = t.tree_id AND c.node = t.node AND c.leaf = i GROUP BY 1, 2) SELECT snp_id, gt FROM muts m JOIN g ON g.tree_id = m.tree_id AND g.node = m.branch", "muts", "clades"))
def tk14(spark, d):
    g = tables.genotypes_from_trees(views.muts(spark, d), trees.clade_rows(views.trees(spark, d)), views.TIPS)
    return g.select("snp_id", "gt")


@query("tk15_vcf_lines", sql("SELECT concat_ws(chr(9), chrom, pos, rsid, anc, alt, '.', 'PASS', '.', 'GT', array_to_string(list_transform(range(0, length(gt) // 2), lambda i: substr(gt, 2 * i + 1, 1) || '|' || substr(gt, 2 * i + 2, 1)), chr(9))) AS value FROM sites", "sites"))
def tk15(spark, d):
    return tables.vcf_lines(views.sites(spark, d)).select("value")


_O10 = """x AS (SELECT snp_id, anc, alt, substr('ACGT', (snp_id * 3) % 4 + 1, 1) AS a, 3 * snp_id + 1 AS pos FROM sites),
k AS (SELECT snp_id, sum(allele) AS c, count(*) AS n FROM haps WHERE grp <> 9 GROUP BY 1),
p AS (SELECT x.*, CASE WHEN a = anc THEN c ELSE n - c END AS carriers FROM x JOIN k USING (snp_id) WHERE a IN (anc, alt) AND c BETWEEN 1 AND n - 1),
f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY p RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY p) - CASE WHEN ok THEN 0 ELSE 1 END AS before FROM mask WHERE chrom = 1),
s AS (SELECT p.*, f.before FROM p JOIN f ON f.p = p.pos WHERE ok AND near < 8),
c AS (SELECT snp_id, CAST(count(DISTINCT grp) AS INTEGER) AS n_groups FROM haps WHERE grp <> 9 GROUP BY 1)
SELECT snp_id, pos::BIGINT AS pos, CASE WHEN a = anc THEN anc ELSE alt END AS anc, CASE WHEN a = anc THEN alt ELSE anc END AS alt, carriers::BIGINT AS carriers,
  greatest(coalesce((lead(pos) OVER w - pos) - (lead(before) OVER w - before), 1), 1)::BIGINT AS dist,
  nullif(substr('ACGTTGCA', (pos - 2) % 8 + 1, CASE WHEN pos > 1 THEN 1 ELSE 0 END), '') AS upstream, substr('ACGTTGCA', pos % 8 + 1, 1) AS downstream, n_groups
FROM s JOIN c USING (snp_id) WINDOW w AS (ORDER BY pos)"""


@query("o10_prepare_input", sql(_O10, "sites", "mask"))
def o10(spark, d):
    """Unique positions, polarised, samples of a group removed, masked, annotated."""
    s = cleaning.unique_positions(views.sites(spark, d).withColumn("pos", (F.col("snp_id") * 3 + 1).cast("long")))
    s = cleaning.polarise(s, F.substring(F.lit("ACGT"), (F.col("snp_id") * 3 % 4 + 1).cast("int"), F.lit(1)))
    # haplotypes have places in a site's string by vec_id
    removed = views.table(spark, d, "embeddings").select("vec_id", (F.coalesce(F.col("label") == 9, F.lit(True))).alias("removed")).orderBy("vec_id").select("removed").toPandas()["removed"]
    s = cleaning.remove_haplotypes(s, np.flatnonzero(~removed.to_numpy(bool)).tolist())
    bases = views.mask(spark, d).withColumn("p", F.col("p").cast("long"))
    s = cleaning.filter_by_mask(s, bases, reach=20, most=8)
    counts = cleaning.group_counts(views.haps(spark, d).where("grp <> 9").withColumn("grp", F.col("grp").cast("string")))
    out = cleaning.annotate(s.withColumn("seq", F.repeat(F.lit("ACGTTGCA"), 2000)), "seq", counts)
    return out.select("snp_id", "pos", "anc", "alt", alleles.carriers(F.col("gt")).cast("long").alias("carriers"), F.col("dist").cast("long").alias("dist"), "upstream", "downstream", F.size("freq").alias("n_groups"))


@query("a05_group_pair_sums", sql("SELECT least(a.grp, b.grp) AS g1, greatest(a.grp, b.grp) AS g2, epoch, round(sum(num), 3)::DOUBLE AS num, round(sum(denom), 3)::DOUBLE AS denom FROM events_ij e JOIN grp_of a ON a.hap = e.i JOIN grp_of b ON b.hap = e.j GROUP BY 1, 2, 3", "events_ij", "grp_of"))
def a05b(spark, d):
    return rates.group_rates(pair_table(spark, d), groups(spark)).select("g1", "g2", "epoch", F.round("num", 3).alias("num"), F.round("denom", 3).alias("denom"))


@query("l02_selection_over_lifetime", sql(_L02, "muts", "clades", "branches", "epochs"))
def o12(spark, d):
    from treeloom.operators import selection
    from treeloom.plans.queries import paths_table

    out = selection.over_lifetime(selection.p_values(paths_table(spark, d), views.TIPS))
    return out.select("snp_id", r6("log_p").alias("log_p"), r6("log_p_half").alias("log_p_half"))


@query("j12_opportunity_per_tree", sql("SELECT tree_id, round(sum(age_end - age_begin), 6) AS time FROM branches GROUP BY 1", "branches"))
def j12b(spark, d):
    return branches(spark, d).groupBy("tree_id").agg(r6(F.sum(F.col("age_end") - F.col("age_begin"))).alias("time"))


@query("c09_genome_blocks", sql("b AS (SELECT chrom, tree_id, (row_number() OVER (PARTITION BY chrom ORDER BY tree_id) - 1) // 2 AS own FROM spans), n AS (SELECT chrom, max(own) + 1 AS n FROM b GROUP BY 1) SELECT b.chrom, tree_id, CAST(own + coalesce((SELECT sum(n) FROM n WHERE n.chrom < b.chrom), 0) AS INTEGER) AS block FROM b", "spans"))
def c09(spark, d):
    return rates.genome_blocks(spans(spark, d), 2).select("chrom", "tree_id", "block")


_GROUP_RATES = """g AS (SELECT tree_id, node, count(*) AS n, bool_or(leaf IN (0, 1, 2, 3)) AS has_some, bool_or(leaf NOT IN (4, 5)) AS has_more FROM clades GROUP BY 1, 2), b AS (SELECT br.* FROM branches br JOIN g USING (tree_id, node) WHERE n > 1 AND has_some AND has_more),
d AS (SELECT tree_id, age, sum(d) AS d FROM (SELECT tree_id, age_begin AS age, 1 AS d FROM b UNION ALL SELECT tree_id, age_end, -1 FROM b) GROUP BY 1, 2),
l AS (SELECT tree_id, age AS age_begin, lead(age) OVER w AS age_end, sum(d) OVER w AS k FROM d WINDOW w AS (PARTITION BY tree_id ORDER BY age)),
opp AS (SELECT epoch, category, sum((least(hi, age_end) - greatest(lo, age_begin)) * k * (category + 1) * 10) AS denom FROM l JOIN epochs ON lo < age_end AND hi > age_begin, range(2) r(category) WHERE k > 0 GROUP BY 1, 2),
mut AS (SELECT epoch, CASE WHEN anc IN ('C', 'G') THEN 0 ELSE 1 END AS category, sum((least(hi, age_end) - greatest(lo, age_begin)) / (age_end - age_begin)) AS num FROM ages a JOIN epochs ON lo < age_end AND hi > age_begin
  WHERE n_branches = 1 AND age_end > age_begin AND anc <> der AND (SELECT count(*) > 1 AND bool_or(leaf IN (0, 1, 2, 3)) FROM clades c WHERE c.tree_id = a.tree_id AND c.node = a.branch) GROUP BY 1, 2)
SELECT CAST(category AS INTEGER) AS category, epoch, round(coalesce(num, 0), 6) AS num, round(coalesce(denom, 0), 6) AS denom, round(coalesce(num, 0) / nullif(denom, 0), 6) AS rate FROM opp FULL JOIN mut USING (category, epoch)"""


def _group_blocks(spark, d):
    """Mutations that segregate in a group, in two categories, over the group's time."""
    rows = [(u, v, a, e, 0 if a in "CG" else 1) for u in "ACGT" for v in "ACGT" for a in "CA" for e in "ACGT" if a != e]
    table = spark.createDataFrame(rows, "up string, down string, anc string, der string, category int")
    clades = trees.clade_rows(views.trees(spark, d))
    m = mutation.categorised(mutation.segregating_in(aged(spark, d), clades, [0, 1, 2, 3]), table)
    time = mutation.group_time(mutation.group_lineages(heights(spark, d), clades, [0, 1, 2, 3], [4, 5]), grid(spark))
    bases = views.trees(spark, d).select(*TREE, F.explode(F.array(F.lit(0), F.lit(1))).alias("category")).withColumn("n", (F.col("category") + 1) * 10.0)
    return mutation.category_blocks(m, bases, time, rates.genome_blocks(spans(spark, d), 2), grid(spark))


@query("r06_r07_group_rates", sql(_GROUP_RATES, "clades", "branches", "ages", "epochs"))
def r06b(spark, d):
    """The replicate that takes every block once."""
    e = _group_blocks(spark, d)
    out = rates.bootstrap_rates(e, rates.bootstrap_weights(e.select("block").distinct(), 5), ["category", "epoch"]).where("replicate = 0")
    return out.select("category", "epoch", r6("num").alias("num"), r6("denom").alias("denom"), r6("rate").alias("rate"))


@query("a10_bootstrap_totals", sql("n AS (SELECT CAST(sum((n + 1) // 2) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM spans GROUP BY chrom)) SELECT CAST(r AS INTEGER) AS replicate, n.n AS drawn FROM n, range(5) t(r)", "spans"))
def a10(spark, d):
    """As many blocks are drawn in each replicate as there are."""
    blocks = rates.genome_blocks(spans(spark, d), 2).select("block").distinct()
    return rates.bootstrap_weights(blocks, 5).groupBy("replicate").agg(F.sum("weight").alias("drawn"))


# ---- binary and short formats, lists of tips and groups ----
@query("s11_k02_tree_binary", sql("SELECT chrom, tree_id, node, parent, branch_length, num_events, snp_begin, snp_end FROM nodes", "nodes"))
def s11(spark, d):
    """Records of a chromosome after its head, read again."""
    records = binary.tree_records(views.trees(spark, d))
    files = records.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("tree_id", "value"))).alias("x"))
    head = F.lit(bytearray(binary.tree_head(views.TIPS, 5)))  # five trees a chromosome
    content = F.aggregate(F.transform("x", lambda r: r["value"]), head, lambda a, v: F.concat(a, v))
    got = binary.trees(files.select(F.col("chrom").cast("string").alias("path"), content.alias("content")))
    own = got.select(F.col("path").cast("int").alias("chrom"), (F.col("tree_id") * 5 + F.col("path").cast("int")).alias("tree_id"), F.posexplode("nodes").alias("node", "x"))
    return own.select(*TREE, "node", "x.parent", "x.branch_length", F.col("x.num_events").cast("double").alias("num_events"), "x.snp_begin", "x.snp_end")


@query("s34_haplotype_matrix", sql("SELECT snp_id::BIGINT AS row, gt FROM sites", "sites"))
def s34(spark, d):
    rows = binary.haplotypes(views.sites(spark, d))
    head = F.lit(bytearray(binary.matrix_head(64, views.table(spark, d, "embeddings").count())))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("snp_id", "value"))).alias("x"))
    content = F.aggregate(F.transform("x", lambda r: r["value"]), head, lambda a, v: F.concat(a, v))
    got = binary.matrices(whole.select(F.lit("m").alias("path"), content.alias("content")), "char")
    return got.select("row", F.array_join(F.transform("values", lambda v: F.char(v.cast("long"))), "").alias("gt"))


@query("s13_k04_short_mutations", sql("r AS (SELECT *, CAST(row_number() OVER (ORDER BY snp_id) - 1 AS INTEGER) AS snp FROM muts) SELECT snp, tree_id, branch, n_branches = 2 AS unmapped, flipped, (branch + 0.5)::DOUBLE AS age_begin, (branch + 2)::DOUBLE AS age_end FROM r", "muts"))
def s13(spark, d):
    m = views.muts(spark, d).select(F.col("snp_id").alias("snp"), "tree_id", F.when(F.col("n_branches") == 2, F.array("branch", "branch")).otherwise(F.array("branch")).alias("branches"), "flipped", (F.col("branch") + 0.5).alias("age_begin"), (F.col("branch") + 2.0).alias("age_end"))
    lines = write.mut_short_lines(m).repartitionByRange(1, "snp").sortWithinPartitions("snp").select("value")
    head = spark.createDataFrame([(write.MUT_SHORT_HEADER,)], "value string").coalesce(1)
    return read.mut_short(head.unionByName(lines)).select("snp", "tree_id", F.col("branches")[0].alias("branch"), "unmapped", "flipped", "age_begin", "age_end")


@query("t09_group_names", sql("SELECT grp, CAST(row_number() OVER (ORDER BY grp) - 1 AS INTEGER) AS number FROM (SELECT DISTINCT grp FROM grp_of)", "grp_of"))
def t09(spark, d):
    return cleaning.group_names(groups(spark))


@query("u06_merged_tips", sql("SELECT tree_id, parent AS node, string_agg(leaf, ',' ORDER BY leaf) AS tips FROM clades JOIN nodes USING (tree_id, node) WHERE parent >= 0 GROUP BY 1, 2", "clades"))
def u06(spark, d):
    c = trees.clade_rows(views.trees(spark, d)).join(trees.exploded(views.trees(spark, d)).select(*TREE, "node", "parent"), [*TREE, "node"]).where("parent >= 0")
    both = c.groupBy(*TREE, "parent").agg(F.min_by("tips", "node").alias("a"), F.max_by("tips", "node").alias("b"))
    return both.select("tree_id", F.col("parent").alias("node"), F.array_join(trees.merged_tips(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("tips"))


@query("m09_clade_sizes", sql("s AS (SELECT tree_id, node, count(*) AS n FROM clades GROUP BY 1, 2) SELECT tree_id, CAST(n AS INTEGER) AS n_tips, string_agg(node, ',' ORDER BY node) AS branches FROM s GROUP BY 1, 2", "clades"))
def m09(spark, d):
    return trees.clade_sizes(heights(spark, d)).select("tree_id", "n_tips", F.array_join(F.col("branches").cast("array<string>"), ",").alias("branches"))


@query("w12_restricted_lineages", sql("g AS (SELECT tree_id, node, count(*) AS n, bool_or(leaf IN (1, 3, 5)) AS has_some, bool_or(leaf NOT IN (-1)) AS has_more FROM clades GROUP BY 1, 2), b AS (SELECT br.* FROM branches br JOIN g USING (tree_id, node) WHERE n > 1 AND has_some AND has_more), d AS (SELECT chrom, tree_id, age, sum(d) AS d FROM (SELECT chrom, tree_id, age_begin AS age, 1 AS d FROM b UNION ALL SELECT chrom, tree_id, age_end, -1 FROM b) GROUP BY 1, 2, 3) SELECT chrom, tree_id, age, CAST(sum(d) OVER (PARTITION BY tree_id ORDER BY age) AS BIGINT) AS lineages FROM d", "clades", "branches"))
def w12(spark, d):
    return mutation.group_lineages(heights(spark, d), trees.clade_rows(views.trees(spark, d)), [1, 3, 5])


@query("w16_frequency_steps", sql("SELECT * FROM (SELECT chrom, epoch, round(denom - lag(denom) OVER (PARTITION BY chrom ORDER BY epoch), 6) AS step FROM (SELECT chrom, epoch, sum(denom) AS denom FROM tree_events GROUP BY 1, 2)) WHERE step IS NOT NULL", "tree_events"))
def w16(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("epoch")
    e = tree_table(spark, d).groupBy("chrom", "epoch").agg(F.sum("denom").alias("denom"))
    return e.select("chrom", "epoch", r6(F.col("denom") - F.lag("denom").over(w)).alias("step")).where("step is not null")


@query("j08_site_ranges", sql("s AS (SELECT DISTINCT chrom, pos FROM muts) SELECT chrom, pos, coalesce((lag(pos) OVER w + pos) / 2.0, pos) AS lo, coalesce((lead(pos) OVER w + pos) / 2.0, pos) AS hi FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos)", "muts"))
def j08b(spark, d):
    return intervals.nearest_ranges(views.muts(spark, d).select("chrom", "pos").distinct(), BY)


# ---- extension: windows over events ----
@query("ext_tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext1(spark, d):
    e = streams.windowed(views.table(spark, d, "events"))
    return e.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total").alias("total"))


@query("ext_sessions", "g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k".join(["WITH ", ""]))
def ext2(spark, d):
    return streams.sessions(views.table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
