"""Tree-sequence tables: nodes, edges, sites and mutations, and what can be asked of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import trees
from treeloom.operators.intervals import interval_join


def from_trees(trees_: DataFrame, muts: DataFrame, ends: DataFrame) -> dict[str, DataFrame]:
    """The tables of a genealogy. ends(chrom, tree_id, lo, hi): the bases that each tree spans.

    Tips are shared by all trees; an inner node belongs to its tree. Node numbers are by time within a chromosome.
    """
    h = trees.with_heights(trees_)
    n = h.where("n_children = 0").groupBy("chrom").agg((F.max("node") + 1).alias("__n"))
    tips = h.where("n_children = 0").groupBy("chrom", "node").agg(F.min("height").alias("time")).select("chrom", F.lit(None).cast("int").alias("tree_id"), "node", F.col("node").cast("long").alias("id"), "time", F.lit(1).alias("is_sample"))
    w = Window.partitionBy("chrom").orderBy("height", "tree_id", "node")
    inner = h.where("n_children > 0").join(F.broadcast(n), "chrom").select("chrom", "tree_id", "node", (F.row_number().over(w) - 1 + F.col("__n")).cast("long").alias("id"), F.col("height").alias("time"), F.lit(0).alias("is_sample"))
    nodes = tips.unionByName(inner)
    up = inner.select("chrom", "tree_id", F.col("node").alias("parent"), F.col("id").alias("__p"), F.col("time").alias("parent_time"))
    down = inner.select("chrom", "tree_id", "node", F.col("id").alias("__c"))
    rows = h.where("parent >= 0").select("chrom", "tree_id", "node", "parent").join(up, ["chrom", "tree_id", "parent"]).join(down, ["chrom", "tree_id", "node"], "left").join(ends, ["chrom", "tree_id"])
    edges = rows.select("chrom", "tree_id", F.col("lo").alias("left"), F.col("hi").alias("right"), F.col("__p").alias("parent"), F.coalesce("__c", F.col("node").cast("long")).alias("child"), "parent_time")
    sites = muts.select("chrom", F.col("pos").alias("position"), F.col("anc").alias("ancestral_state")).dropDuplicates(["chrom", "position"])
    mutations = muts.join(down.withColumnRenamed("node", "branch"), ["chrom", "tree_id", "branch"], "left").select("chrom", F.col("pos").alias("position"), "snp_id", F.coalesce("__c", F.col("branch").cast("long")).alias("node"), F.col("der").alias("derived_state"))
    return {"nodes": nodes.select("chrom", "id", "time", "is_sample", "tree_id"), "edges": edges, "sites": sites, "mutations": mutations}


def sorted_edges(edges: DataFrame) -> DataFrame:
    """edges with rank: by time of the parent, parent, child and left end."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy("parent_time", "parent", "child", "left")))


def squashed(edges: DataFrame) -> DataFrame:
    """Edges of one parent and child that meet end to end as one."""
    w = Window.partitionBy("chrom", "parent", "child").orderBy("left")
    new = F.coalesce(F.lag("right").over(w) != F.col("left"), F.lit(True)).cast("int")
    return edges.withColumn("__run", F.sum(new).over(w)).groupBy("chrom", "parent", "child", "__run").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.first("parent_time").alias("parent_time")).drop("__run")


def check(tables: dict[str, DataFrame]) -> DataFrame:
    """(problem, n): edges without nodes, parents not older than children, overlapping edges of a child."""
    e, v = tables["edges"], tables["nodes"].select("chrom", "id", "time")
    a = e.join(v.select("chrom", F.col("id").alias("parent"), F.col("time").alias("__pt")), ["chrom", "parent"], "left").join(v.select("chrom", F.col("id").alias("child"), F.col("time").alias("__ct")), ["chrom", "child"], "left")
    w = Window.partitionBy("chrom", "child").orderBy("left")
    over = F.lag("right").over(w) > F.col("left")
    flags = a.select(F.col("__pt").isNull() | F.col("__ct").isNull(), F.col("__pt") < F.col("__ct"), F.coalesce(over, F.lit(False)), F.col("left") >= F.col("right")).toDF("missing_node", "wrong_order", "overlap", "empty")
    sums = flags.agg(*[F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in flags.columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in flags.columns])).alias("x")).select("x.*").where("n > 0")


def distinct_sites(sites: DataFrame) -> DataFrame:
    return sites.dropDuplicates(["chrom", "position"])


def mutation_parents(mutations: DataFrame, clades: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(snp_id, parent): of the mutations of one position the one on the nearest branch above. clades(keys, node, tips).

    Of the mutations on one branch at one position the smallest stands for all, so that only branches are paired.
    """
    place = [*keys, "pos", "branch"]
    first = mutations.groupBy(*place).agg(F.min("snp_id").alias("parent"))
    own = first.join(clades.withColumnRenamed("node", "branch"), [*keys, "branch"])
    a = own.select(*place, "tips")
    b = own.where("parent is not null").select(*keys, "pos", "parent", F.col("tips").alias("__above"))
    up = a.join(b, [*keys, "pos"]).where((F.size("tips") < F.size("__above")) & (F.size(F.array_except("tips", "__above")) == 0))
    near = up.groupBy(*place).agg(F.min(F.struct(F.size("__above").alias("n"), "parent")).alias("__near"))
    found = mutations.join(near, place).groupBy("snp_id").agg(F.min("__near")["parent"].alias("parent"))
    return mutations.select("snp_id").join(found, "snp_id", "left")


def edge_differences(edges: DataFrame) -> DataFrame:
    """(chrom, at, n_in, n_out): edges that begin and end at each breakpoint."""
    both = edges.select("chrom", F.col("left").alias("at"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select("chrom", F.col("right").alias("at"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("chrom", "at").agg(F.sum("a").alias("n_in"), F.sum("b").alias("n_out"))


def edges_over(edges: DataFrame, ranges: DataFrame, bucket: float) -> DataFrame:
    """Edges x the ranges (chrom, lo, hi) that they overlap."""
    return interval_join(edges, ranges, bucket, ["chrom"], l=("left", "right"), r=("lo", "hi"))


def diversity(counts: DataFrame) -> DataFrame:
    """Mean pairwise differences of sites with carriers of n: sum of 2 p (1 - p) n / (n - 1)."""
    p = F.col("carriers") / F.col("n")
    return counts.where("n > 1").agg(F.sum(2 * p * (1 - p) * F.col("n") / (F.col("n") - 1)).alias("diversity"))


def linkage(haps: DataFrame, reach: int, bucket: int | None = None) -> DataFrame:
    """(a, b, r2) of sites less than reach numbers apart. haps(snp_id, hap, allele); each site meets those near it only.

    Sums of products per pair and haplotype are taken at once from strings of alleles, one row for each site.
    """
    rows = haps.groupBy("snp_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]).alias("x"))
    bucket = bucket or reach
    a = rows.select(F.col("snp_id").alias("a"), F.col("x"), F.explode(F.array(F.floor(F.col("snp_id") / bucket), F.floor(F.col("snp_id") / bucket) + 1)).alias("k"))
    b = rows.select(F.col("snp_id").alias("b"), F.col("x").alias("y"), F.floor(F.col("snp_id") / bucket).alias("k"))
    near = a.join(b, "k").where((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") < reach))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    n = F.size("x")
    pa, pb, pab = add("x") / n, add("y") / n, add(F.zip_with("x", "y", lambda u, v: u * v)) / n
    d = pab - pa * pb
    return near.select("a", "b", (d * d / F.nullif(pa * (1 - pa) * pb * (1 - pb), F.lit(0.0))).alias("r2"))


def nearest_neighbours(trees_: DataFrame, groups: list[list[int]], keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(tip, grp, share): shares of each group among the other tips below the first ancestor that has any."""

    def kernel(t: trees.Tree, row: dict) -> pd.DataFrame:
        clades, out = t.clades(), []
        sets = [sum(1 << x for x in g) for g in groups]
        every = 0
        for s in sets:
            every |= s
        for tip in range(t.n):
            v = tip
            while t.parent[v] >= 0 and not clades[v] & every & ~(1 << tip):
                v = t.parent[v]
            found = clades[v] & every & ~(1 << tip)
            out += [(tip, g, (found & s).bit_count() / found.bit_count() if found else 0.0) for g, s in enumerate(sets)]
        return pd.DataFrame(out, columns=["tip", "grp", "share"])

    return trees.map_trees(trees_, kernel, "tip int, grp int, share double", keys)


def mean_descendants(trees_: DataFrame, groups: list[list[int]], keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(node, grp, n): tips of each group below each node."""

    def kernel(t: trees.Tree, row: dict) -> pd.DataFrame:
        c = t.clades()
        return pd.DataFrame([(v, g, float((c[v] & sum(1 << x for x in s)).bit_count())) for v in range(t.size) for g, s in enumerate(groups)], columns=["node", "grp", "n"])

    return trees.map_trees(trees_, kernel, "node int, grp int, n double", keys)


def genotypes_from_trees(muts: DataFrame, clades: DataFrame, n: int, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """muts with gt: 1 for the tips below the branch."""
    own = clades.select(*keys, F.col("node").alias("branch"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains("tips", i).cast("int").cast("string")), "").alias("gt"))
    return muts.join(own, [*keys, "branch"])


def vcf_lines(sites: DataFrame) -> DataFrame:
    """VCF lines of sites, two neighbouring haplotypes a sample."""
    # in one pass over the string: a substring for each sample would count its signs from the start
    even = F.substring(F.col("gt"), F.lit(1), F.length("gt") - F.length("gt") % 2)
    calls = F.rtrim(F.regexp_replace(even, "(?s)(.)(.)", "$1|$2\t"), F.lit("\t"))
    return sites.select("pos", F.concat_ws("\t", F.col("chrom").cast("string"), F.col("pos").cast("string"), "rsid", "anc", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), calls).alias("value"))
