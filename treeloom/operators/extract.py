"""Cutting, splitting and annotating genealogies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import trees
from treeloom.operators.intervals import as_of


def region(muts: DataFrame, first: int, last: int, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Mutations at first <= pos <= last, tree numbers from 0 in each chromosome."""
    kept = muts.where(F.col("pos").between(first, last))
    base = kept.groupBy(*by).agg(F.min("tree_id").alias("__base"))
    return kept.join(F.broadcast(base), by).withColumn("tree_id", F.col("tree_id") - F.col("__base")).drop("__base")


def trees_of(trees_: DataFrame, muts: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """The trees that mutations name."""
    return trees_.join(muts.select(*keys).distinct(), keys, "left_semi")


def tree_at(trees_: DataFrame, muts: DataFrame, chrom: int, first: int, last: int | None = None, years_per_gen: float = 28.0) -> DataFrame:
    """(tree_id, start, newick) of the trees from that of the first site at or after first to that of the last one."""
    own = muts.where(F.col("chrom") == chrom)
    lo = own.where(F.col("pos") >= first).agg(F.min_by("tree_id", "pos").alias("lo"))
    hi = own.where(F.col("pos") >= (first if last is None else last)).agg(F.min_by("tree_id", "pos").alias("hi"))
    bounds = lo.join(F.broadcast(hi))  # one row each
    kept = trees_.where(F.col("chrom") == chrom).join(F.broadcast(bounds), F.col("tree_id").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    start = own.groupBy("chrom", "tree_id").agg(F.min("pos").alias("start"))
    return trees.newicks(kept, years_per_gen).join(start, ["chrom", "tree_id"], "left")


def divided(trees_: DataFrame, muts: DataFrame, parts: int, least: int = 10) -> DataFrame:
    """trees with part: runs of trees / (5 parts) + 1 trees of a chromosome, `least` at least."""
    w = Window.partitionBy("chrom")
    n = F.count("*").over(w)
    width = F.greatest(F.floor(n / (5 * parts)) + 1, F.lit(least))
    k = F.row_number().over(w.orderBy("tree_id")) - 1
    return trees_.withColumn("part", F.floor(k / width).cast("int"))


def combined(parts: list[DataFrame]) -> DataFrame:
    """Parts as one, trees numbered anew from 0."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return renumbered(whole)


def renumbered(rows: DataFrame, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    return rows.withColumn("tree_id", (F.dense_rank().over(Window.partitionBy(*by).orderBy("tree_id")) - 1).cast("int"))


def group_carriers(muts: DataFrame, clades: DataFrame, groups: DataFrame, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(snp_id, grp, carriers): tips of each group below the mutation's branch. Counted once for a branch, then joined."""
    per_branch = clades.select(*keys, F.col("node").alias("branch"), F.explode("tips").alias("hap")).join(F.broadcast(groups), "hap").groupBy(*keys, "branch", "grp").agg(F.count("*").alias("carriers"))
    return muts.join(per_branch, [*keys, "branch"]).select("snp_id", *keys, "branch", "grp", "carriers")


def absorbed(muts: DataFrame, kept: Column, by: list[str], *order: str) -> DataFrame:
    """Kept sites with dist: their own and that of the sites after them up to the next kept one."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(kept.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = muts.withColumn("__run", run).withColumn("__kept", kept).where("__run > 0")
    others = [c for c in muts.columns if c not in (*by, "dist")]
    return rows.groupBy(*by, "__run").agg(*[F.first(F.when(F.col("__kept"), F.col(c)), ignorenulls=True).alias(c) for c in others], F.sum("dist").alias("dist")).drop("__run")


def subpopulation(trees_: DataFrame, tips: list[int]) -> DataFrame:
    """Trees of some tips only, one row each; neighbours with the same topology and lengths remain apart."""
    s = trees.subtrees(trees_, tips)
    return trees.packed(s.withColumns({"snp_begin": F.lit(0), "snp_end": F.lit(0), "num_events": F.col("num_events").cast("float")}))


def moved_branches(muts: DataFrame, trees_: DataFrame, tips: list[int], keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """Mutations with the branch of the restricted tree that holds their old one; those outside it go."""

    def kernel(t: trees.Tree, row: dict) -> pd.DataFrame:
        s, _, _ = t.subset(tips)
        where = {c: i for i, c in enumerate(s.clades())}
        bits = [sum(1 << i for i, x in enumerate(tips) if c >> x & 1) for c in t.clades()]
        return pd.DataFrame([(v, where[b]) for v, b in enumerate(bits) if b in where and b], columns=["branch", "new_branch"])

    moved = trees.map_trees(trees_, kernel, "branch int, new_branch int", keys)
    return muts.join(moved, [*keys, "branch"]).drop("branch").withColumnRenamed("new_branch", "branch")


def branch_summary(nodes: DataFrame, sites: DataFrame, keys: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Nodes with the bases and sites between snp_begin and snp_end. sites(chrom, snp_id, dist): prefix sums, two look-ups."""
    w = Window.partitionBy(*keys).orderBy("snp_id")
    run = sites.select(*keys, "snp_id", F.sum("dist").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__run"), "dist")
    a = run.select(*keys, F.col("snp_id").alias("snp_begin"), (F.col("__run") - F.col("dist")).alias("__lo"))
    b = run.select(*keys, F.col("snp_id").alias("snp_end"), F.col("__run").alias("__hi"))
    out = nodes.join(a, [*keys, "snp_begin"], "left").join(b, [*keys, "snp_end"], "left")
    return out.withColumn("bases", F.col("__hi") - F.col("__lo")).withColumn("n_sites", F.col("snp_end") - F.col("snp_begin") + 1).drop("__lo", "__hi")


def persistence(nodes: DataFrame, starts: DataFrame, keys: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Nodes with persists: whether their span reaches beyond their own tree. starts(chrom, tree_id, start_snp)."""
    w = Window.partitionBy(*keys).orderBy("tree_id")
    nxt = starts.select(*keys, "tree_id", F.lead("start_snp").over(w).alias("__next"), "start_snp")
    out = nodes.join(nxt, [*keys, "tree_id"])
    return out.withColumn("persists", F.coalesce(F.col("snp_end") >= F.col("__next"), F.lit(False)) | (F.col("snp_begin") < F.col("start_snp"))).drop("__next", "start_snp")


def unlinked(nodes: DataFrame, tips: DataFrame, muts: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """Nodes; those of listed tips get events and span from the mutations of their own tree only. tips(node)."""
    seen = muts.where("n_branches = 1").groupBy(*keys, F.col("branch").alias("node")).agg(F.count("*").cast("float").alias("__n"))
    span = muts.groupBy(*keys).agg(F.min("snp_id").alias("__b"), F.max("snp_id").alias("__e"))
    rows = nodes.join(tips.withColumn("__tip", F.lit(True)), "node", "left").join(seen, [*keys, "node"], "left").join(span, keys, "left")
    new = {"num_events": F.coalesce("__n", F.lit(0.0).cast("float")), "snp_begin": F.coalesce("__b", "snp_begin"), "snp_end": F.coalesce("__e", "snp_end")}
    return rows.withColumns({c: F.when(F.col("__tip"), x).otherwise(F.col(c)) for c, x in new.items()}).drop("__tip", "__n", "__b", "__e")


def coalescence_times(trees_: DataFrame, muts: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """muts with ancestral_times and derived_times: sorted ages of the coalescences outside and inside their clade."""

    def kernel(t: trees.Tree, row: dict) -> pd.DataFrame:
        first, last, _ = t.stretches()
        inner = np.arange(t.n, t.size)
        inner = inner[np.argsort(t.heights()[inner], kind="stable")]
        h = t.heights()[inner]
        rows = []
        for v in range(t.size):
            inside = (first[inner] >= first[v]) & (last[inner] <= last[v])
            rows.append((v, h[~inside].tolist(), h[inside].tolist()))
        return pd.DataFrame(rows, columns=["branch", "ancestral_times", "derived_times"])

    return muts.join(trees.map_trees(trees_, kernel, "branch int, ancestral_times array<double>, derived_times array<double>", keys), [*keys, "branch"])


def site_times(trees_: DataFrame, sites: DataFrame, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(by, pos, anc, der, daf, n, ancestral_times, derived_times) of sites that sampled trees map exactly.

    trees_(by, start, sample, nodes): trees that hold from start on, in samples 0, 1, ...; sites(by, pos, anc, der, gt). Each
    site goes to the last start at or before it. The derived times are those of the coalescences below the branch that
    has all carriers and no one else, sorted in each sample, samples one after the other; the others are ancestral. Sites
    that a sample doesn't map have no row, nor have those before the first tree.
    """
    starts = trees_.select(*by, "start").distinct()
    placed = as_of(sites.select(*by, "pos", "anc", "der", "gt"), starts, by, "pos", "start", []).where("at is not null").withColumnRenamed("at", "start")
    own = placed.groupBy(*by, "start").agg(F.collect_list(F.struct("pos", "anc", "der", "gt")).alias("__sites"))

    def kernel(t: trees.Tree, row: dict) -> pd.DataFrame:
        first, last, _ = t.stretches()
        inner = np.arange(t.n, t.size)
        inner = inner[np.argsort(t.heights()[inner], kind="stable")]
        h = t.heights()[inner]
        branch = {c: v for v, c in enumerate(t.clades())}
        out = []
        for s in row["__sites"]:
            carriers = [i for i, c in enumerate(s["gt"]) if c == "1"]
            v = branch.get(sum(1 << i for i in carriers))
            if v is not None and len(s["gt"]) == t.n:
                inside = (first[inner] >= first[v]) & (last[inner] <= last[v])
                out.append((s["pos"], s["anc"], s["der"], len(carriers), t.n, h[~inside].tolist(), h[inside].tolist()))
        return pd.DataFrame(out, columns=["pos", "anc", "der", "daf", "n", "ancestral", "derived"])

    keys = [*by, "start", "sample"]
    times = trees.map_trees(trees_.join(own, [*by, "start"]), kernel, "pos long, anc string, der string, daf int, n int, ancestral array<double>, derived array<double>", keys)
    samples = trees_.groupBy(*by, "start").agg(F.count("*").alias("__k"))
    listed = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sample", c))), lambda x: x[c]))
    rows = times.groupBy(*by, "start", "pos", "anc", "der", "daf", "n").agg(F.count("*").alias("__seen"), listed("ancestral").alias("ancestral_times"), listed("derived").alias("derived_times"))
    return rows.join(samples, [*by, "start"]).where("__seen = __k").drop("__seen", "__k", "start")


def propagated(muts: DataFrame, chains: DataFrame, keys: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(chrom, tree_id, node, snp_id): every mutation on all branches of its branch's chain. chains(chrom, tree_id, node, chain)."""
    own = muts.join(chains.withColumnRenamed("node", "branch"), [*keys, "tree_id", "branch"]).select(*keys, "chain", "snp_id")
    return chains.join(own, [*keys, "chain"])


def tip_heights(ages: list[float]) -> np.ndarray:
    return np.asarray(ages, float)
