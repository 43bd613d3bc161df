"""Selection statistics from the spread of mutations through time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import alleles
from treeloom.operators import trees


def eligible(muts: DataFrame, root: int, least: int = 3) -> DataFrame:
    """Mutations on one branch but the root's, not flipped, with `least` carriers or more (column n_tips)."""
    return muts.where((F.col("n_branches") == 1) & ~F.col("flipped") & (F.col("branch") != root) & (F.col("n_tips") >= least))


def trajectories(muts: DataFrame, trees_: DataFrame, epochs: DataFrame, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(snp_id, epoch, lineages, carriers): branches of the mutation's tree that exist at the epoch's start, and those of
    them below the mutation or its own branch. The root has no branch.

    The tips below a node are a stretch of the tree's drawing, and the branches of one time share the tips out among them:
    those within a stretch are counted by two look-ups, so a tree costs its branches, not their pairs. epochs is a bounded
    grid and goes with the tasks.
    """
    grid = [(r["epoch"], r["lo"]) for r in epochs.orderBy("epoch").collect()]

    def kernel(t: trees.Tree, row: dict) -> pd.DataFrame:
        h, (first, last, _) = t.heights(), t.stretches()
        own = np.flatnonzero(t.parent >= 0)
        top = h[t.parent[own]]
        out = []
        for epoch, lo in grid:
            alive = own[(h[own] <= lo) & (lo < top)]
            if not len(alive):
                continue
            begins, ends = np.sort(first[alive]), np.sort(last[alive])
            # stretches of one time lie side by side: those that begin and end within another lie within it
            inside = np.maximum(0, np.searchsorted(ends, last, "right") - np.searchsorted(begins, first, "left"))
            out.append(pd.DataFrame({"branch": np.arange(t.size), "epoch": epoch, "lineages": len(alive), "carriers": inside}))
        return pd.concat(out) if out else pd.DataFrame({"branch": [], "epoch": [], "lineages": [], "carriers": []})

    counts = trees.map_trees(trees_.select(*keys, "nodes"), kernel, "branch int, epoch int, lineages long, carriers long", keys)
    return muts.select("snp_id", *keys, "branch").join(counts, [*keys, "branch"])


def p_values(paths: DataFrame, n: int) -> DataFrame:
    """paths with log_p of each epoch. paths(snp_id, epoch, lineages, carriers, n_tips: carriers today)."""
    return paths.withColumn("log_p", alleles.selection_log_p(n, F.col("n_tips"), F.col("lineages"), F.col("carriers")))


def over_lifetime(paths: DataFrame) -> DataFrame:
    """(snp_id, log_p, log_p_half): at the oldest epoch with two carriers, and at the oldest with half of today's."""
    two = F.when(F.col("carriers") >= 2, F.struct("epoch", "log_p"))
    half = F.when((F.col("carriers") >= 2) & (2 * F.col("carriers") >= F.col("n_tips")), F.struct("epoch", "log_p"))
    out = paths.groupBy("snp_id").agg(F.max(two).alias("a"), F.max(half).alias("b"))
    return out.select("snp_id", F.coalesce("a.log_p", F.lit(1.0)).alias("log_p"), F.coalesce("b.log_p", F.lit(1.0)).alias("log_p_half"))


def tip_lengths(muts: DataFrame, tips: DataFrame, clades: DataFrame, n: int, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(snp_id, n_tips, ancestral, derived, rsds): mean lengths of tip branches by allele. tips(keys, tip, length)."""
    own = clades.select(*keys, F.col("node").alias("branch"), F.col("tips").alias("__own"))
    branches = muts.select(*keys, "branch").distinct().join(own, [*keys, "branch"]).join(tips, keys)
    carried = F.array_contains("__own", F.col("tip"))
    means = branches.groupBy(*keys, "branch").agg(F.avg(F.when(carried, F.col("length"))).alias("derived"), F.avg(F.when(~carried, F.col("length"))).alias("ancestral"), F.sum(carried.cast("int")).alias("n_tips"))
    out = muts.select("snp_id", *keys, "branch").join(means, [*keys, "branch"]).where((F.col("n_tips") > 2) & (F.col("n_tips") < n))
    return out.withColumn("rsds", alleles.rsds(F.col("ancestral"), F.col("derived"), F.col("n_tips"), n))


def frequency_changes(paths: DataFrame) -> DataFrame:
    """(snp_id, n_tips, epoch, change): difference of carriers / lineages to the epoch before."""
    w = Window.partitionBy("snp_id").orderBy("epoch")
    share = F.col("carriers") / F.col("lineages")
    return paths.withColumn("share", share).withColumn("change", F.col("share") - F.lag("share").over(w)).where("change is not null").select("snp_id", "n_tips", "epoch", "change")


def standardised(changes: DataFrame, keys: list[str] = ["n_tips", "epoch"]) -> DataFrame:  # noqa: B006
    """changes with mean, sd (of samples) and z among mutations of one present frequency in one epoch; null if sd is 0."""
    # means are joined back rather than windowed: a common frequency isn't one task's work
    stats = changes.groupBy(*keys).agg(F.avg("change").alias("mean"), F.stddev_samp("change").alias("sd"))
    return changes.join(F.broadcast(stats), keys).withColumn("z", alleles.z_score(F.col("change"), F.col("mean"), F.col("sd")))


def quality(nodes: DataFrame, n: int, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(keys, events, frac_branches_with_snp): of inner nodes below the root's level, those with an event, over n - 1."""
    inner = (F.col("node") >= n) & (F.col("num_events") >= 1)
    return nodes.groupBy(*keys).agg(F.sum("num_events").alias("events"), (F.sum(inner.cast("int")) / (n - 1)).alias("frac_branches_with_snp"))


def low_quality(trees: DataFrame, share: float, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(keys, events, cut): trees with fewer events than sorted[int(share * n)] of all trees."""
    w = Window.partitionBy(*by).orderBy("events", "tree_id")
    ranked = trees.withColumns({"__k": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*by))})
    cut = ranked.where(F.col("__k") == F.least(F.floor(F.col("__n") * share), F.col("__n") - 1)).select(*by, F.col("events").alias("cut"))
    return ranked.drop("__k", "__n").join(F.broadcast(cut), by).where("events < cut")


def well_supported(trees: DataFrame, share: float, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(by, tree_id, events, new_id): trees with at least sorted[int(share * n)] events, numbered anew from 0."""
    w = Window.partitionBy(*by).orderBy("events", "tree_id")
    ranked = trees.withColumns({"__k": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*by))})
    cut = F.max(F.when(F.col("__k") == F.least(F.floor(F.col("__n") * share), F.col("__n") - 1), F.col("events"))).over(Window.partitionBy(*by))
    kept = ranked.withColumn("__cut", cut).where("events >= __cut").drop("__k", "__n", "__cut")
    return kept.withColumn("new_id", F.dense_rank().over(Window.partitionBy(*by).orderBy("tree_id")) - 1)


def annotation(value: Column) -> Column:
    """NA for null in text sinks."""
    return F.coalesce(value.cast("string"), F.lit("NA"))
