"""Coalescence rates: events over exposure, for pairs of tips and for whole trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import trees, windows
from treeloom.operators.intervals import at_epoch, with_epochs


#: Bytes of the partial matrices that a task holds.
MATRIX = 256 << 20


def pair_events(pairs: DataFrame, epochs: DataFrame, spans: DataFrame | None = None, ages: DataFrame | None = None, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(i, j, epoch, num, denom) summed over trees: coalescences in [lo, hi) and time at risk, weighted by the tree's span.

    pairs: (tree_id, i, j, tmrca). With ages(hap, age), exposure begins at the older of both samples.
    """
    rows = pairs if spans is None else pairs.join(spans.select(*keys, "span"), keys)
    weight = F.lit(1.0) if spans is None else F.col("span")
    begin: Column = F.lit(0.0)
    if ages is not None:
        a = ages.select(F.col("hap").alias("i"), F.col("age").alias("__ai"))
        b = ages.select(F.col("hap").alias("j"), F.col("age").alias("__aj"))
        rows = rows.join(F.broadcast(a), "i", "left").join(F.broadcast(b), "j", "left")  # one row for each tip
        begin = F.greatest(F.coalesce("__ai", F.lit(0.0)), F.coalesce("__aj", F.lit(0.0)))
    rows = rows.withColumns({"__w": weight, "__begin": begin})
    exposed = with_epochs(rows, epochs, "__begin", "tmrca").groupBy("i", "j", "epoch").agg(F.sum(F.col("shared") * F.col("__w")).alias("denom"))
    events = at_epoch(rows, epochs, "tmrca").groupBy("i", "j", "epoch").agg(F.sum("__w").alias("num"))
    return exposed.join(events, ["i", "j", "epoch"], "full_outer").select("i", "j", "epoch", F.coalesce("num", F.lit(0.0)).alias("num"), F.coalesce("denom", F.lit(0.0)).alias("denom"))


def pair_sums(trees_: DataFrame, spans: DataFrame, epochs: DataFrame, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(i, j, epoch, num, denom) as pair_events has them, straight from trees: the pairs of a tree are summed where the tree
    is, over all trees of a batch, so that partial matrices are shuffled, not pairs of each tree.

    epochs is a bounded grid and goes with the tasks; the matrices of a batch take MATRIX bytes at a time.
    """
    grid = [(r["epoch"], r["lo"], r["hi"]) for r in epochs.orderBy("epoch").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes: dict[int, list] = {}
            for nodes, span in zip(batch["nodes"], batch["span"], strict=True):
                t = trees.from_nodes(nodes)
                sizes.setdefault(t.n, []).append((t, float(span)))
            for n, own in sizes.items():
                i, j = np.triu_indices(n, 1)
                at_once = max(1, MATRIX // (16 * max(1, len(i))))
                for a in range(0, len(grid), at_once):
                    part = grid[a : a + at_once]
                    num, denom, seen = (np.zeros((len(part), len(i))) for _ in range(3))
                    for t, span in own:
                        tmrca = t.pair_times()[i, j]
                        for e, (_, lo, hi) in enumerate(part):
                            num[e] += span * ((lo <= tmrca) & (tmrca < hi))
                            denom[e] += span * np.maximum(0.0, np.minimum(hi, tmrca) - max(lo, 0.0))
                            seen[e] += (lo <= tmrca) & (tmrca < hi) | (lo < tmrca) & (hi > 0)
                    e, k = np.nonzero(seen)
                    yield pd.DataFrame({"i": i[k], "j": j[k], "epoch": np.array([x[0] for x in part])[e], "num": num[e, k], "denom": denom[e, k]})

    rows = trees_.join(spans.select(*keys, "span"), keys).select("nodes", F.col("span").cast("double").alias("span"))
    return rows.mapInPandas(run, "i int, j int, epoch int, num double, denom double").groupBy("i", "j", "epoch").agg(F.sum("num").alias("num"), F.sum("denom").alias("denom"))


def ratio(num: Column, denom: Column) -> Column:
    """num / denom, null where nothing is at risk."""
    return num / F.nullif(denom, F.lit(0.0))


def summed(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Partial matrices of several chromosomes as one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def total_rates(events: DataFrame) -> DataFrame:
    return events.groupBy("epoch").agg(F.sum("num").alias("num"), F.sum("denom").alias("denom")).withColumn("rate", ratio(F.col("num"), F.col("denom")))


def _named(events: DataFrame, groups: DataFrame) -> DataFrame:
    a = groups.select(F.col("hap").alias("i"), F.col("grp").alias("__gi"))
    b = groups.select(F.col("hap").alias("j"), F.col("grp").alias("__gj"))
    rows = events.join(a, "i").join(b, "j")
    return rows.withColumns({"g1": F.least("__gi", "__gj"), "g2": F.greatest("__gi", "__gj")})


def group_rates(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Rates between and within groups, by unordered pair."""
    return _named(events, groups).groupBy("g1", "g2", "epoch").agg(F.sum("num").alias("num"), F.sum("denom").alias("denom")).withColumn("rate", ratio(F.col("num"), F.col("denom")))


def haplotype_rates(events: DataFrame) -> DataFrame:
    return events.withColumn("rate", ratio(F.col("num"), F.col("denom")))


def all_rates(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Total, by group pair and by haplotype pair in one pass: level 0, 1, 2."""
    view = _named(events, groups)
    view = view.groupingSets([[F.col("epoch")], [F.col("g1"), F.col("g2"), F.col("epoch")], [F.col("i"), F.col("j"), F.col("epoch")]], "epoch", "g1", "g2", "i", "j")
    out = view.agg(F.grouping_id().alias("__id"), F.sum("num").alias("num"), F.sum("denom").alias("denom"))
    level = F.when(F.col("g1").isNotNull(), 1).when(F.col("i").isNotNull(), 2).otherwise(0)
    return out.select(level.alias("level"), "g1", "g2", "i", "j", "epoch", "num", "denom", ratio(F.col("num"), F.col("denom")).alias("rate"))


def matrix(rates: DataFrame, keys: list[str], epochs: list[int], value: str = "rate") -> DataFrame:
    """One row for each key with a column for each epoch."""
    return rates.groupBy(*keys).pivot("epoch", epochs).agg(F.first(value))


def weighted_counts(events: DataFrame, spans: DataFrame, unit: float = 1e6, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """Coalescences of pairs per epoch, weighted by the share of a unit of bases that their tree spans."""
    return events.join(spans, keys).groupBy("epoch").agg(F.sum(F.col("span") / unit).alias("count"))


def constant_rates(epochs: DataFrame, ne: float) -> DataFrame:
    return epochs.select("epoch", F.lit(1.0 / ne).alias("rate"))


def population_size(rates: DataFrame) -> DataFrame:
    """1 over the mean rate of epochs that have one, halved for diploids, as ne."""
    return rates.where("rate > 0").agg((0.5 / F.avg("rate")).alias("ne"))


def tree_segments(heights: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(lo, hi, lineages, ends): stretches of time between successive ages of a tree; ends: coalescences at hi."""
    n = windows.lineages(heights, keys, "height", F.col("n_children") == 0)
    steps = n.groupBy(*keys, "height").agg(F.max("lineages").alias("lineages"), F.sum(F.greatest(F.col("n_children") - 1, F.lit(0))).alias("events"))
    w = Window.partitionBy(*keys).orderBy("height")
    return steps.select(*keys, F.col("height").alias("age_begin"), F.lead("height").over(w).alias("age_end"), "lineages", F.lead("events").over(w).alias("ends")).where("age_end is not null")


def tree_events(heights: DataFrame, epochs: DataFrame, spans: DataFrame, block: int = 1000, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(block, epoch, num, denom): coalescences in (lo, hi] and k(k-1)/2 lineage pairs x time, weighted by bases / 1e9.

    Blocks are runs of `block` trees of a chromosome.
    """
    w = Window.partitionBy("chrom").orderBy("tree_id")
    blocks = spans.select(*keys, "span", F.floor((F.row_number().over(w) - 1) / block).cast("int").alias("block"))
    rows = tree_segments(heights, keys).join(blocks, keys)
    k = F.col("lineages")
    # the unit divides the sums: sums of whole bases and generations are exact in whatever order they are added
    exposed = with_epochs(rows, epochs).groupBy("chrom", "block", "epoch").agg((F.sum(F.col("shared") * k * (k - 1) / 2 * F.col("span")) / 1e9).alias("denom"))
    events = rows.join(F.broadcast(epochs), (F.col("lo") < F.col("age_end")) & (F.col("age_end") <= F.col("hi")))
    events = events.groupBy("chrom", "block", "epoch").agg((F.sum(F.col("ends") * F.col("span")) / 1e9).alias("num"))
    both = exposed.join(events, ["chrom", "block", "epoch"], "full_outer")
    return both.select("chrom", "block", "epoch", F.coalesce("num", F.lit(0.0)).alias("num"), F.coalesce("denom", F.lit(0.0)).alias("denom"))


def genome_blocks(spans: DataFrame, block: int = 1000) -> DataFrame:
    """spans(chrom, tree_id, ...) with block: runs of `block` trees of a chromosome, numbered on from chromosome to chromosome."""
    w = Window.partitionBy("chrom").orderBy("tree_id")
    rows = spans.withColumn("__own", F.floor((F.row_number().over(w) - 1) / block))
    sizes = rows.groupBy("chrom").agg((F.max("__own") + 1).alias("__n"))
    # a row for each chromosome
    before = sizes.select("chrom", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(before, "chrom").withColumn("block", (F.col("__own") + F.col("__before")).cast("int")).drop("__own", "__before")


def bootstrap_weights(blocks: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, block, weight): how often each block is drawn when as many as there are are drawn with replacement.

    blocks(block): distinct numbers. Draws come from a hash of seed, replicate and draw, so that a lost task repeats them.
    Replicate 0 takes every block once.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("block")  # blocks are thousands of trees each: a short list
    numbered = blocks.select("block", (F.row_number().over(w) - 1).alias("k"))
    n = numbered.agg(F.count("*").alias("n"))
    draws = numbered.join(F.broadcast(n)).select("k", "n", F.explode(F.sequence(F.lit(1), F.lit(max(1, replicates - 1)))).alias("replicate")) if replicates > 1 else None
    first = numbered.select(F.lit(0).alias("replicate"), "block", F.lit(1).cast("long").alias("weight"))
    if draws is None:
        return first
    drawn = draws.select("replicate", F.pmod(F.xxhash64(F.lit(seed), "replicate", "k"), F.col("n")).alias("k"))
    return first.unionByName(drawn.groupBy("replicate", "k").agg(F.count("*").alias("weight")).join(numbered, "k").select("replicate", "block", "weight"))


def bootstrap_rates(events: DataFrame, weights: DataFrame, keys: list[str] = ["epoch"], block: str = "block") -> DataFrame:  # noqa: B006
    """Rates of each replicate: weighted sums of its blocks."""
    rows = events.join(weights, block)
    out = rows.groupBy("replicate", *keys).agg(F.sum(F.col("num") * F.col("weight")).alias("num"), F.sum(F.col("denom") * F.col("weight")).alias("denom"))
    return out.withColumn("rate", ratio(F.col("num"), F.col("denom")))


def covered_trees(ranges: DataFrame, passing: DataFrame, bucket: float, least: float = 0.9, by: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """(by, tree_id, coverage) of trees whose range [lo, hi) lies in passing runs [lo, hi) to `least` of its length."""
    from treeloom.operators.intervals import interval_join

    both = interval_join(ranges.select(*by, "tree_id", "lo", "hi"), passing.select(*by, "lo", "hi"), bucket, by)
    shared = both.groupBy(*by, "tree_id").agg(F.sum(F.least("hi", "hi_r") - F.greatest("lo", "lo_r")).alias("covered"))
    out = ranges.join(shared, [*by, "tree_id"]).select(*by, "tree_id", (F.col("covered") / (F.col("hi") - F.col("lo"))).alias("coverage"))
    return out.where(F.col("coverage") >= least)
