"""Mutation rates through time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import alleles
from treeloom.operators.intervals import overlap, with_epochs
from treeloom.operators.rates import tree_segments


def mapped(muts: DataFrame) -> DataFrame:
    """Mutations on exactly one branch."""
    return muts.where("n_branches = 1")


def fractions(muts: DataFrame, epochs: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, epoch, mut): each mutation counts one in all, dealt to epochs by the share of its branch's time in them."""
    rows = with_epochs(muts.where("age_end > age_begin"), epochs)
    return rows.groupBy(*keys, "epoch").agg(F.sum(F.col("shared") / (F.col("age_end") - F.col("age_begin"))).alias("mut"))


def branch_time(heights: DataFrame, epochs: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(keys, epoch, time): lineages x time of each tree in each epoch."""
    return with_epochs(tree_segments(heights, keys), epochs).groupBy(*keys, "epoch").agg(F.sum(F.col("shared") * F.col("lineages")).alias("time"))


def opportunities(time: DataFrame, spans: DataFrame, keys: list[str] = ["chrom", "tree_id"], more: list[str] = []) -> DataFrame:  # noqa: B006
    """(more, epoch, opp): branch time x bases of a tree's span, over trees."""
    return time.join(spans, keys).groupBy(*more, "epoch").agg(F.sum(F.col("time") * F.col("span")).alias("opp"))


def rates(mut: DataFrame, opp: DataFrame, keys: list[str] = ["epoch"]) -> DataFrame:  # noqa: B006
    """mut / opp, null without opportunity."""
    both = mut.join(opp, keys, "full_outer").select(*keys, F.coalesce("mut", F.lit(0.0)).alias("mut"), F.coalesce("opp", F.lit(0.0)).alias("opp"))
    return both.withColumn("rate", F.col("mut") / F.nullif(F.col("opp"), F.lit(0.0)))


def average_rate(muts: DataFrame, heights: DataFrame, spans: DataFrame, epochs: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """Mutations per base and generation in each epoch, of mutations on one branch."""
    return rates(fractions(mapped(muts), epochs), opportunities(branch_time(heights, epochs, keys), spans, keys))


def with_context(muts: DataFrame) -> DataFrame:
    """Well-defined mutations with category, the context of 96."""
    kept = muts.where(alleles.well_defined(F.col("anc"), F.col("der"), F.col("upstream"), F.col("downstream")))
    return kept.withColumn("category", alleles.context(F.col("anc"), F.col("der"), F.col("upstream"), F.col("downstream")))


def patterns(table: DataFrame) -> DataFrame:
    """Categories (up, down, anc, der, category) with those of the other strand beside them; a pattern counts once."""
    other = table.select(alleles.complement(F.col("down")).alias("up"), alleles.complement(F.col("up")).alias("down"), alleles.complement(F.col("anc")).alias("anc"), alleles.complement(F.col("der")).alias("der"), "category")
    return table.select("up", "down", "anc", "der", "category").unionByName(other).distinct()


def checked_categories(table: DataFrame) -> DataFrame:
    """table, or an error unless 96 contexts have categories 0, 1, ... without a gap."""
    all_ = table.select(alleles.context(F.col("anc"), F.col("der"), F.col("up"), F.col("down")).alias("c"), "category")
    r = all_.agg(F.countDistinct("c").alias("n"), F.min("category").alias("lo"), F.max("category").alias("hi"), F.countDistinct("category").alias("k")).first()
    if r["n"] != 96 or r["lo"] != 0 or r["hi"] != r["k"] - 1:
        raise ValueError("categories must cover 96 contexts with numbers from 0 without a gap")
    return table


def categorised(muts: DataFrame, table: DataFrame) -> DataFrame:
    """muts with the category of their pattern; the table is a fixed list of at most 192 rows."""
    p = patterns(table).withColumnsRenamed({"up": "upstream", "down": "downstream", "anc": "anc", "der": "der"})
    return muts.join(F.broadcast(p), ["upstream", "downstream", "anc", "der"])


def category_rates(muts: DataFrame, bases: DataFrame, time: DataFrame, epochs: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(category, epoch, mut, opp, rate). bases(keys, category, n): bases of each tree at which such a change can happen."""
    mut = fractions(mapped(muts), epochs, ["category"])
    opp = time.join(bases, keys).groupBy("category", "epoch").agg(F.sum(F.col("time") * F.col("n")).alias("opp"))
    return rates(mut, opp, ["category", "epoch"])


def bases_by_type(sites: DataFrame, bases: DataFrame, bucket: float, by: list[str] = ["chrom"], keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(by, keys, kind, n): bases nearest to the sites of each tree. bases(by, p, kind) passes the mask; sites have lo, hi."""
    from treeloom.operators.intervals import interval_join

    points = bases.select(*by, F.col("p").cast("double").alias("at"), (F.col("p") + 0.5).alias("upto"), "kind")
    return interval_join(sites.select(*by, *keys, "lo", "hi"), points, bucket, by, r=("at", "upto")).where("at >= lo").groupBy(*by, *keys, "kind").agg(F.count("*").alias("n"))


def mean_rate(rates_: DataFrame) -> DataFrame:
    """Three times all mutations over all opportunities: each base can change in three ways."""
    return rates_.groupBy("epoch").agg((3 * F.sum("mut") / F.nullif(F.sum("opp"), F.lit(0.0))).alias("rate"))


def rate_matrix(rates_: DataFrame, value: str = "rate", categories: int = 96) -> DataFrame:
    return rates_.groupBy("epoch").pivot("category", list(range(categories))).agg(F.first(value))


def segregating_in(muts: DataFrame, clades: DataFrame, haps: list[int], keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """Mutations above two tips or more, one of them at least among haps. clades(keys, node, tips)."""
    own = clades.select(*keys, F.col("node").alias("branch"), "tips").where((F.size("tips") > 1) & F.arrays_overlap("tips", F.array(*map(F.lit, haps))))
    return muts.join(own.drop("tips"), [*keys, "branch"], "left_semi")


def group_lineages(heights: DataFrame, clades: DataFrame, haps: list[int], excluded: list[int] = [], keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(age, lineages) of a group: all branches less its tips' own ones and those of tips of excluded groups only."""
    a, out = F.array(*map(F.lit, haps)), F.array(*map(F.lit, excluded)).cast("array<int>")
    rows = heights.join(clades, [*keys, "node"])
    top = rows.select(*keys, F.col("node").alias("parent"), F.col("height").alias("age_end"))
    branches = rows.where("parent >= 0").join(top, [*keys, "parent"])
    counted = branches.where(F.arrays_overlap("tips", a) & (F.size("tips") > 1) & (F.size(F.array_except("tips", out)) > 0))
    steps = counted.select(*keys, F.col("height").alias("age"), F.lit(1).alias("d")).unionByName(counted.select(*keys, F.col("age_end").alias("age"), F.lit(-1).alias("d")))
    w = Window.partitionBy(*keys).orderBy("age")
    return steps.groupBy(*keys, "age").agg(F.sum("d").alias("d")).select(*keys, "age", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lineages"))


def group_time(lineages: DataFrame, epochs: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(keys, epoch, time): lineages of a group x time in each epoch. lineages(keys, age, lineages) as group_lineages has them."""
    w = Window.partitionBy(*keys).orderBy("age")
    rows = lineages.select(*keys, F.col("age").alias("age_begin"), F.lead("age").over(w).alias("age_end"), "lineages").where("age_end is not null and lineages > 0")
    return with_epochs(rows, epochs).groupBy(*keys, "epoch").agg(F.sum(F.col("shared") * F.col("lineages")).alias("time"))


def category_blocks(muts: DataFrame, bases: DataFrame, time: DataFrame, blocks: DataFrame, epochs: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(block, category, epoch, num, denom): mutations and opportunities of each block of trees, partial sums that add up.

    muts carry a category; bases(keys, category, n); time(keys, epoch, time) of all lineages or of a group's; blocks(keys,
    block). Trees are summed to blocks before categories meet, so a block costs categories x epochs rows.
    """
    mut = fractions(mapped(muts).join(blocks.select(*keys, "block"), keys), epochs, ["block", "category"])
    opp = time.join(bases, keys).join(blocks.select(*keys, "block"), keys).groupBy("block", "category", "epoch").agg(F.sum(F.col("time") * F.col("n")).alias("opp"))
    both = mut.join(opp, ["block", "category", "epoch"], "full_outer")
    return both.select("block", "category", "epoch", F.coalesce("mut", F.lit(0.0)).alias("num"), F.coalesce("opp", F.lit(0.0)).alias("denom"))


def tip_density(muts: DataFrame, path: DataFrame, epochs: DataFrame, spans: DataFrame, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(keys, epoch, mut, opp) along the path from one tip to the root. path(keys, node, age_begin, age_end)."""
    on = muts.join(path.select(*keys, F.col("node").alias("branch")), [*keys, "branch"], "left_semi")
    mut = fractions(mapped(on), epochs, keys)
    opp = with_epochs(path.where("age_end > age_begin"), epochs).join(spans, keys).groupBy(*keys, "epoch").agg(F.sum(F.col("shared") * F.col("span")).alias("opp"))
    return rates(mut, opp, [*keys, "epoch"])


def expected_and_observed(branches: DataFrame, muts: DataFrame, spans: DataFrame, epochs: DataFrame, mu: float, keys: list[str] = ["tree_id"]) -> DataFrame:  # noqa: B006
    """(keys, epoch, expected, observed) mutations of each tree. branches(keys, node, age_begin, age_end)."""
    seen = fractions(mapped(muts), epochs, keys).withColumnRenamed("mut", "observed")
    want = with_epochs(branches.where("age_end > age_begin"), epochs).join(spans, keys).groupBy(*keys, "epoch").agg(F.sum(F.col("shared") * F.col("span") * mu).alias("expected"))
    return want.join(seen, [*keys, "epoch"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))


def shared_time(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    return overlap(lo, hi, a, b)
