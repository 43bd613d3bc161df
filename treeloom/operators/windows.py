"""Ordered-neighbour operators along a chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.intervals import WIDTH

#: Least genetic step between neighbours, and the scale of recombination rates.
LEAST_STEP, RATE_SCALE = 1e-10, 2500.0


def _along(by: list[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order)


def distances(sites: DataFrame, by: list[str], pos: str = "pos", *ties: str, width: int = WIDTH) -> DataFrame:
    """sites with dist: bases to the next site, 1 for the last. Stretches of width bases are sorted each by itself."""
    rows = sites.withColumn("__stretch", F.floor(F.col(pos) / width).cast("long"))
    w = Window.partitionBy(*by).orderBy("__stretch")
    after = rows.groupBy(*by, "__stretch").agg(F.min(pos).alias("__first")).select(*by, "__stretch", F.lead("__first").over(w).alias("__after"))
    nxt = F.lead(pos).over(_along([*by, "__stretch"], pos, *ties))
    rows = rows.withColumn("__next", nxt).join(after, [*by, "__stretch"])
    return rows.withColumn("dist", F.coalesce(F.coalesce("__next", "__after") - F.col(pos), F.lit(1))).select(*sites.columns, "dist")


def check_rising(sites: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """sites, or an error at run time where the next position isn't larger."""
    nxt = F.lead(pos).over(_along(by, pos))
    return sites.withColumn("__ok", F.when(nxt.isNotNull() & (nxt <= F.col(pos)), F.raise_error(F.concat(F.lit("positions don't rise at "), F.col(pos).cast("string"))).cast("int"))).where("__ok is null").drop("__ok")


def recombination(sites: DataFrame, by: list[str], pos: str = "pos", rpos: str = "rpos") -> DataFrame:
    """sites with r: genetic steps to the next site, LEAST_STEP at least, scaled; the last has the least."""
    step = F.lead(rpos).over(_along(by, pos)) - F.col(rpos)
    return sites.withColumn("r", F.greatest(F.coalesce(step, F.lit(0.0)), F.lit(LEAST_STEP)) * RATE_SCALE)


def tree_spans(muts: DataFrame, by: list[str], tree: str = "tree_id", pos: str = "pos", *ties: str) -> DataFrame:
    """(by, tree, span): half the distance before its first site, all after its sites, less half of the last."""
    before = F.lag("dist").over(_along(by, pos, *ties))
    rows = muts.withColumn("__before", F.coalesce(before, F.lit(0)))
    place = F.struct(pos, *ties)
    return rows.groupBy(*by, tree).agg((0.5 * F.min_by("__before", place) + F.sum("dist") - 0.5 * F.max_by("dist", place)).alias("span"))


def site_spans(muts: DataFrame, by: list[str], pos: str = "pos", *ties: str) -> DataFrame:
    """muts with span: half the distances before and after."""
    return muts.withColumn("span", (F.coalesce(F.lag("dist").over(_along(by, pos, *ties)), F.lit(0)) + F.col("dist")) / 2)


def neighbourhood(rows: DataFrame, by: list[str], value: Column, name: str, before: int, after: int, *order: str) -> DataFrame:
    """rows with the sum of value over the rows before and after, ends cut off."""
    return rows.withColumn(name, F.sum(value).over(_along(by, *order).rowsBetween(-before, after)))


def unmapped_nearby(muts: DataFrame, by: list[str], unmapped: Column, reach: int = 500, *order: str) -> DataFrame:
    """muts with n_unmapped: sites that don't map among the reach sites to either side.

    Within the chromosome the frame is (reach - 1 before, reach after); near an end it is the 2 * reach sites there.
    """
    w = _along(by, *order)
    k, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    run = F.sum(unmapped.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = muts.withColumns({"__k": k, "__n": n, "__run": run})
    last = F.least(F.greatest(F.col("__k") + reach, F.lit(2 * reach)), F.col("__n"))
    first = F.greatest(last - 2 * reach, F.lit(0))
    ends = rows.select(*by, F.col("__k").alias("__at"), F.col("__run").alias("__sum"))
    rows = rows.withColumns({"__last": last, "__first": first})
    rows = rows.join(ends.withColumnsRenamed({"__at": "__last", "__sum": "__hi"}), [*by, "__last"])
    rows = rows.join(ends.withColumnsRenamed({"__at": "__first", "__sum": "__lo"}), [*by, "__first"], "left")
    return rows.withColumn("n_unmapped", F.col("__hi") - F.coalesce("__lo", F.lit(0))).drop("__k", "__n", "__run", "__last", "__first", "__hi", "__lo")


def lineages(nodes: DataFrame, by: list[str], age: str = "height", tip: Column | None = None) -> DataFrame:
    """nodes with lineages: branches that cross just above each age; tips add one, a coalescence of c branches takes c - 1.

    Nodes of one age share a value.
    """
    delta = F.when(tip, 1).otherwise(1 - F.col("n_children"))
    w = Window.partitionBy(*by).orderBy(age).rangeBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("lineages", F.sum(delta).over(w))


def carried_rates(rates: DataFrame, by: list[str], epoch: str = "epoch", rate: str = "rate") -> DataFrame:
    """rates with zero and missing values taken from the last epoch that has one, else from the next, else 1."""
    known = F.when(F.col(rate) > 0, F.col(rate))
    back = F.last(known, ignorenulls=True).over(_along(by, epoch).rowsBetween(Window.unboundedPreceding, 0))
    on = F.last(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(epoch)).rowsBetween(Window.unboundedPreceding, 0))
    return rates.withColumn(rate, F.coalesce(back, on, F.lit(1.0)))


def forced_breaks(sites: DataFrame, by: list[str], width: int, pos: str = "pos") -> DataFrame:
    """sites with breaks: whether a multiple of width lies between it and the next site."""
    nxt = F.lead(pos).over(_along(by, pos))
    return sites.withColumn("breaks", F.coalesce(F.floor(nxt / width) - F.floor(F.col(pos) / width) >= 1, F.lit(False)))


def budget_windows(sites: DataFrame, by: list[str], cost: Column, budget: float, *order: str) -> DataFrame:
    """sites with window: a running cost cut at multiples of the budget."""
    return sites.withColumn("window", F.floor(F.sum(cost).over(_along(by, *order).rowsBetween(Window.unboundedPreceding, 0)) / budget).cast("int"))


def chunks(sites: DataFrame, size: int, overlap: int, last: int, snp: str = "snp_id") -> DataFrame:
    """sites once for each chunk that holds them, with core: whether the chunk's result counts there.

    Chunks of size sites start every size - overlap sites, up to the one that holds the last; half of an overlap is
    trimmed from either side, so that every site is core in one chunk.
    """
    step = size - overlap
    end = max(0, -(-(last + 1 - size) // step))
    k = F.col(snp)
    first = F.greatest(F.lit(0), F.floor((k - size) / step).cast("int") + 1)
    rows = sites.withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, F.least(F.floor(k / step).cast("int"), F.lit(end))))))
    at = k - F.col("chunk") * step
    trimmed = F.when(F.col("chunk") < end, size - (overlap - overlap // 2)).otherwise(size)
    inner = (at >= F.when(F.col("chunk") == 0, 0).otherwise(overlap // 2)) & (at < trimmed)
    return rows.withColumn("core", inner)


def tree_runs(muts: DataFrame, by: list[str], tree: str = "tree_id", *order: str) -> DataFrame:
    """Runs of sites with one tree: (by, run, tree, n, first, last)."""
    w = _along(by, *order)
    new = F.coalesce(F.lag(tree).over(w) != F.col(tree), F.lit(True)).cast("int")
    rows = muts.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "run").agg(F.first(tree).alias(tree), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
