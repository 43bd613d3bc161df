"""Joins on positions and ranges without nested loops: buckets, unions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a chromosome that are sorted together.
WIDTH = 1 << 20


def interval_join(left: DataFrame, right: DataFrame, bucket: float, by: list[str] | None = None, l: tuple[str, str] = ("lo", "hi"), r: tuple[str, str] = ("lo", "hi"), how: str = "inner") -> DataFrame:  # noqa: E741
    """Rows of left and right whose half-open ranges overlap, each pair once.

    Both sides are dealt to the buckets they touch and joined on them by equality. A pair that shares several buckets
    is taken in the one in which the later of both starts lies. Right columns named like left ones get the suffix _r.
    """
    by = by or []
    right = right.select(*by, *[F.col(c).alias(f"{c}_r" if c in left.columns and c not in by else c) for c in right.columns if c not in by])
    r = tuple(f"{c}_r" if c in left.columns else c for c in r)

    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        first, last = F.floor(F.col(lo) / bucket), F.ceil(F.col(hi) / bucket) - 1
        return df.where(F.col(lo) < F.col(hi)).withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, last))))

    both = dealt(left, *l).join(dealt(right, *r), [*by, "__bucket"])
    start = F.greatest(F.col(l[0]), F.col(r[0]))
    out = both.where((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.floor(start / bucket) == F.col("__bucket")))
    return out.drop("__bucket")


def overlap(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    """Length that two ranges share."""
    return F.greatest(F.lit(0.0), F.least(hi, b) - F.greatest(lo, a))


def with_epochs(rows: DataFrame, epochs: DataFrame, begin: str = "age_begin", end: str = "age_end") -> DataFrame:
    """rows x the epochs that [begin, end] overlaps, with the length shared. epochs is a bounded grid, so it is broadcast."""
    b, e = F.col(begin), F.col(end)
    return rows.join(F.broadcast(epochs), (F.col("lo") < e) & (F.col("hi") > b)).withColumn("shared", overlap(F.col("lo"), F.col("hi"), b, e))


def at_epoch(rows: DataFrame, epochs: DataFrame, time: str) -> DataFrame:
    """rows with the epoch [lo, hi) that holds time."""
    return rows.join(F.broadcast(epochs), (F.col("lo") <= F.col(time)) & (F.col(time) < F.col("hi")))


def _merged(left: DataFrame, right: DataFrame, by: list[str], lpos: str, rpos: str, values: list[str]) -> DataFrame:
    a = left.select(*by, F.col(lpos).alias("__pos"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__value"))
    b = right.select(*by, F.col(rpos).alias("__pos"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.struct(F.col(rpos).alias("at"), *values).alias("__value"))
    return a.unionByName(b)


def as_of(left: DataFrame, right: DataFrame, by: list[str], lpos: str, rpos: str, values: list[str], forward: bool = False, width: int = WIDTH) -> DataFrame:
    """left with values and `at` of the nearest row of right at or before lpos (at or after it, if forward); null if none.

    Stretches of width positions are sorted each by itself; what one hands on to the next is one row of a small table.
    Of rows at one position the last by the order of their values counts (the first, if forward).
    """
    rows = _stretched(_merged(left, right, by, lpos, rpos, values), width)
    return _carried(rows, by, forward, forward, "__near").where("__side = 1").select("__row.*", "__near.*")


def _stretched(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("__stretch", F.floor(F.col("__pos") / width).cast("long"))


def _carried(rows: DataFrame, by: list[str], forward: bool, equal_after: bool, name: str) -> DataFrame:
    """rows with the last value at or before each row, or the first at or after it, as name.

    equal_after: a value at a row's own position comes after the row. Read from the end if forward, so that frames only
    grow. A stretch without a value before the row takes the last one of the stretches before.
    """
    order = [F.col("__pos"), F.expr("-__side" if equal_after else "__side"), F.col("__value")]
    order = [c.desc() for c in order] if forward else order
    own = F.last("__value", ignorenulls=True).over(Window.partitionBy(*by, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    edge = F.when(F.col("__side") == 0, F.struct("__pos", "__value"))
    edges = rows.groupBy(*by, "__stretch").agg((F.min(edge) if forward else F.max(edge))["__value"].alias("__edge"))
    along = Window.partitionBy(*by).orderBy(F.col("__stretch").desc() if forward else F.col("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*by, "__stretch", F.last("__edge", ignorenulls=True).over(along).alias("__before"))
    return rows.withColumn(name, own).join(edges, [*by, "__stretch"]).withColumn(name, F.coalesce(name, "__before")).drop("__before")


def interpolate(sites: DataFrame, genmap: DataFrame, by: list[str], pos: str = "pos", bp: str = "bp", cm: str = "cm", width: int = WIDTH) -> DataFrame:
    """sites with rpos: genetic position in Morgans, linear between the map's points; constant before the first and after the last."""
    rows = _stretched(_merged(sites, genmap, by, pos, bp, [cm]), width)
    rows = _carried(_carried(rows, by, False, False, "__b"), by, True, False, "__a").where("__side = 1")
    x, x0, x1, y0, y1 = F.col("__pos"), F.col("__b.at"), F.col("__a.at"), F.col(f"__b.{cm}"), F.col(f"__a.{cm}")
    value = F.when(x0.isNull(), y1).when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return rows.select("__row.*", (value * 0.01).alias("rpos"))


def nearest_ranges(sites: DataFrame, by: list[str], pos: str = "pos", first: float | None = None, last: float | None = None) -> DataFrame:
    """sites with [lo, hi): what lies nearer to it than to its neighbours; open ends are cut at first and last, or at the site."""
    w = Window.partitionBy(*by).orderBy(pos)
    p = F.col(pos)
    lo = F.coalesce((F.lag(pos).over(w) + p) / 2, F.lit(first), p.cast("double"))
    hi = F.coalesce((F.lead(pos).over(w) + p) / 2, F.lit(last), p.cast("double"))
    return sites.withColumns({"lo": lo, "hi": hi})


def runs(bases: DataFrame, by: list[str], pos: str = "p", value: str = "ok") -> DataFrame:
    """Runs of equal values at successive positions: (by, lo, hi, value), half open."""
    w = Window.partitionBy(*by).orderBy(pos)
    new = (F.lag(value).over(w) != F.col(value)) | (F.lag(pos).over(w) != F.col(pos) - 1)
    marked = bases.withColumn("__run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return marked.groupBy(*by, "__run").agg(F.min(pos).alias("lo"), (F.max(pos) + 1).alias("hi"), F.first(value).alias(value)).drop("__run")
