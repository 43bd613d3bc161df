"""Epoch grids: boundaries of time in generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def default_epochs(years_per_gen: float = 28.0, count: int = 31) -> list[float]:
    """0, a thousand years, then even steps of the exponent up to ten million, then a hundred million years."""
    steps = [10 ** (3 + 4 * (e - 1) / (count - 3)) / years_per_gen for e in range(2, count - 1)]
    return [0.0, 1e3 / years_per_gen, *steps, 1e8 / years_per_gen]


def binned_epochs(bins: str | tuple[float, float, float], years_per_gen: float = 28.0) -> list[float]:
    """Boundaries from "lower,upper,step", exponents of ten in years: 0, the steps below upper, upper, and a last one far off."""
    lower, upper, step = map(float, bins.split(",")) if isinstance(bins, str) else bins
    if step <= 0 or upper < lower:
        raise ValueError(f"bins must rise: {bins}")
    out, x, k = [0.0], lower, 0
    while x < upper - 1e-12:
        out.append(10**x / years_per_gen)
        k += 1
        x = lower + k * step
    out.append(10**upper / years_per_gen)
    out.append(max(1e8, 10 * out[-1]) / years_per_gen)
    return out


def epochs(spark: SparkSession, bounds: list[float], last: float = float("inf")) -> DataFrame:
    """(epoch, lo, hi); the last epoch is open. A handful of rows, which joins may broadcast."""
    rows = [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(bounds, [*bounds[1:], last], strict=True))]
    return spark.createDataFrame(rows, "epoch int, lo double, hi double")


def refined(bounds: list[float], ages: list[float]) -> list[float]:
    """Boundaries with the distinct sample ages among them, so that no epoch holds an age inside."""
    return sorted({*bounds, *(float(a) for a in ages if a > 0)})
