"""Column functions: decibels with floors, power means, percentiles, frames of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12
SILENT_LUFS = -70.0


def db(ratio: Column, floor: float = FLOOR) -> Column:
    """20 log10 of an amplitude, floored."""
    return 20.0 * F.log10(F.greatest(ratio, F.lit(floor)))


def power_db(power: Column, floor: float = FLOOR) -> Column:
    return 10.0 * F.log10(F.greatest(power, F.lit(floor)))


def lufs(mean_square: Column) -> Column:
    """Loudness of a mean square; silence is -70."""
    return F.when(mean_square > 0, -0.691 + 10.0 * F.log10(mean_square)).otherwise(F.lit(SILENT_LUFS))


def power_mean(level: Column) -> Column:
    """Aggregate: mean of levels in the power domain."""
    return 10.0 * F.log10(F.avg(F.pow(F.lit(10.0), level / 10.0)))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def by_channel(*more: str) -> "Window":
    return Window.partitionBy("channel").orderBy(*(more or ("frame",)))


def round4(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Doubles as they are reported: rounded, so that the order of summation doesn't show."""
    return df.withColumns({n: F.round(n, digits) for n in names})
