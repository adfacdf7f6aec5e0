"""Numeric column expressions: casts, rounding, bins, cells, ratios, ramps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log axis: 10 kHz to 300 GHz, 24 bins per decade.
AXIS_LOW = 1e4
AXIS_HIGH = 3e11
BINS_PER_DECADE = 24


def number(x: Column) -> Column:
    """A double, or NULL when the text is blank, not a number, NaN or infinite."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def is_missing(x: Column) -> Column:
    return number(x).isNull()


def half_up(x: Column, places: int = 0) -> Column:
    """Round half towards +infinity, as floor(x * 10^n + 1/2) / 10^n."""
    scale = float(10 ** places)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def log_bin(x: Column, low: float = AXIS_LOW, high: float = AXIS_HIGH,
            per_decade: int = BINS_PER_DECADE) -> Column:
    """Index of the constant-ratio bin of ``x``; -1 outside [low, high) or when missing."""
    index = F.floor(F.log10(x / F.lit(low)) * F.lit(per_decade)).cast("int")
    return F.when((x >= low) & (x < high), index).otherwise(F.lit(-1))


def log_bin_count(low: float = AXIS_LOW, high: float = AXIS_HIGH,
                  per_decade: int = BINS_PER_DECADE) -> int:
    return math.ceil(math.log10(high / low) * per_decade)


def log_bin_edge(index: Column, low: float = AXIS_LOW, per_decade: int = BINS_PER_DECADE) -> Column:
    """Lower edge of bin ``index``; the upper edge is the lower edge of the next bin."""
    return F.lit(low) * F.pow(F.lit(10.0), index / F.lit(per_decade))


def rounded_cell(x: Column, per_unit: int = 10) -> Column:
    """Grid coordinate of ``x`` on a grid whose cells are centred on multiples of 1/per_unit."""
    return F.floor(x * per_unit + 0.5).cast("long")


def floor_cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def width(lo: Column, hi: Column, lo2: Column | None = None, hi2: Column | None = None,
          unit: float = 1e6) -> Column:
    """Width of an interval, plus that of an optional second one, in ``unit``."""
    first = (hi - lo) / F.lit(unit)
    if lo2 is None or hi2 is None:
        return first
    return first + F.coalesce((hi2 - lo2) / F.lit(unit), F.lit(0.0))


def ratio(n: Column, of: Column) -> Column:
    """n / of, NULL when ``of`` is zero or missing."""
    return F.try_divide(n.cast("double"), of.cast("double"))


def ratio_floor_one(n: Column, of: Column) -> Column:
    """n / max(1, of): never divides by zero and never inflates an empty denominator."""
    return n.cast("double") / F.greatest(F.lit(1.0), of.cast("double"))


def log_position(x: Column, low: float = AXIS_LOW, high: float = AXIS_HIGH) -> Column:
    """Position of ``x`` on a log axis, 0 at ``low`` and 1 at ``high``."""
    return (F.log10(x) - math.log10(low)) / F.lit(math.log10(high) - math.log10(low))


def log_share(x: Column, ceiling: Column) -> Column:
    """log10(1 + x) as a share of log10(1 + ceiling)."""
    return F.try_divide(F.log10(1 + x), F.log10(1 + ceiling))


def ramp_bucket(t: Column, steps: int = 8) -> Column:
    """Quantise 0..1 into ``steps`` buckets by rounding, clamped at both ends."""
    return F.least(F.lit(steps - 1), F.greatest(F.lit(0), half_up(t * (steps - 1)).cast("int")))


def ramp_breakpoint(bucket: Column, ceiling: Column, steps: int = 8) -> Column:
    """The value at which ``log_share`` reaches ``bucket``: the inverse of the ramp."""
    return F.pow(1 + ceiling, bucket / F.lit(float(steps - 1))) - 1
