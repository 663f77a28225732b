"""Cleaning of seasonal series, on long rows by windows or on arrays.

All window expressions of a series share one specification, so one shuffle on the series key serves the
quantile, the median and the scaling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINTER = (300, 60)
QUANTILE, SCALE_QUANTILES = 0.025, (0.025, 0.995)


def in_winter(doy: Column, start: int = WINTER[0], end: int = WINTER[1]) -> Column:
    """A range of days of the year that may run over the year's end."""
    return doy.between(start, end) if start <= end else (doy >= start) | (doy <= end)


def baseline(value: Column, keys: Sequence[str], q: float = QUANTILE) -> Column:
    """Exact quantile of a series with linear interpolation; nulls do not count."""
    return F.percentile(value, F.lit(q)).over(Window.partitionBy(*keys))


def filled(value: Column, base: Column, doy: Column | None = None, fill: str = "all", winter: tuple[int, int] = WINTER) -> Column:
    """``all``: every null becomes the baseline; ``winter``: those in the winter window; ``none``."""
    if fill == "all":
        return F.coalesce(value, base)
    if fill == "winter":
        return F.when(value.isNull() & in_winter(doy, *winter), base).otherwise(value)
    if fill == "none":
        return value
    raise ValueError("fill is all, winter or none")


def raised(value: Column, base: Column) -> Column:
    """Values below the baseline become the baseline; nulls stay."""
    return F.when(value < base, base).otherwise(value)


def moving_median(value: Column, keys: Sequence[str], order: Sequence[Column | str], size: int = 3) -> Column:
    """Median of ``size`` neighbours by position; the ends repeat their samples in reverse.

    Nulls sort last within a window; a null median stays null.
    """
    if size % 2 == 0 or size < 1:
        raise ValueError("size is odd")
    w, half = Window.partitionBy(*keys).orderBy(*order), size // 2
    nan = F.lit(float("nan"))
    sample = F.coalesce(value, nan)
    if size == 3:
        parts = [F.coalesce(F.lag(sample).over(w), sample), sample, F.coalesce(F.lead(sample).over(w), sample)]
        median = F.sort_array(F.array(*parts))[1]
    else:
        around = F.collect_list(sample).over(w.rowsBetween(-half, half))
        at, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
        head = F.reverse(F.slice(around, F.lit(1), F.greatest(half + 1 - at, F.lit(0))))
        short = F.greatest(at + half - n, F.lit(0))
        tail = F.reverse(F.slice(around, F.size(around) - short + 1, short))
        median = F.sort_array(F.concat(head, around, tail))[half]
    return F.nanvl(median, F.lit(None).cast("double"))


def scaled(value: Column, keys: Sequence[str], quantiles: tuple[float, float] = SCALE_QUANTILES) -> Column:
    """From the lower to the upper quantile onto 0 to 1, not clipped; 0 throughout if they coincide."""
    w = Window.partitionBy(*keys)
    low, high = (F.percentile(value, F.lit(q)).over(w) for q in quantiles)
    return F.when(F.abs(high - low) <= 1e-8, 0.0 * value).otherwise((value - low) / (high - low))


def process(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, value: str = "ndvi", doy: str = "doy", fill: str = "none", clip: bool = True,
    median_size: int = 3, scale: bool = False, q: float = QUANTILE, quantiles: tuple[float, float] = SCALE_QUANTILES, winter: tuple[int, int] = WINTER,
) -> DataFrame:
    """Adds ``winter_ndvi``, ``corrected``, ``filtered`` and, if asked, ``scaled`` to long rows.

    A series without any value has a null baseline and null throughout. What is still null after the fill
    becomes the baseline before the median.
    """
    base = F.col("winter_ndvi")
    corrected = filled(F.col(value).cast("double"), base, F.col(doy), fill, winter)
    out = df.withColumn("winter_ndvi", baseline(F.col(value).cast("double"), keys, q)).withColumn("corrected", raised(corrected, base) if clip else corrected)
    out = out.withColumn("filtered", moving_median(F.coalesce("corrected", base), keys, order, median_size))
    return out.withColumn("scaled", scaled(F.col("filtered"), keys, quantiles)) if scale else out


def region_cleaned(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, value: str = "ndvi", doy: str = "doy") -> DataFrame:
    """Cleaning before the regional fit: raise to the baseline, fill winter gaps alone, median with gaps last."""
    out = df.withColumn("winter_ndvi", baseline(F.col(value).cast("double"), keys))
    step = filled(raised(F.col(value).cast("double"), F.col("winter_ndvi")), F.col("winter_ndvi"), F.col(doy), "winter")
    return out.withColumn("corrected", step).withColumn("filtered", moving_median(F.col("corrected"), keys, order))


def to_arrays(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per series with ``obs``, its samples in the order of ``fields``: one shuffle, then all is narrow."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("obs"))


def array_baseline(values: Column, q: float = QUANTILE) -> Column:
    """``baseline`` on an array."""
    v = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    place = (F.size(v) - 1) * F.lit(q)
    low, high = (F.try_element_at(v, f(place).cast("int") + 1) for f in (F.floor, F.ceil))
    return low + (high - low) * (place - F.floor(place))


def array_median3(values: Column) -> Column:
    """``moving_median`` of size 3 on an array without nulls."""
    n = F.size(values)

    def at(i: Column) -> Column:
        return F.element_at(values, F.least(F.greatest(i, F.lit(1)), n))

    inner = F.transform(F.sequence(F.lit(1), n), lambda i: F.sort_array(F.array(at(i - 1), at(i), at(i + 1)))[1])
    return F.when(n > 0, inner).otherwise(values)


def recentred(doy: Column, peak: Column, centre: int = 183) -> Column:
    """Day of the year counted so that the peak falls on ``centre``; ``restored`` undoes it."""
    return F.pmod(doy - peak + centre, F.lit(365))


def restored(doy: Column, peak: Column, centre: int = 183) -> Column:
    return F.pmod(doy + peak - centre, F.lit(365))


def year_table(df: DataFrame, years: Sequence[int], *, value: str = "ndvi", order: str = "seq") -> DataFrame:
    """One row per day of the year and a column per year; of several values of a day the last in order."""
    last = F.max_by(value, order)
    return df.where(F.col(value).isNotNull() & F.col("year").isin(*years)).groupBy("doy").pivot("year", list(years)).agg(last)
