"""Day-of-year climatology, anomalies, heat spells and the excess-heat factor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.functions.base import at_least
from heatgrid.functions.calendar import leap_folded_doy
from heatgrid.functions.scaling import percentile_rank
from heatgrid.params import CLIMATOLOGY_HALF_WINDOW, CLIMATOLOGY_PERCENTILES, CLIMATOLOGY_VALUES

DAYS = 365


def _array_percentile(values: Column, pct: float) -> Column:
    """Linear-interpolated percentile of a sorted array without NULLs."""
    n = F.size(values)
    pos = F.lit(pct / 100.0) * (n - 1)
    low, high = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, high + 1)
    return F.when(n > 0, a + (pos - low) * (b - a))


def _circular(per_doy: DataFrame, half_window: int) -> DataFrame:
    """Repeat the ends of the year so that a plain window wraps around it."""
    doy = F.col("doy")
    shifts = F.array_compact(
        F.array(doy, F.when(doy <= half_window, doy + DAYS), F.when(doy > DAYS - half_window, doy - DAYS))
    )
    return per_doy.withColumn("_at", F.explode(shifts))


def _all_days(per_doy: DataFrame) -> DataFrame:
    """Add the days of year a cell has no record for.

    A cell has at most 365 rows here. They are gathered per cell and unfolded
    with the absent days, so the record is read once and the rows are already
    placed by cell for the windows that follow.
    """
    fields = [f for f in per_doy.schema.fields if f.name not in ("cell_id", "doy")]
    have = per_doy.groupBy("cell_id").agg(F.collect_list(F.struct("doy", *[f.name for f in fields])).alias("_have"))
    absent = F.array_except(F.sequence(F.lit(1), F.lit(DAYS)), F.col("_have.doy"))
    blank = F.transform(
        absent, lambda d: F.struct(d.alias("doy"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    )
    return have.select("cell_id", F.inline(F.concat("_have", blank)))


def build_climatology(
    daily: DataFrame,
    value_cols: Sequence[str] = CLIMATOLOGY_VALUES,
    half_window: int = CLIMATOLOGY_HALF_WINDOW,
    percentiles: Sequence[float] = CLIMATOLOGY_PERCENTILES,
) -> DataFrame:
    """Percentiles per (cell, day of year) pooled over a circular day window.

    A day of year holds at most one value per year of record, so its values
    travel as one short array; the window then joins ``2 * half_window + 1`` of
    those arrays. The daily rows are shuffled once instead of once per window
    day.
    """
    dated = daily.withColumn("doy", leap_folded_doy("date"))
    pooled = dated.groupBy("cell_id", "doy").agg(*[F.collect_list(F.col(c).cast("double")).alias(c) for c in value_cols])
    w = Window.partitionBy("cell_id").orderBy("_at").rangeBetween(-half_window, half_window)
    windowed = _circular(_all_days(pooled), half_window).select(
        "cell_id",
        "doy",
        "_at",
        *[F.collect_list(c).over(w).alias(c) for c in value_cols],
    )
    inside = windowed.where(F.col("_at") == F.col("doy")).select(
        "cell_id", "doy", *[F.array_sort(F.flatten(c)).alias(c) for c in value_cols]
    )
    return inside.select(
        "cell_id",
        "doy",
        *[_array_percentile(F.col(c), p).alias(f"{c}_p{int(p)}") for c in value_cols for p in percentiles],
    )


def attach_climatology(daily: DataFrame, clim: DataFrame) -> DataFrame:
    return daily.withColumn("doy", leap_folded_doy("date")).join(clim, ["cell_id", "doy"], "left")


def attach_anomaly(
    daily: DataFrame,
    clim: DataFrame,
    value: str = "wbgt_max",
    percentiles: Sequence[float] = CLIMATOLOGY_PERCENTILES,
) -> DataFrame:
    """Join the climatology and rank each day within its own day-of-year record."""
    pcts = sorted(percentiles)
    missing = [f"{value}_p{int(p)}" for p in pcts if f"{value}_p{int(p)}" not in clim.columns]
    if missing:
        raise KeyError(f"climatology has no {missing}")
    joined = attach_climatology(daily, clim)
    breaks = [(p, F.col(f"{value}_p{int(p)}")) for p in pcts]
    return joined.withColumn(f"{value}_pct_rank", percentile_rank(value, breaks))


def climatology_means(df: DataFrame, train_end: str, smooth: int = 15, value: str = "htsi") -> DataFrame:
    """Mean per (cell, day of year) over the training years, circularly smoothed.

    Days without data take the cell's mean over its days of year first.
    """
    half = smooth // 2
    train = df.where(F.col("date") <= F.lit(train_end).cast("date")).withColumn("doy", leap_folded_doy("date"))
    per_doy = train.groupBy("cell_id", "doy").agg(F.avg(value).alias("m"))
    cell_mean = F.avg("m").over(Window.partitionBy("cell_id"))
    filled = _all_days(per_doy).withColumn("m", F.coalesce("m", cell_mean))
    w = Window.partitionBy("cell_id").orderBy("_at").rangeBetween(-half, half)
    return (
        _circular(filled, half)
        .withColumn(f"clim_{value}", F.avg("m").over(w))
        .where(F.col("_at") == F.col("doy"))
        .select("cell_id", "doy", f"clim_{value}")
    )


def day_number(date: str = "date") -> Column:
    return F.unix_date(F.col(date))


def spell_length(
    df: DataFrame, hot: Column, by: str = "cell_id", order: str = "date", name: str = "spell_days", calendar: bool = False
) -> DataFrame:
    """Length of the current run of hot days; a gap in the calendar may end a run."""
    w = Window.partitionBy(by).orderBy(order)
    is_hot = F.coalesce(hot, F.lit(False))
    broken = ~F.col("_hot")
    if calendar:
        broken = broken | F.coalesce(F.datediff(F.col(order), F.lag(order).over(w)) > 1, F.lit(False))
    flagged = df.withColumn("_hot", is_hot).withColumn("_break", broken.cast("int"))
    run = flagged.withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = F.sum(F.col("_hot").cast("int")).over(inside).cast("int")
    return run.withColumn(name, counted).drop("_hot", "_break", "_run")


def rolling_mean(value: str, rows: int, by: str, order: str, offset: int = 0) -> Column:
    """Mean of a full window of ``rows`` rows that ends ``offset`` rows back; else NULL."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(rows - 1 + offset), -offset)
    return F.when(F.count(value).over(w) == rows, F.avg(value).over(w))


def excess_heat_factor(daily: DataFrame, value: str = "t2m_mean", clim: DataFrame | None = None) -> DataFrame:
    """Excess heat factor: significance times acclimatisation.

    Without a climatology the 95th percentile of the cell's whole record is the
    reference; a cell has one row per day, which bounds that group.
    """
    three = rolling_mean(value, 3, "cell_id", "date")
    thirty = rolling_mean(value, 30, "cell_id", "date", offset=3)
    rolled = daily.withColumns({"_three": three, "_thirty": thirty})
    if clim is None:
        reference = group_percentile(daily, value, 0.95, "cell_id", "_p95")
        rolled = rolled.join(reference, "cell_id", "left")
    else:
        p95 = f"{value}_p95"
        if p95 not in clim.columns:
            raise KeyError(f"climatology has no {p95}")
        rolled = attach_climatology(rolled, clim.select("cell_id", "doy", F.col(p95).alias("_p95")))
    sig, accl = F.col("_three") - F.col("_p95"), F.col("_three") - F.col("_thirty")
    return rolled.withColumns({"ehi_sig": sig, "ehi_accl": accl, "ehf": sig * at_least(accl, 1.0)}).drop(
        "_three", "_thirty", "_p95"
    )


def group_percentile(df: DataFrame, value: str, q: float, by: str, name: str) -> DataFrame:
    """Exact percentile of a daily record per cell."""
    return df.groupBy(by).agg(F.percentile(F.col(value), F.lit(q)).alias(name))
