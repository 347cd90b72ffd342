"""Verification figures of forecasts and of alert rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.ranking import running_totals

SUMMER = (3, 4, 5, 6)


def mae(predicted, observed) -> Column:
    return F.avg(F.abs(predicted - observed))


def forecast_error(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors of model, persistence and climatology; needs ``y, q50, persist, climo, target_date``."""
    y = F.col("y")
    summer = F.month("target_date").isin(list(SUMMER))
    rows = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        mae(F.col("q50"), y).alias("mae_model"),
        mae(F.col("persist"), y).alias("mae_persistence"),
        mae(F.col("climo"), y).alias("mae_climatology"),
        F.avg(F.when(summer, F.abs(F.col("q50") - y))).alias("mae_model_summer"),
        F.avg(F.when(summer, F.abs(F.col("persist") - y))).alias("mae_persistence_summer"),
    )
    return rows.withColumns(
        {
            "skill_vs_persistence": F.lit(1.0) - F.try_divide("mae_model", "mae_persistence"),
            "skill_vs_climatology": F.lit(1.0) - F.try_divide("mae_model", "mae_climatology"),
        }
    )


def interval_coverage(df: DataFrame, qhat: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """Share of outcomes inside the raw and the widened band, and mean width."""
    q = qhat if isinstance(qhat, Column) else F.lit(float(qhat))
    y = F.col("y")
    return df.groupBy(*by).agg(
        F.avg(y.between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage_raw"),
        F.avg(y.between(F.col("q10") - q, F.col("q90") + q).cast("double")).alias("coverage_conformal"),
        F.avg(F.col("q90") - F.col("q10") + F.lit(2.0) * q).alias("band_width_mean"),
    )


def prf(df: DataFrame, pred: Column, obs: Column, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 with the counts behind them."""
    counts = df.groupBy(*by).agg(
        F.count_if(pred & obs).alias("tp"), F.count_if(pred & ~obs).alias("fp"), F.count_if(~pred & obs).alias("fn")
    )
    return counts.withColumns(_prf_columns())


def _prf_columns() -> dict[str, Column]:
    tp = F.col("tp")
    precision = tp / F.greatest(tp + F.col("fp"), F.lit(1))
    recall = tp / F.greatest(tp + F.col("fn"), F.lit(1))
    f1 = F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    return {"precision": precision, "recall": recall, "f1": f1}


def brier(df: DataFrame, p: str, obs: Column, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and skill against always forecasting the base rate."""
    o = obs.cast("double")
    rows = df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - o, F.lit(2.0))).alias("brier"), F.avg(o).alias("base_rate"))
    reference = F.greatest(F.col("base_rate") * (F.lit(1.0) - F.col("base_rate")), F.lit(1e-12))
    return rows.withColumn("brier_skill", F.lit(1.0) - F.col("brier") / reference)


def reliability(df: DataFrame, p: str, obs: Column, bins: int = 10) -> DataFrame:
    """Forecasts and observed frequency per probability bin; empty bins are listed."""
    index = F.least(F.greatest(F.floor(F.col(p) * F.lit(float(bins))), F.lit(0)), F.lit(bins - 1)).cast("int")
    seen = df.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg(obs.cast("double")).alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").select(
        "bin", ((F.col("bin") + F.lit(0.5)) / F.lit(float(bins))).alias("mid"), F.coalesce("n", F.lit(0)).alias("n"), "observed"
    )


def threshold_grid(low: float = 0.02, high: float = 0.90, n: int = 89) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n)]


def best_threshold(df: DataFrame, p: str, obs: Column, grid: Sequence[float] | None = None) -> DataFrame:
    """Grid threshold with the largest F1 (rounded to 3 places), the first on ties.

    Each row is counted once in the slot of the highest threshold it reaches;
    totals above a threshold are then running sums over the grid, so the data is
    never multiplied by the grid.
    """
    grid = list(grid or threshold_grid())
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= F.col(p)))
    slots = df.groupBy(reached.alias("slot")).agg(F.count_if(obs).alias("pos"), F.count_if(~obs).alias("neg"))
    bounded = slots.agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("pos", "neg")))).alias("m"), F.sum("pos").alias("all_pos")
    )
    spots = F.transform(F.sequence(F.lit(0), F.lit(len(grid))), lambda s: F.try_element_at(F.col("m"), s))
    listed = bounded.select(spots.alias("c"), "all_pos")
    table = listed.select(
        F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("i", "threshold"), "c", "all_pos"
    )

    def above(field: str) -> Column:
        tail = F.slice(F.col("c"), F.col("i") + 2, F.lit(len(grid) + 1))
        return F.aggregate(tail, F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(s[field], F.lit(0)))

    scored = table.select("threshold", "i", above("pos").alias("tp"), above("neg").alias("fp"), "all_pos").withColumn(
        "fn", F.col("all_pos") - F.col("tp")
    )
    f1 = scored.withColumns(_prf_columns()).withColumn("f1", F.round("f1", 3))
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("i"))).alias("b")
    return f1.agg(best).select("b.threshold", "b.f1")


def conformal_qhat(df: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Widening that makes the 10-90 band reach its nominal coverage.

    Needs ``y, q10, q90``. The level depends on the count, so the quantile is
    read off the running totals.
    """
    scores = df.select(F.greatest(F.col("q10") - F.col("y"), F.col("y") - F.col("q90")).alias("score"))
    t = running_totals(scores, "score", {"n": F.lit(1)})
    n = F.col("total_n")
    level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1.0 - alpha)) / n)
    pos = level * (n - 1)
    low = F.min(F.when(F.col("cum_n") > F.floor(pos), F.col("score")))
    high = F.min(F.when(F.col("cum_n") > F.ceil(pos), F.col("score")))
    return t.agg((low + F.max(pos - F.floor(pos)) * (high - low)).alias("qhat"), F.max(n).alias("n"))


def monthly_rates(daily: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Percent of cell-days each rule flags, per month."""
    return daily.groupBy(F.month("date").alias("month")).agg(
        *[(F.lit(100.0) * F.avg(rule.cast("double"))).alias(name) for name, rule in rules.items()]
    )


def rule_disagreement(daily: DataFrame, index_rule: Column, temp_rule: Column) -> DataFrame:
    """Where an index rule and a temperature rule part ways."""
    missed, over = index_rule & ~temp_rule, temp_rule & ~index_rule
    late = F.month("date").isin([7, 8])
    share = lambda part, whole: F.lit(100.0) * F.count_if(part) / F.greatest(F.count_if(whole), F.lit(1))
    return daily.agg(
        F.count("*").alias("cell_days"),
        (F.lit(100.0) * F.avg(temp_rule.cast("double"))).alias("temp_rate_pct"),
        (F.lit(100.0) * F.avg(index_rule.cast("double"))).alias("index_rate_pct"),
        share(missed, index_rule).alias("missed_by_temp_pct"),
        share(over, temp_rule).alias("temp_only_pct"),
        F.avg(F.when(missed, F.col("t2m_max"))).alias("missed_mean_tmax"),
        F.avg(F.when(missed, F.col("wbgt_max"))).alias("missed_mean_wbgt"),
        F.avg(F.when(over, F.col("wbgt_max"))).alias("over_mean_wbgt"),
        F.count_if(late & temp_rule).alias("jul_aug_temp"),
        F.count_if(late & index_rule).alias("jul_aug_index"),
    )


def only_in(df: DataFrame, rule_a: Column, rule_b: Column) -> DataFrame:
    """Rows the first rule flags and the second does not."""
    return df.where(rule_a & ~rule_b)


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: nulls, count, mean, sample deviation, smallest, largest."""
    stats = {
        "nulls": lambda c: F.count_if(F.col(c).isNull()).cast("double"),
        "n": lambda c: F.count(c).cast("double"),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    row = df.agg(*[F.struct(*[f(c).alias(k) for k, f in stats.items()]).alias(c) for c in cols])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in cols])
    return row.select(F.explode(entries).alias("e")).select("e.column_name", "e.s.*")
