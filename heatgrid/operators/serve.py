"""Read queries over forecasts and alert states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.functions import text
from heatgrid.operators.ranking import order_statistic

PLACE_KEYS = ("scope", "place_id")


def snapshot(place_days: DataFrame, states: DataFrame, lead: int) -> DataFrame:
    """Every place at one lead with its alert band."""
    state = states.select(*PLACE_KEYS, F.col("band").alias("alert_band"))
    picked = place_days.where(F.col("lead") == lead)
    return picked.join(state, list(PLACE_KEYS), "left").withColumn("alert_band", F.coalesce("alert_band", F.lit("Normal")))


def place(place_days: DataFrame, states: DataFrame, scope: str, place_id: str) -> DataFrame:
    """Six-day forecast of one place with its alert state."""
    mine = (F.col("scope") == scope) & (F.col("place_id") == place_id)
    state = states.where(mine).select(*PLACE_KEYS, F.col("band").alias("alert_band"), "since")
    return place_days.where(mine).join(state, list(PLACE_KEYS), "left")


def series(place_days: DataFrame, as_of: str, back: int = 30) -> DataFrame:
    """Observed day of the last ``back`` issue dates before ``as_of``, then its forecast."""
    moment = F.lit(as_of).cast("date")
    earlier = place_days.where((F.col("lead") == 0) & (F.col("as_of") < moment))
    dates = earlier.select("as_of").distinct().orderBy(F.col("as_of").desc()).limit(back)
    cols = [*PLACE_KEYS, "date", "htsi", "band"]
    history = earlier.join(dates, "as_of", "left_semi").select(*cols, F.lit("history").alias("part"))
    ahead = place_days.where(F.col("as_of") == moment).select(*cols, F.lit("forecast").alias("part"))
    return history.unionByName(ahead)


def explain(place_days: DataFrame, drivers: DataFrame) -> DataFrame:
    """Sentences that explain every place-day.

    ``place_days`` also carries ``name, built_up_frac, vuln_mult, uhi`` and the
    risk figures; ``drivers``: ``place_id, as_of, horizon, drivers``.
    """
    joined = place_days.withColumn("horizon", text.explained_horizon("lead")).join(
        drivers, ["place_id", "as_of", "horizon"], "left"
    )
    note = F.when(
        F.col("horizon") != F.col("lead"),
        F.format_string("Attributions shown are from the D+%d model, the nearest explained horizon.", F.col("horizon")),
    )
    return joined.select(
        *PLACE_KEYS, "as_of", "lead",
        text.forecast_sentence("name", "lead", "htsi", "band", "drivers").alias("sentence"),
        note.alias("note"),
        text.heat_island_sentence("uhi", "built_up_frac").alias("uhi_sentence"),
        text.risk_sentence("expected_deaths", "rr", "vuln_mult", "excess_deaths").alias("risk_sentence"),
    )


def worst_lead(place_days: DataFrame, leads: Sequence[int] = (0, 1, 2, 3), keys: Sequence[str] = ("as_of", "scope", "place_id")) -> DataFrame:
    """Lead with the largest index; the earliest wins ties."""
    order = F.struct(F.col("htsi"), -F.col("lead"))
    picked = place_days.where(F.col("lead").isin(list(leads)))
    return picked.groupBy(*keys).agg(F.max_by(F.struct("lead", "date", "htsi", "band"), order).alias("w")).select(*keys, "w.*")


def field_view(place_days: DataFrame, states: DataFrame, advisories: DataFrame, watch_actions: DataFrame) -> DataFrame:
    """Today, tomorrow and peak of every ward with three actions.

    ``advisories``: public texts per alert in one language (``place_id, label,
    actions, sms``); quiet wards get the Watch actions (one row).
    """
    wards = place_days.where("scope = 'ward'")
    keys = ["as_of", "scope", "place_id"]
    leads = wards.groupBy(*keys).agg(
        F.max(F.when(F.col("lead") == 0, F.struct("htsi", "band"))).alias("today"),
        F.max(F.when(F.col("lead") == 1, F.struct("htsi", "band"))).alias("tomorrow"),
    )
    peak = worst_lead(wards).select(*keys, F.col("lead").alias("peak_lead"), F.col("band").alias("peak_band"))
    fallback = watch_actions.agg(F.first("actions")).scalar()
    level = states.select(*PLACE_KEYS, F.col("band").alias("level"))
    return (
        leads.join(peak, keys)
        .join(level, list(PLACE_KEYS), "left")
        .join(advisories.select("place_id", "actions", "sms"), "place_id", "left")
        .select(
            *keys, F.coalesce("level", F.lit("Normal")).alias("level"),
            F.col("today.htsi").alias("today_htsi"), F.col("today.band").alias("today_band"),
            F.col("tomorrow.htsi").alias("tomorrow_htsi"), F.col("tomorrow.band").alias("tomorrow_band"),
            "peak_lead", "peak_band", F.coalesce("actions", fallback).alias("actions"), "sms",
        )
    )


def trigger_days(states: DataFrame, place_days: DataFrame) -> DataFrame:
    """Active alerts with the forecast day that triggered each of them."""
    active = states.where(F.col("level") > 0).withColumn("lead", F.coalesce(F.col("trigger.lead"), F.lit(0)))
    days = place_days.drop("band", "level", "since")
    return active.join(days, [*PLACE_KEYS, "as_of", "lead"], "left")


def listing(df: DataFrame, limit: int = 200, at: str = "at", address: str | None = None) -> DataFrame:
    """Newest rows first, addresses masked except for web hooks."""
    if address:
        shown = F.when(F.col("channel") == "webhook", F.col(address)).otherwise(text.mask_address(address))
        df = df.withColumn(address, shown)
    return df.orderBy(F.col(at).desc(), *[c for c in ("id",) if c in df.columns]).limit(limit)


def replay_dates(place_days: DataFrame) -> DataFrame:
    """Issue dates that can be replayed, with their place-days, and whether a date is the latest."""
    dates = place_days.groupBy("as_of").agg(F.count("*").alias("place_days"))
    return dates.withColumn("latest", F.col("as_of") == place_days.agg(F.max("as_of")).scalar())


def model_card(features: DataFrame, train_end: str, valid_end: str) -> DataFrame:
    """Rows and dates of the parts of a temporal split, as a model card states them."""
    part = F.when(F.col("date") <= F.lit(train_end).cast("date"), "train").when(F.col("date") <= F.lit(valid_end).cast("date"), "validation").otherwise("test")
    return features.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


def scale_ceiling(rates: DataFrame, value: str, q: float = 0.95, floor: float = 0.02) -> DataFrame:
    """Top of a colour scale: element floor(q*n) of the sorted rates, at least ``floor``."""
    top = order_statistic(rates, value, q, "ceiling")
    return top.select(F.greatest(F.coalesce("ceiling", F.lit(0.0)), F.lit(floor)).alias("ceiling"))


def current_source(payloads: DataFrame) -> DataFrame:
    """Live payloads replace the replay ones; the latest issue date counts."""
    order = F.struct((F.col("mode") == "live").cast("int"), F.col("as_of"))
    return payloads.groupBy(*PLACE_KEYS).agg(F.max_by(F.struct("mode", "as_of", "htsi"), order).alias("r")).select(*PLACE_KEYS, "r.*")
