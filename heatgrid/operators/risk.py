"""Index values to relative risk, excess deaths and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.functions import scaling
from heatgrid.functions.base import at_least, clip
from heatgrid.functions.calendar import leap_folded_doy
from heatgrid.params import BAND_EDGES, ExposureResponse, HeatIslandParams, RiskParams

#: Certified heatstroke counts by year: fixed values.
EXTERNAL_COUNTS = {2023: 73}


def add_lags(df: DataFrame, value: str, n: int, by: Sequence[str], order: str, prefix: str = "lag") -> DataFrame:
    """Row-based lags 0..n-1 within a group of one row per order value."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{prefix}{k}": F.lag(value, k).over(w) for k in range(n)})


def excess_deaths(df: DataFrame, lags: Sequence[str], curve: ExposureResponse | None = None, risk: RiskParams | None = None) -> DataFrame:
    """Relative risk, excess deaths and emergency surge with low and high variants.

    Needs ``base_rate`` (deaths per person and day), ``population``, ``vuln_mult``.
    """
    curve, risk = curve or ExposureResponse(), risk or RiskParams()
    out = df.withColumn("expected_deaths", F.col("base_rate") * F.col("population"))
    variants = {"central": "", "low": "_low", "high": "_high"}
    out = out.withColumns(
        {
            f"rr{suffix}": scaling.relative_risk(scaling.lagged_log_risk(list(lags), curve, which), "vuln_mult")
            for which, suffix in variants.items()
        }
    )
    out = out.withColumns(
        {f"excess_deaths{s}": F.col("expected_deaths") * (F.col(f"rr{s}") - F.lit(1.0)) for s in variants.values()}
    )
    surge = {"": risk.ed_per_death, "_low": risk.ed_per_death_low, "_high": risk.ed_per_death_high}
    return out.withColumns(
        {
            "mri": scaling.mortality_risk_index("rr", curve),
            **{f"ed_surge{s}": F.col(f"excess_deaths{s}") * F.lit(k) for s, k in surge.items()},
        }
    )


def district_daily(daily: DataFrame) -> DataFrame:
    """District-day means over the cells a district owns."""
    return daily.groupBy("ahs_code", "date").agg(*district_statistics(daily.columns))


def district_statistics(columns: Sequence[str]) -> list[Column]:
    means = ("wbgt_max", "utci_max", "t2m_max", "wbgt_night_min")
    return [F.avg("htsi").alias("htsi"), F.max("htsi").alias("htsi_max"), *[F.avg(c).alias(c) for c in means if c in columns]]


def attach_baseline(district_days: DataFrame, baseline: DataFrame, vuln: DataFrame) -> DataFrame:
    base = baseline.select(
        "ahs_code", "doy", F.col("pop_now").alias("population"), (F.col("expected_deaths") / F.col("pop_now")).alias("base_rate")
    )
    return (
        district_days.withColumn("doy", leap_folded_doy("date"))
        .join(base, ["ahs_code", "doy"], "left")
        .join(vuln.select("ahs_code", "vuln_mult"), "ahs_code", "left")
    )


def district_risk(daily: DataFrame, baseline: DataFrame, vuln: DataFrame, curve: ExposureResponse | None = None) -> DataFrame:
    """Daily risk per district from cell-days that carry ``ahs_code``."""
    curve = curve or ExposureResponse()
    days = attach_baseline(district_daily(daily), baseline, vuln)
    lagged = add_lags(days, "htsi", len(curve.lag_weights), ["ahs_code"], "date")
    names = [f"lag{k}" for k in range(len(curve.lag_weights))]
    return excess_deaths(lagged, names, curve).drop(*names)


def annual_summary(risk: DataFrame) -> DataFrame:
    sums = {"excess_deaths": "excess_deaths", "excess_low": "excess_deaths_low", "excess_high": "excess_deaths_high", "expected_deaths": "expected_deaths"}
    return (
        risk.groupBy(F.year("date").alias("year"))
        .agg(*[F.sum(src).alias(name) for name, src in sums.items()])
        .withColumn("attributable_fraction_pct", F.lit(100.0) * F.col("excess_deaths") / F.col("expected_deaths"))
    )


def with_external_counts(annual: DataFrame, external: dict[int, int] | None = None) -> DataFrame:
    """Add a yearly outside count and the ratio to it."""
    table = EXTERNAL_COUNTS if external is None else external
    pairs = [x for year, n in table.items() for x in (F.lit(int(year)), F.lit(int(n)))]
    count = F.try_element_at(F.create_map(*pairs), F.col("year")) if pairs else F.lit(None).cast("int")
    return annual.withColumn("external_count", count).withColumn(
        "ratio_to_external", F.col("excess_deaths") / F.col("external_count")
    )


def monthly_excess(risk: DataFrame) -> DataFrame:
    return risk.groupBy(F.month("date").alias("month")).agg(F.sum("excess_deaths").alias("excess_deaths"))


# --- forecasts in long form: one row per (as_of, scope, place_id, lead) -----


def lead_lags(forecast: DataFrame, history: DataFrame, value: str = "htsi", n: int = 4, place: str = "place_id") -> DataFrame:
    """Lags 0..n-1 of every lead, reaching back into the observed days.

    ``history`` carries leads -3..-1 of the same as-of date. Each (as_of, place)
    has at most nine rows.
    """
    return _lagged(forecast, history, value, n, place).drop("_times")


def _lagged(forecast: DataFrame, history: DataFrame, value: str = "htsi", n: int = 4, place: str = "place_id") -> DataFrame:
    """:func:`lead_lags` with ``_times``, how often the forecast has a row's key; the rows are shuffled and sorted once."""
    keys, names = ["as_of", place, "lead"], [f"lag{k}" for k in range(n)]
    both = forecast.withColumn("_own", F.lit(True)).unionByName(history.select(*keys, value), allowMissingColumns=True)
    w, same = Window.partitionBy("as_of", place).orderBy("lead"), Window.partitionBy(*keys)

    def back(k: int) -> Column:
        return F.when(F.lag("lead", k).over(w) == F.col("lead") - k, F.lag(value, k).over(w))

    lags = both.withColumns({f"lag{k}": back(k) if k else F.col(value) for k in range(n)})
    lags = lags.withColumns({"_lags": F.collect_list(F.struct(*names)).over(same), "_times": F.count("_own").over(same)})
    own = lags.where("_own").dropna(subset=keys).withColumn("_lags", F.explode("_lags"))
    return own.select(*keys, *[c for c in forecast.columns if c not in keys], *[F.col(f"_lags.{c}").alias(c) for c in names], "_times")


def history_leads(observed: DataFrame, issues: DataFrame, days: int = 3, value: str = "htsi", place: str = "place_id") -> DataFrame:
    """Observed values as leads -days..-1 of every issue date."""
    shifted = observed.withColumn("lead", F.explode(F.sequence(F.lit(-days), F.lit(-1)))).withColumn(
        "as_of", F.date_sub(F.col("date"), F.col("lead"))
    )
    return shifted.join(issues.select("as_of").distinct(), "as_of", "left_semi").select("as_of", place, "lead", value)


def ward_forecast(cell_leads: DataFrame, weights: DataFrame, wards: DataFrame, island: HeatIslandParams | None = None) -> DataFrame:
    """Cell forecasts downscaled to wards with the heat-island uplift.

    ``cell_leads``: ``as_of, lead, cell_id, q10, q50, q90, p_warning, p_watch,
    wbgt, utci, night_wbgt``.
    """
    from heatgrid.operators.nearest import apply_weights

    island = island or HeatIslandParams()
    cols = ["q10", "q50", "q90", "p_warning", "p_watch", "wbgt", "utci", "night_wbgt"]
    base = apply_weights(cell_leads, weights, cols, ["as_of", "lead"], points=wards.select("ward_id", "built_up_frac"))
    lift = scaling.heat_island("built_up_frac", "utci", "night_wbgt", island)
    lifted = base.withColumns({"uhi": lift["d_htsi"], "_utci": lift["utci"], "_night": lift["night_wbgt"], "_day": lift["d_day"]})
    htsi = clip(F.col("q50") + F.col("uhi"), 0.0, 100.0)
    today = F.col("lead") == 0

    def p(c: str, edge: float) -> Column:
        return F.when(today, (F.col("htsi") >= edge).cast("double")).otherwise(clip(c, 0.0, 1.0))

    return (
        lifted.withColumn("htsi", htsi)
        .withColumns(
            {
                "q10": clip(F.col("q10") + F.col("uhi"), 0.0, 100.0),
                "q90": clip(F.col("q90") + F.col("uhi"), 0.0, 100.0),
                "p_warning": p("p_warning", BAND_EDGES[1]),
                "p_watch": p("p_watch", BAND_EDGES[0]),
                "band": scaling.stress_band("htsi"),
                "wbgt": F.col("wbgt") + F.lit(island.wbgt_per_degc) * F.col("_day"),
                "utci": F.col("_utci"),
                "night_wbgt": F.col("_night"),
            }
        )
        .drop("q50", "_utci", "_night", "_day", "built_up_frac")
    )


def district_forecast(cell_leads: DataFrame, cell_district: DataFrame) -> DataFrame:
    """District means per lead over the cells it owns, with the largest value."""
    owned = cell_leads.join(cell_district.select("cell_id", "ahs_code"), "cell_id")
    means = {"htsi": "q50", "q10": "q10", "q90": "q90", "p_warning": "p_warning", "p_watch": "p_watch", "wbgt": "wbgt", "utci": "utci"}
    out = owned.groupBy("as_of", "lead", "ahs_code").agg(
        *[F.avg(src).alias(name) for name, src in means.items()], F.max("q50").alias("htsi_max")
    )
    return out.withColumn("band", scaling.stress_band("htsi"))


def _with_risk(rows: DataFrame, people: DataFrame, baseline: DataFrame, curve: ExposureResponse) -> DataFrame:
    """Risk of every (as_of, place_id, lead) from its lags, see :func:`_lagged`, people and seasonal base rate."""
    names = [f"lag{k}" for k in range(len(curve.lag_weights))]
    rate = baseline.select("ahs_code", "doy", (F.col("expected_deaths") / F.col("pop_now")).alias("base_rate"))
    dated = rows.withColumn("date", F.date_add("as_of", F.col("lead"))).withColumn("doy", leap_folded_doy("date"))
    joined = (
        dated.withColumn("_times", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))))
        .drop("_times")
        .join(people, "place_id")
        .join(rate, ["ahs_code", "doy"], "left")
    )
    out = excess_deaths(joined, names, curve)
    return out.withColumn("observed", F.col("lead") == 0).withColumnsRenamed(
        {"excess_deaths_low": "excess_low", "excess_deaths_high": "excess_high"}
    )


PAYLOAD = (
    "as_of", "scope", "place_id", "lead", "date", "observed", "htsi", "q10", "q90", "p_warning", "p_watch", "band", "wbgt",
    "utci", "night_wbgt", "uhi", "rr", "mri", "expected_deaths", "excess_deaths", "excess_low", "excess_high", "ed_surge",
)


def ward_payload(
    cell_leads: DataFrame, observed: DataFrame, weights: DataFrame, wards: DataFrame, baseline: DataFrame, curve: ExposureResponse | None = None
) -> DataFrame:
    """Place-days of all wards: downscaled forecast, heat island, lags over the seam, risk.

    ``observed``: ``cell_id, date, htsi``. ``wards``: ``ward_id, built_up_frac,
    population, vuln_mult, ahs_code``.
    """
    from heatgrid.operators.nearest import apply_weights

    curve = curve or ExposureResponse()
    ahead = ward_forecast(cell_leads, weights, wards).withColumnRenamed("ward_id", "place_id")
    past = history_leads(observed.withColumnRenamed("cell_id", "place_id"), cell_leads, len(curve.lag_weights) - 1)
    carried = apply_weights(past.withColumnRenamed("place_id", "cell_id"), weights, ["htsi"], ["as_of", "lead"])
    lift = ahead.where("lead = 0").select("as_of", "place_id", "uhi")
    history = carried.withColumnRenamed("ward_id", "place_id").join(lift, ["as_of", "place_id"]).withColumn("htsi", F.col("htsi") + F.col("uhi"))
    lags = _lagged(ahead, history, n=len(curve.lag_weights))
    people = wards.select(F.col("ward_id").alias("place_id"), "population", "vuln_mult", "ahs_code")
    return _with_risk(lags, people, baseline, curve).withColumn("scope", F.lit("ward")).select(*PAYLOAD)


def district_payload(
    cell_leads: DataFrame, observed: DataFrame, cell_district: DataFrame, baseline: DataFrame, vuln: DataFrame, curve: ExposureResponse | None = None
) -> DataFrame:
    """Place-days of all districts from the means over their cells."""
    curve = curve or ExposureResponse()
    ahead = district_forecast(cell_leads, cell_district).withColumn("place_id", F.col("ahs_code"))
    owned = observed.join(cell_district.select("cell_id", "ahs_code"), "cell_id")
    means = owned.groupBy(F.col("ahs_code").alias("place_id"), "date").agg(F.avg("htsi").alias("htsi"))
    lags = _lagged(ahead.drop("ahs_code"), history_leads(means, cell_leads, len(curve.lag_weights) - 1), n=len(curve.lag_weights))
    people = (
        baseline.groupBy("ahs_code").agg(F.max("pop_now").alias("population")).join(vuln.select("ahs_code", "vuln_mult"), "ahs_code")
    ).withColumn("place_id", F.col("ahs_code"))
    out = _with_risk(lags, people, baseline, curve).withColumn("scope", F.lit("district"))
    return out.select(*[c for c in PAYLOAD if c not in ("night_wbgt", "uhi")], "htsi_max")


def statewide(place_days: DataFrame) -> DataFrame:
    """District totals per as-of date and lead."""
    cols = ("excess_deaths", "excess_low", "excess_high")
    return place_days.where("scope = 'district'").groupBy("as_of", "lead").agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols]
    )


def default_date(place_days: DataFrame, lead: int = 3) -> DataFrame:
    """Issue date with the largest statewide excess at one lead; earliest on ties."""
    totals = statewide(place_days.where(F.col("lead") == lead))
    order = F.struct(F.col("excess_deaths"), -F.unix_date("as_of"))
    return totals.agg(F.max_by("as_of", order).alias("as_of"), F.max("excess_deaths").alias("excess_deaths"))


def payload_as_of(place_days: DataFrame, asked, default) -> DataFrame:
    """Rows of the asked issue date, or of the default when it has none."""
    asked_d, default_d = F.lit(asked).cast("date"), F.lit(default).cast("date")
    return place_days.where(F.col("as_of") == chosen_date(place_days, asked_d, default_d))


def chosen_date(place_days: DataFrame, asked: Column, default: Column) -> Column:
    present = place_days.where(F.col("as_of") == asked).agg(F.max("as_of")).scalar()
    return F.coalesce(present, default)


def latest_as_of(place_days: DataFrame, moment: str) -> DataFrame:
    """As-of variant: the last issue date at or before a moment, per place."""
    known = place_days.where(F.col("as_of") <= F.lit(moment).cast("date"))
    return known.groupBy("scope", "place_id", "lead").agg(F.max_by(F.struct("as_of", "htsi"), "as_of").alias("_r")).select(
        "scope", "place_id", "lead", "_r.as_of", "_r.htsi"
    )


def ward_demand(place_days: DataFrame, wards: DataFrame, leads: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Forecast excess per ward plus a small exposure floor."""
    picked = place_days.where((F.col("scope") == "ward") & F.col("lead").isin(list(leads)))
    part = lambda c: F.sum(at_least(F.coalesce(F.col(c), F.lit(0.0)), 0.0))
    sums = picked.groupBy(F.col("place_id").alias("ward_id")).agg(
        part("excess_deaths").alias("excess"), part("excess_low").alias("low"), part("excess_high").alias("high")
    )
    joined = wards.select("ward_id", "city", "lat", "lon", "population", "vuln_mult").join(sums, "ward_id", "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("excess", "low", "high")})
    return filled.withColumn("demand", F.col("excess") + F.lit(1e-6) * F.col("population") * F.col("vuln_mult"))
