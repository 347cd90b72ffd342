"""Features, verification, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heatgrid.operators import alerts, features, forecast, metrics, ranking, serve
from heatgrid.operators.climatology import climatology_means
from heatgrid.params import BAND_EDGES, ExposureResponse
from heatgrid.plans import alerting
from heatgrid.plans import fixtures as fx
from heatgrid.plans.common import Query, pick, rounded, table, with_ctes
from heatgrid.session import cut_lineage, scratch_path
from heatgrid.sources import documents
from heatgrid.sources import weather as weather_source
from heatgrid.streaming import daily as daily_streams

QUERIES: dict[str, Query] = {}
TRAIN_END, VALID_END = "1998-12-31", "1999-12-31"


def _frame(spark, sf):
    """Index panel with coordinates, as the feature job takes it."""
    ix = fx.indexed(spark, sf).select(*[c for c in features.INPUTS if c not in ("lat", "lon")])
    cells = fx.panel_cells(fx.panel_ids(spark, sf)).select("cell_id", "lat", "lon")
    return ix.join(cells, "cell_id")


def _features(spark, sf, horizon: int):
    df = cut_lineage(_frame(spark, sf))
    return features.build_features(df, climatology_means(df, "1999-12-31"), horizon)


def _feature_sql(h: int) -> str:
    cols = ["cell_id", "date", "lat", "lon", "spell_days"]
    cols += [f"lag({v}, {k}) OVER w AS {v}_l{k}" for v in features.LAG_VARS for k in features.LAGS]
    cols += [
        f"CASE WHEN count({v}) OVER w{n} = {n} THEN avg({v}) OVER w{n} END AS {v}_r{n}" for v in features.ROLL_VARS for n in features.ROLL_DAYS
    ]
    cols += ["CASE WHEN count(htsi) OVER w7 = 7 THEN max(htsi) OVER w7 END AS htsi_max7", "htsi - lag(htsi, 1) OVER w AS d_htsi"]
    cols += [f"lead({v}, {h}) OVER w AS y_{v}" for v in features.TARGETS]
    windows = "w AS (PARTITION BY cell_id ORDER BY date), " + ", ".join(
        f"w{n} AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 7, 14)
    )
    return f"""framed AS (SELECT indexed.*, lat, lon FROM indexed JOIN panel_cells USING (cell_id)),
feat0 AS (SELECT {', '.join(cols)} FROM framed WINDOW {windows}),
feat AS (SELECT f.*, (f.date + {h})::DATE AS target_date, sin(2.0e0 * pi() * {fx.doy(f'(f.date + {h})')} / 365.0e0) AS doy_sin, cos(2.0e0 * pi() * {fx.doy(f'(f.date + {h})')} / 365.0e0) AS doy_cos,
  mt.clim_htsi AS clim_htsi_target, htsi_l0 - mi.clim_htsi AS anom_today, t.wbgt_max_p90 AS clim_p90_target
  FROM feat0 f LEFT JOIN means mt ON mt.cell_id = f.cell_id AND mt.doy = {fx.doy(f'(f.date + {h})')} LEFT JOIN means mi ON mi.cell_id = f.cell_id AND mi.doy = {fx.doy('f.date')}
  LEFT JOIN indexed t ON t.cell_id = f.cell_id AND t.date = f.date + {h})"""


def _means_sql() -> str:
    from heatgrid.plans.weather import MEANS_SQL

    return MEANS_SQL


FEATURE_CTES = (*fx.INDEX_CTES, fx.PANEL_CELLS_SQL, _means_sql(), _feature_sql(2))
_DOUBLES = [c for c in features.feature_columns() if c != "spell_days"] + [f"y_{t}" for t in features.TARGETS]

QUERIES["forecast_features"] = (
    lambda spark, sf: rounded(_features(spark, sf, 2)),
    with_ctes(pick(["cell_id", "date", "target_date", "spell_days"], _DOUBLES, "feat"), *FEATURE_CTES),
)


def calendar_lags(spark, sf):
    """Lags and targets by calendar day, which leave holes where days are missing."""
    p = fx.panel(spark, sf).select("cell_id", "date", "wbgt_max")
    out = features.add_targets(features.add_lags(p, ["wbgt_max"], (1, 3), calendar=True), 2, ["wbgt_max"], calendar=True)
    return rounded(out)


QUERIES["calendar_lags"] = (
    calendar_lags,
    with_ctes(
        "SELECT p.cell_id, p.date, round(p.wbgt_max, 4) + 0.0e0 AS wbgt_max, round(a.wbgt_max, 4) + 0.0e0 AS wbgt_max_l1, round(b.wbgt_max, 4) + 0.0e0 AS wbgt_max_l3, round(c.wbgt_max, 4) + 0.0e0 AS y_wbgt_max FROM panel p "
        "LEFT JOIN panel a ON a.cell_id = p.cell_id AND a.date = p.date - 1 LEFT JOIN panel b ON b.cell_id = p.cell_id AND b.date = p.date - 3 LEFT JOIN panel c ON c.cell_id = p.cell_id AND c.date = p.date + 2",
        fx.PANEL,
    ),
)

QUERIES["target_threshold"] = (
    lambda spark, sf: rounded(features.target_threshold(fx.panel(spark, sf).select("cell_id", "date", "wbgt_max"), 1, "wbgt_max", "ahead")),
    with_ctes("SELECT p.cell_id, p.date, round(p.wbgt_max, 4) + 0.0e0 AS wbgt_max, round(a.wbgt_max, 4) + 0.0e0 AS ahead FROM panel p LEFT JOIN panel a ON a.cell_id = p.cell_id AND a.date = p.date + 1", fx.PANEL),
)


def split_sizes(spark, sf):
    f = _features(spark, sf, 2).withColumn("clim_p90_target", F.coalesce("clim_p90_target", F.lit(30.0)))
    usable = features.usable_rows(f).withColumn("part", features.split_label(TRAIN_END, VALID_END))
    return usable.groupBy("part").agg(F.count("*").alias("n"), F.min("target_date").alias("first"), F.max("target_date").alias("last"))


QUERIES["split_sizes"] = (
    split_sizes,
    with_ctes(
        f"SELECT count(*) AS n, min(target_date) AS first, max(target_date) AS last, CASE WHEN target_date <= DATE '{TRAIN_END}' THEN 'train' WHEN target_date <= DATE '{VALID_END}' THEN 'valid' ELSE 'test' END AS part FROM feat WHERE y_htsi IS NOT NULL AND htsi_r14 IS NOT NULL GROUP BY 4",
        *FEATURE_CTES,
    ),
)

# --- verification ----------------------------------------------------------------------


def _verified(spark, sf):
    """Outcomes with simple forecasts, one row per panel day."""
    w = Window.partitionBy("cell_id").orderBy("date")
    h = F.lit(30.0) + (F.col("wbgt_max") - F.lit(24.0)) * F.lit(3.1)
    p = fx.panel(spark, sf).withColumn("h", h)
    rows = p.withColumns({"y": F.lead("h").over(w), "persist": F.col("h")}).where("y IS NOT NULL")
    return rows.select(
        "cell_id", "date", F.date_add("date", 1).alias("target_date"), "y", "persist", "t2m_max", "wbgt_max",
        (F.lit(0.6) * F.col("h") + F.lit(0.4) * F.col("y") + F.col("cell_id") % 3 - 1).alias("q50"),
        (F.lit(0.6) * F.col("h") + F.lit(0.4) * F.col("y") - F.lit(6.1)).alias("q10"),
        (F.lit(0.6) * F.col("h") + F.lit(0.4) * F.col("y") + F.lit(7.3)).alias("q90"),
        (F.lit(44.0) + F.col("cell_id") % 5).alias("climo"),
        F.round((F.lit(0.5) * F.col("h") + F.lit(0.5) * F.col("y") - F.lit(29.9)) / F.lit(42.0), 3).alias("p"),
    )


VERIFIED = """vh AS (SELECT *, 30.0e0 + (wbgt_max - 24.0e0) * 3.1e0 AS h FROM panel),
vy AS (SELECT *, lead(h) OVER (PARTITION BY cell_id ORDER BY date) AS y FROM vh),
ver AS (SELECT cell_id, date, (date + 1)::DATE AS target_date, y, h AS persist, t2m_max, wbgt_max, 0.6e0 * h + 0.4e0 * y + cell_id % 3 - 1 AS q50, 0.6e0 * h + 0.4e0 * y - 6.1e0 AS q10, 0.6e0 * h + 0.4e0 * y + 7.3e0 AS q90,
  44.0e0 + cell_id % 5 AS climo, round((0.5e0 * h + 0.5e0 * y - 29.9e0) / 42.0e0, 3) AS p FROM vy WHERE y IS NOT NULL)"""
V = (fx.PANEL, VERIFIED)
EDGE = BAND_EDGES[1]


def _obs():
    return F.col("y") >= EDGE


QUERIES["forecast_error"] = (
    lambda spark, sf: rounded(metrics.forecast_error(_verified(spark, sf))),
    with_ctes(
        """, m AS (SELECT count(*) AS n, avg(abs(q50 - y)) AS a, avg(abs(persist - y)) AS b, avg(abs(climo - y)) AS c, avg(abs(q50 - y)) FILTER (WHERE month(target_date) IN (3, 4, 5, 6)) AS s, avg(abs(persist - y)) FILTER (WHERE month(target_date) IN (3, 4, 5, 6)) AS t FROM ver)
"""
        + pick(["n"], ["a AS mae_model", "b AS mae_persistence", "c AS mae_climatology", "s AS mae_model_summer", "t AS mae_persistence_summer", "1 - a / b AS skill_vs_persistence", "1 - a / c AS skill_vs_climatology"], "m"),
        *V,
    ),
)

QUERIES["interval_coverage"] = (
    lambda spark, sf: rounded(metrics.interval_coverage(_verified(spark, sf), 1.5, by=["cell_id"])),
    with_ctes("SELECT cell_id, round(avg((y BETWEEN q10 AND q90)::INT), 4) + 0.0e0 AS coverage_raw, round(avg((y BETWEEN q10 - 1.5e0 AND q90 + 1.5e0)::INT), 4) + 0.0e0 AS coverage_conformal, round(avg(q90 - q10 + 3.0e0), 4) + 0.0e0 AS band_width_mean FROM ver GROUP BY 1", *V),
)

_PRF = """SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1)::DOUBLE, 4) + 0.0e0 AS "precision", round(tp / greatest(tp + fn, 1)::DOUBLE, 4) + 0.0e0 AS recall,
round(2 * (tp / greatest(tp + fp, 1)::DOUBLE) * (tp / greatest(tp + fn, 1)::DOUBLE) / greatest(tp / greatest(tp + fp, 1)::DOUBLE + tp / greatest(tp + fn, 1)::DOUBLE, 1e-9), 4) + 0.0e0 AS f1 FROM k"""
QUERIES["warning_scores"] = (
    lambda spark, sf: rounded(metrics.prf(_verified(spark, sf), F.col("q50") >= EDGE, _obs())),
    with_ctes(f", k AS (SELECT count(*) FILTER (WHERE q50 >= {EDGE}e0 AND y >= {EDGE}e0) AS tp, count(*) FILTER (WHERE q50 >= {EDGE}e0 AND y < {EDGE}e0) AS fp, count(*) FILTER (WHERE q50 < {EDGE}e0 AND y >= {EDGE}e0) AS fn FROM ver) {_PRF}", *V),
)

QUERIES["brier_score"] = (
    lambda spark, sf: rounded(metrics.brier(_verified(spark, sf), "p", _obs())),
    with_ctes(f", k AS (SELECT avg(pow(p - (y >= {EDGE}e0)::INT, 2)) AS b, avg((y >= {EDGE}e0)::INT) AS r FROM ver) SELECT round(b, 4) + 0.0e0 AS brier, round(r, 4) + 0.0e0 AS base_rate, round(1 - b / greatest(r * (1 - r), 1e-12), 4) + 0.0e0 AS brier_skill FROM k", *V),
)

QUERIES["reliability"] = (
    lambda spark, sf: rounded(metrics.reliability(_verified(spark, sf), "p", _obs())),
    with_ctes(
        f""", k AS (SELECT least(greatest(floor(p * 10.0e0), 0), 9)::INTEGER AS bin, count(*) AS n, avg((y >= {EDGE}e0)::INT) AS o FROM ver GROUP BY 1)
SELECT b::INTEGER AS bin, round((b + 0.5e0) / 10.0e0, 4) AS mid, coalesce(n, 0) AS n, round(o, 4) + 0.0e0 AS observed FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN k ON k.bin = b""",
        *V,
    ),
)

QUERIES["roc_auc"] = (
    lambda spark, sf: rounded(ranking.roc_auc(_verified(spark, sf), "p", _obs()), 6),
    with_ctes(
        f""", r AS (SELECT (y >= {EDGE}e0)::INT AS o, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS rk FROM ver)
SELECT round((sum(rk * o) - sum(o) * (sum(o) + 1) / 2.0e0) / (sum(o)::DOUBLE * sum(1 - o)), 6) + 0.0e0 AS auc FROM r""",
        *V,
    ),
)

QUERIES["average_precision"] = (
    lambda spark, sf: rounded(ranking.average_precision(_verified(spark, sf), "p", _obs()), 6),
    with_ctes(
        f""", g AS (SELECT p, sum((y >= {EDGE}e0)::INT) AS pos, count(*) AS n FROM ver GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS called FROM g)
SELECT round(sum(pos * (tp / called::DOUBLE)) / sum(pos), 6) + 0.0e0 AS average_precision FROM c""",
        *V,
    ),
)

_GRID = metrics.threshold_grid()
QUERIES["best_threshold"] = (
    lambda spark, sf: rounded(metrics.best_threshold(_verified(spark, sf), "p", _obs())),
    with_ctes(
        f""", grid(i, t) AS (VALUES {', '.join(f'({i}, {t!r}::DOUBLE)' for i, t in enumerate(_GRID))}),
k AS (SELECT i, t, count(*) FILTER (WHERE p >= t AND y >= {EDGE}e0) AS tp, count(*) FILTER (WHERE p >= t AND y < {EDGE}e0) AS fp, count(*) FILTER (WHERE p < t AND y >= {EDGE}e0) AS fn FROM ver, grid GROUP BY 1, 2),
f AS (SELECT i, t, tp / greatest(tp + fp, 1)::DOUBLE AS pr, tp / greatest(tp + fn, 1)::DOUBLE AS rc FROM k)
SELECT round(t, 4) + 0.0e0 AS threshold, round(2 * pr * rc / greatest(pr + rc, 1e-9), 3) + 0.0e0 AS f1 FROM f ORDER BY f1 DESC, i LIMIT 1""",
        *V,
    ),
)

QUERIES["conformal_width"] = (
    lambda spark, sf: rounded(metrics.conformal_qhat(_verified(spark, sf))),
    with_ctes(
        """, s AS (SELECT greatest(q10 - y, y - q90) AS e FROM ver), o AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM s),
l AS (SELECT max(n) AS n, least(1.0e0, ceil((max(n) + 1) * 0.8e0) / max(n)) * (max(n) - 1) AS pos FROM o)
SELECT round((SELECT e FROM o WHERE i = floor(pos)) + (pos - floor(pos)) * ((SELECT e FROM o WHERE i = ceil(pos)) - (SELECT e FROM o WHERE i = floor(pos))), 4) + 0.0e0 AS qhat, n FROM l""",
        *V,
    ),
)


def _rules():
    return F.col("y") >= 48.5, F.col("t2m_max") >= 40.0


QUERIES["rule_disagreement"] = (
    lambda spark, sf: rounded(metrics.rule_disagreement(_verified(spark, sf), *_rules())),
    with_ctes(
        """, r AS (SELECT *, y >= 48.5e0 AS a, t2m_max >= 40.0e0 AS b, month(date) IN (7, 8) AS late FROM ver)
SELECT count(*) AS cell_days, round(100 * avg(b::INT), 4) + 0.0e0 AS temp_rate_pct, round(100 * avg(a::INT), 4) + 0.0e0 AS index_rate_pct,
round(100.0e0 * count(*) FILTER (WHERE a AND NOT b) / greatest(count(*) FILTER (WHERE a), 1), 4) + 0.0e0 AS missed_by_temp_pct, round(100.0e0 * count(*) FILTER (WHERE b AND NOT a) / greatest(count(*) FILTER (WHERE b), 1), 4) + 0.0e0 AS temp_only_pct,
round(avg(t2m_max) FILTER (WHERE a AND NOT b), 4) + 0.0e0 AS missed_mean_tmax, round(avg(wbgt_max) FILTER (WHERE a AND NOT b), 4) + 0.0e0 AS missed_mean_wbgt, round(avg(wbgt_max) FILTER (WHERE b AND NOT a), 4) + 0.0e0 AS over_mean_wbgt,
count(*) FILTER (WHERE late AND b) AS jul_aug_temp, count(*) FILTER (WHERE late AND a) AS jul_aug_index FROM r""",
        *V,
    ),
)

QUERIES["monthly_rates"] = (
    lambda spark, sf: rounded(metrics.monthly_rates(_verified(spark, sf), dict(zip(("index_rule", "temp_rule"), _rules())))),
    with_ctes("SELECT month(date)::INTEGER AS month, round(100 * avg((y >= 48.5e0)::INT), 4) + 0.0e0 AS index_rule, round(100 * avg((t2m_max >= 40.0e0)::INT), 4) + 0.0e0 AS temp_rule FROM ver GROUP BY 1", *V),
)

QUERIES["missed_days"] = (
    lambda spark, sf: metrics.only_in(_verified(spark, sf), *_rules()).select("cell_id", "date"),
    with_ctes("SELECT cell_id, date FROM ver WHERE y >= 48.5e0 EXCEPT SELECT cell_id, date FROM ver WHERE t2m_max >= 40.0e0", *V),
)


def top_drivers(spark, sf):
    """Four largest contributions of every row."""
    li = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    names = ["a", "b", "c", "d", "e", "f"]
    entries = [
        F.struct(F.lit(n).alias("feature"), F.lit(n.upper()).alias("label"), F.lit(0.0).alias("value"), (((F.col("o_orderkey") * (i + 3) * 7919 + F.col("o_custkey") * (i + 1)) % 1009) - 504).cast("double").alias("contribution"))
        for i, n in enumerate(names)
    ]
    out = li.withColumn("drivers", forecast.top_drivers(F.array(*entries)))
    return out.select("o_orderkey", F.array_join("drivers.feature", "").alias("top"))


QUERIES["top_drivers"] = (
    top_drivers,
    "WITH x AS (SELECT o_orderkey, n, abs((o_orderkey * (i + 3) * 7919 + o_custkey * (i + 1)) % 1009 - 504) AS w FROM orders, (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd'), (4, 'e'), (5, 'f')) v(i, n)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY w DESC, n) AS k FROM x) SELECT o_orderkey, string_agg(n, '' ORDER BY k) AS top FROM r WHERE k <= 4 GROUP BY 1",
)


def live_bands(spark, sf):
    """Observed day and five forecast days of the panel with calibrated widths."""
    p = fx.panel(spark, sf).select("cell_id", "date", (F.lit(30.0) + (F.col("wbgt_max") - F.lit(24.0)) * F.lit(3.1)).alias("htsi"))
    return rounded(forecast.live_band(p, {1: 8.0, 2: 9.0, 3: 10.0, 4: 11.0, 5: 12.0}, F.lit("1998-05-10").cast("date")))


def _pe(edge: float) -> str:
    return f"CASE WHEN lead = 0 THEN (htsi >= {edge}e0)::INT::DOUBLE ELSE 1.0e0 - least(greatest(CASE WHEN {edge}e0 <= htsi THEN 0.5e0 - (htsi - {edge}e0) * 0.4e0 / greatest(htsi - q10, 1e-3) ELSE 0.5e0 + ({edge}e0 - htsi) * 0.4e0 / greatest(q90 - htsi, 1e-3) END, 0.0e0), 1.0e0) END"


QUERIES["live_bands"] = (
    live_bands,
    with_ctes(
        """, b AS (SELECT cell_id, date, 30.0e0 + (wbgt_max - 24.0e0) * 3.1e0 AS htsi, (date - DATE '1998-05-10')::INTEGER AS lead FROM panel WHERE date BETWEEN DATE '1998-05-10' AND DATE '1998-05-15'),
c AS (SELECT *, greatest(htsi - CASE lead WHEN 0 THEN 0.0e0 ELSE (7 + lead) / 2.0e0 END, 0.0e0) AS q10, least(htsi + CASE lead WHEN 0 THEN 0.0e0 ELSE (7 + lead) / 2.0e0 END, 100.0e0) AS q90 FROM b)
"""
        + pick(["cell_id", "date", "lead"], ["htsi", "htsi AS q50", "q10", "q90", f"{_pe(59.5)} AS p_warning", f"{_pe(48.5)} AS p_watch"], "c"),
        fx.PANEL,
    ),
)

# --- models ------------------------------------------------------------------------------

SMALL_TREES = forecast.TreeParams(max_iter=3, depth=3, leaf_depth=3, min_rows=20, step=0.3)
LEADS = (1, 2, 3, 4, 5)


def _long(spark, sf, horizons, keep: bool = True):
    """Long feature table; with ``keep`` written once, in the form that holds shared features once."""
    df = cut_lineage(_frame(spark, sf))
    rows = features.build_lead_features(df, climatology_means(df, "1999-12-31"), horizons)
    long = features.unfold_leads(cut_lineage(rows) if keep else rows)
    return long.withColumn("clim_p90_target", F.coalesce("clim_p90_target", F.lit(30.0)))


#: Rows of the long feature table by part: an outcome, a full two-week window.
LONG_SQL = f"""rolled AS (SELECT cell_id, date, count(htsi) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS full14,
  {', '.join(f'lead(htsi, {h}) OVER (PARTITION BY cell_id ORDER BY date) AS y{h}' for h in LEADS)} FROM indexed),
long AS (SELECT h::INTEGER AS horizon, cell_id, date, (date + h)::DATE AS target_date, CASE WHEN date + h <= DATE '{TRAIN_END}' THEN 'train' WHEN date + h <= DATE '{VALID_END}' THEN 'valid' ELSE 'test' END AS part
  FROM rolled, (SELECT unnest([{', '.join(map(str, LEADS))}]) AS h) WHERE full14 = 14 AND [{', '.join(f'y{h}' for h in LEADS)}][h] IS NOT NULL)"""


def model_forecast(spark, sf):
    """Models of five lead times fitted on the early years, later days forecast by all: one row each, and what must hold."""
    long = _long(spark, sf, LEADS)
    models = forecast.train_horizons(long, TRAIN_END, VALID_END, SMALL_TREES)
    out = forecast.predict_all(models, features.temporal_split(long, TRAIN_END, VALID_END)["test"])
    ordered = (F.col("htsi_q10") <= F.col("htsi_q50")) & (F.col("htsi_q50") <= F.col("htsi_q90"))
    likely = F.col("p_warning").between(0, 1) & F.col("p_watch").between(0, 1)
    points = F.col("wbgt_max").isNotNull() & F.col("utci_max").isNotNull() & F.col("wbgt_night_min").isNotNull()
    return out.select("horizon", "cell_id", "date", "target_date", ordered.alias("ordered"), likely.alias("likely"), points.alias("points"))


QUERIES["model_forecast"] = (
    model_forecast,
    with_ctes("SELECT horizon, cell_id, date, target_date, true AS ordered, true AS likely, true AS points FROM long WHERE part = 'test'", *fx.INDEX_CTES, LONG_SQL),
)


def model_verification(spark, sf):
    """Forecasts of two lead times on the validation year against persistence and climatology, with what must hold there."""
    long = _long(spark, sf, (1, 3))
    models = forecast.train_horizons(long, TRAIN_END, VALID_END, SMALL_TREES)
    valid = features.temporal_split(long, TRAIN_END, VALID_END)["valid"]
    found = forecast.verify(cut_lineage(forecast.predict_all(models, valid)))
    sizes = F.create_map(*[F.lit(x) for h, m in models.items() for x in (h, m.sizes["train"])])
    fell = F.create_map(*[F.lit(x) for h, m in models.items() for x in (h, all(min(q.losses) <= q.losses[0] for q in m.quantiles.values()))])
    skill = F.abs(F.col("skill_vs_persistence") - (1 - F.col("mae_model") / F.col("mae_persistence"))) < 1e-12
    return found.select(
        "horizon", F.try_element_at(sizes, "horizon").cast("long").alias("n_train"), F.col("n").alias("n_valid"), (F.col("coverage") >= 0.8).alias("covered"),
        (F.col("band_width") >= 0).alias("wide"), F.try_element_at(fell, "horizon").alias("loss_fell"), skill.alias("skill_holds"),
        F.round("mae_persistence", 4).alias("mae_persistence"),
    )


QUERIES["model_verification"] = (
    model_verification,
    with_ctes(
        """SELECT horizon, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'valid') AS n_valid, true AS covered, true AS wide, true AS loss_fell, true AS skill_holds,
round(avg(abs(h0.htsi - h1.htsi)) FILTER (WHERE part = 'valid'), 4) AS mae_persistence FROM long JOIN indexed h0 USING (cell_id, date) JOIN ahead h1 USING (cell_id, date, horizon) WHERE horizon IN (1, 3) GROUP BY 1""",
        *fx.INDEX_CTES, LONG_SQL,
        "ahead AS (SELECT cell_id, date, 1 AS horizon, lead(htsi, 1) OVER (PARTITION BY cell_id ORDER BY date) AS htsi FROM indexed UNION ALL SELECT cell_id, date, 3, lead(htsi, 3) OVER (PARTITION BY cell_id ORDER BY date) FROM indexed)",
    ),
)


def _drivers(spark, sf):
    """What each feature adds to the one-day median of every later day."""
    rows = features.usable_rows(_long(spark, sf, (1,), keep=False)).withColumn("part", features.split_label(TRAIN_END, VALID_END))
    early = cut_lineage(forecast.assemble(rows.where("part <> 'test'")).select("part", "features", "y_htsi"))
    train, valid = (early.where(F.col("part") == k).drop("part") for k in ("train", "valid"))
    median = forecast.fit_pinball(train, valid, 0.5, SMALL_TREES)
    return cut_lineage(forecast.contributions(forecast.HorizonModels(1, {0.5: median}), rows.where("part = 'test'")))


def row_drivers(spark, sf):
    """Expected forecast and contributions of every row add up to its forecast; the largest drivers come first."""
    known = _drivers(spark, sf)
    total = F.col("expected") + F.aggregate("drivers", F.lit(0.0), lambda a, d: a + d["contribution"])
    top = forecast.row_drivers(known.withColumn("adds_up", F.abs(total - F.col("q50")) < 1e-9))
    sizes = F.transform("drivers", lambda d: F.abs(d["contribution"]))
    return top.select("cell_id", "date", "adds_up", (F.size("drivers") <= 4).alias("few"), (sizes == F.reverse(F.array_sort(sizes))).alias("largest_first"))


QUERIES["row_drivers"] = (
    row_drivers,
    with_ctes("SELECT cell_id, date, true AS adds_up, true AS few, true AS largest_first FROM long WHERE horizon = 1 AND part = 'test'", *fx.INDEX_CTES, LONG_SQL),
)


def model_importance(spark, sf):
    """Mean absolute contribution by feature against the same sum taken row by row."""
    known = _drivers(spark, sf)
    n_features = len(features.feature_columns())
    listed = forecast.importance(known, n_features)
    by_row = known.agg(F.avg(F.aggregate("drivers", F.lit(0.0), lambda a, d: a + F.abs(d["contribution"]))).alias("t"), F.count("*").alias("rows"))
    total = listed.agg(F.struct(F.sum("importance").alias("s"), F.min("importance").alias("low"), F.count("*").alias("k")).alias("x")).scalar()
    both = by_row.withColumn("x", total)
    return both.select("rows", (F.abs(F.col("x.s") - F.col("t")) < 1e-9).alias("adds_up"), (F.col("x.low") >= 0).alias("no_sign"), (F.col("x.k") <= n_features).alias("known"))


QUERIES["model_importance"] = (
    model_importance,
    with_ctes("SELECT count(*) AS rows, true AS adds_up, true AS no_sign, true AS known FROM long WHERE horizon = 1 AND part = 'test'", *fx.INDEX_CTES, LONG_SQL),
)

QUERIES["long_features"] = (
    lambda spark, sf: rounded(_long(spark, sf, (1, 2), keep=False).where("horizon = 2").select("cell_id", "date", "target_date", "spell_days", *[c for c in _DOUBLES if c != "clim_p90_target"])),
    with_ctes(pick(["cell_id", "date", "target_date", "spell_days"], [c for c in _DOUBLES if c != "clim_p90_target"], "feat"), *FEATURE_CTES),
)

QUERIES["model_card"] = (
    lambda spark, sf: serve.model_card(fx.panel(spark, sf).select("date"), TRAIN_END, VALID_END),
    with_ctes(
        f"""SELECT CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date <= DATE '{VALID_END}' THEN 'validation' ELSE 'test' END AS part,
count(*) AS rows, min(date) AS first, max(date) AS last FROM panel GROUP BY 1""",
        fx.PANEL,
    ),
)


def _bundle(spark, sf):
    """Every metric table of the verification, published as one unit with its provenance."""
    v = cut_lineage(_verified(spark, sf))
    coverage = metrics.interval_coverage(v, 1.5, by=["cell_id"])
    tables = {
        "rates": metrics.monthly_rates(v, dict(zip(("index_rule", "temp_rule"), _rules()))),
        "errors": metrics.forecast_error(v),
        "coverage": coverage,
        "warnings": metrics.prf(v, F.col("q50") >= EDGE, _obs()),
        "brier": metrics.brier(v, "p", _obs()),
        "reliability": metrics.reliability(v, "p", _obs()),
        "thresholds": metrics.best_threshold(v, "p", _obs()),
        "disagreement": metrics.rule_disagreement(v, *_rules()),
    }
    path = scratch_path(spark, "bundle")
    documents.write_bundle(tables, documents.metadata("2024-06-01T00:00:00+05:30", BAND_EDGES, {"gate": 0.5}, ExposureResponse()), path)
    return path


def validation_bundle(spark, sf):
    """Monthly rule rates of a bundle with their provenance, read back, one row for each rate."""
    back = documents.read_bundle(spark, _bundle(spark, sf))
    one = back["metadata"].select(F.struct(F.element_at("bandEdges", 2).alias("edge"), F.col("exposureResponse.threshold").alias("threshold"))).scalar()
    out = back["rates"].withColumn("m", one).select(F.col("month").cast("int").alias("month"), "index_rule", "temp_rule", F.col("m.edge").alias("warning_edge"), F.col("m.threshold").alias("threshold"))
    return rounded(out)


QUERIES["validation_bundle"] = (
    validation_bundle,
    with_ctes("SELECT month(date)::INTEGER AS month, round(100 * avg((y >= 48.5e0)::INT), 4) + 0.0e0 AS index_rule, round(100 * avg((t2m_max >= 40.0e0)::INT), 4) + 0.0e0 AS temp_rule, 59.5e0 AS warning_edge, 48.5e0 AS threshold FROM ver GROUP BY 1", *V),
)

QUERIES["bundle_manifest"] = (
    lambda spark, sf: documents.check_bundle(spark, _bundle(spark, sf)),
    with_ctes(
        """SELECT 'rates' AS name, count(DISTINCT month(date)) AS rows, true AS intact FROM ver UNION ALL SELECT 'coverage', count(DISTINCT cell_id), true FROM ver UNION ALL SELECT 'reliability', 10, true
UNION ALL SELECT unnest(['errors', 'warnings', 'brier', 'thresholds', 'disagreement']), 1, true""",
        *V,
    ),
)

# --- streams -----------------------------------------------------------------------------


def _landed(df, spark, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def stream_daily(spark, sf):
    """Hourly rows as a stream; a day appears once the watermark has passed it."""
    m = fx.moist(spark, sf).select("cell_id", "ts_ist", "t2m", "wbgt", "utci")
    out = daily_streams.run_to_table(daily_streams.stream_daily(_landed(m, spark, "hourly"), ("t2m", "wbgt", "utci")), "daily")
    return rounded(out.select("cell_id", "date", "t2m_max", "wbgt_mean", "utci_min", "wbgt_degree_hours", "wbgt_hours_above_28"))


def _daily_sql():
    from heatgrid.plans.weather import DAILY_SQL

    return DAILY_SQL


QUERIES["stream_daily"] = (
    stream_daily,
    with_ctes(
        pick(["cell_id", "date", "wbgt_hours_above_28"], ["t2m_max", "wbgt_mean", "utci_min", "wbgt_degree_hours"], "daily", "WHERE date + INTERVAL 1 DAY <= (SELECT max(ts_ist) - INTERVAL 6 HOUR FROM moist)"),
        fx.HOURLY, fx.MOIST, _daily_sql(),
    ),
)


def stream_nights(spark, sf):
    m = fx.moist(spark, sf).select("cell_id", "ts_ist", "t2m", "wbgt")
    out = daily_streams.run_to_table(daily_streams.stream_nights(_landed(m, spark, "hourly"), ("t2m", "wbgt")), "nights")
    return rounded(out.select("cell_id", "date", "t2m_night_min", "wbgt_night_min"))


QUERIES["stream_nights"] = (
    stream_nights,
    with_ctes(
        pick(["cell_id", "date"], ["t2m_night_min", "wbgt_night_min"], "nights", "WHERE date + INTERVAL 22 HOUR <= (SELECT max(ts_ist) - INTERVAL 6 HOUR FROM moist WHERE hour(ts_ist) >= 22 OR hour(ts_ist) < 6)"),
        fx.HOURLY, fx.MOIST, _daily_sql(),
    ),
)


def nwp_daily(spark, sf):
    """Forecast responses nested from the events, unfolded and indexed per day."""
    h = fx.hourly(spark, sf)
    hour = F.date_trunc("hour", "ts_utc")
    by_hour = h.groupBy("cell_id", "lat", "lon", hour.alias("u")).agg(F.avg("T2M").alias("t"), F.avg("T2MDEW").alias("d"), F.avg("PS").alias("p"), F.avg("WS10M").alias("w"), F.avg("ALLSKY_SFC_SW_DWN").alias("s"))
    day = F.to_date("u")
    cols = {"time": F.date_format(F.col("u") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm"), "temperature_2m": F.when(F.col("cell_id") % 10 != 3, F.col("t")), "dew_point_2m": F.col("d"), "surface_pressure": F.col("p") * 10.0, "wind_speed_10m": F.col("w"), "shortwave_radiation": F.col("s")}
    entry = F.struct(F.col("u"), *[c.alias(k) for k, c in cols.items()])
    nested = by_hour.groupBy("cell_id", "lat", "lon", day.alias("day")).agg(F.array_sort(F.collect_list(entry)).alias("h"))
    responses = nested.select("cell_id", "lat", "lon", F.struct(*[F.col(f"h.{k}").alias(k) for k in cols]).alias("hourly"))
    rows = weather_source.nwp_rows(responses)
    return rounded(rows.groupBy("cell_id", F.to_date("ts_ist").alias("date")).agg(F.count("*").alias("n"), F.avg("T2M").alias("t2m"), F.avg("PS").alias("ps")))


QUERIES["nwp_daily"] = (
    nwp_daily,
    with_ctes(
        """, hh AS (SELECT cell_id, date_trunc('hour', ts_utc) AS u, avg(t2m) AS t, avg(ps) AS p FROM hourly WHERE cell_id % 10 <> 3 GROUP BY 1, 2)
SELECT cell_id, (u + INTERVAL 330 MINUTE)::DATE AS date, count(*) AS n, round(avg(t), 4) + 0.0e0 AS t2m, round(avg(p), 4) + 0.0e0 AS ps FROM hh GROUP BY 1, 2""",
        fx.HOURLY,
    ),
)
