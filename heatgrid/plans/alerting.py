"""Alert levels, messages, siting and read queries over forecasts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from heatgrid.functions import text
from heatgrid.operators import alerts, mortality, nearest, places, risk, serve, siting
from heatgrid.params import BAND_EDGES, AlertParams, ExposureResponse
from heatgrid.plans import fixtures as fx
from heatgrid.plans.common import Query, pick, rounded, table, with_ctes
from heatgrid.plans.people import LEVEL_SQL, _profile_sql
from heatgrid.session import cut_lineage, scratch_path
from heatgrid.sources import documents, geojson

QUERIES: dict[str, Query] = {}

POLICY = AlertParams(thresholds={1: (0.85, 0.75), 2: (0.90, 0.80), 3: (0.95, 0.80)}, watch_probability=0.93)
EAGER = AlertParams(thresholds={1: (0.85, 0.75), 2: (0.90, 0.80)}, lead_days=2, margin=3.0, watch_probability=0.93)
THERMOMETER = AlertParams(min_dwell_days=1, margin=0.0, lead_days=0, watch_lead_days=0)

_LEVEL = "CASE {b} WHEN 'Emergency' THEN 3 WHEN 'Warning' THEN 2 WHEN 'Watch' THEN 1 ELSE 0 END"
_NAME = "['Normal', 'Watch', 'Warning', 'Emergency'][{l} + 1]"

DAYS_SQL = (
    "days AS (SELECT as_of, scope, place_id, "
    + ", ".join(f"max({c}) FILTER (WHERE lead = {k}) AS {n}{k}" for k in range(6) for c, n in (("htsi", "h"), ("band", "b"), ("p_warning", "w"), ("p_watch", "a"), ("q10", "lo"), ("q90", "hi")))
    + " FROM place_days GROUP BY 1, 2, 3)"
)


def target_sql(cfg: AlertParams, name: str = "targets") -> str:
    """Target level per issue date from the pivoted days."""
    levels, reasons = [_LEVEL.format(b="b0")], ["'Observed ' || b0 || ' today (HTSI ' || printf('%.1f', h0) || ')'"]
    for k in range(1, cfg.lead_days + 1):
        own = _LEVEL.format(b=f"b{k}")
        why = f"'Forecast ' || b{k} || ' on D+{k} (HTSI ' || printf('%.1f', h{k}) || ', 80% band ' || printf('%.1f', lo{k}) || '-' || printf('%.1f', hi{k}) || ')'"
        level = own
        if k in cfg.thresholds:
            w, a = cfg.thresholds[k]
            likely = "'{n}-level heat likely on D+{k}: P = ' || round({c} * 100)::INTEGER || '% against a validated trigger of {t}%'"
            level = f"CASE WHEN w{k} >= {w}e0 AND {own} < 2 THEN 2 WHEN a{k} >= {a}e0 AND {own} < 1 THEN 1 ELSE {own} END"
            why = (
                f"CASE WHEN w{k} >= {w}e0 AND {own} < 2 THEN {likely.format(n='Warning', k=k, c=f'w{k}', t=round(w * 100))} "
                f"WHEN a{k} >= {a}e0 AND {own} < 1 THEN {likely.format(n='Watch', k=k, c=f'a{k}', t=round(a * 100))} ELSE {why} END"
            )
        levels.append(f"CASE WHEN b{k} IS NULL THEN -1 ELSE {level} END")
        reasons.append(why)
    cuts = {k: cfg.thresholds.get(k, (cfg.watch_probability,))[0] for k in range(cfg.lead_days + 1, cfg.watch_lead_days + 1)}
    ahead = "CASE " + " ".join(f"WHEN w{k} >= {c}e0 THEN {k}" for k, c in cuts.items()) + " END" if cuts else "NULL::INTEGER"
    cut_pct = "CASE ahead " + " ".join(f"WHEN {k} THEN {round(c * 100)}" for k, c in cuts.items()) + " END" if cuts else "0"
    at = lambda c: "CASE tl " + " ".join(f"WHEN {k} THEN {c}{k}" for k in range(6)) + " END"
    first = "CASE " + " ".join(f"WHEN l{k} = top THEN {k}" for k in range(len(levels))) + " END"
    why = "CASE tl0 " + " ".join(f"WHEN {k} THEN {r}" for k, r in enumerate(reasons)) + " END"
    return f"""{name}0 AS (SELECT *, {', '.join(f'{x} AS l{k}' for k, x in enumerate(levels))}, {ahead} AS ahead FROM days),
{name}1 AS (SELECT *, greatest({', '.join(f'l{k}' for k in range(len(levels)))}) AS top FROM {name}0),
{name}2 AS (SELECT *, {first} AS tl0, top < 1 AND ahead IS NOT NULL AS quiet FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN quiet THEN 1 ELSE top END AS target, CASE WHEN quiet THEN ahead ELSE tl0 END AS tl FROM {name}2),
{name} AS (SELECT as_of, scope, place_id, target, tl, h0, b0, {at('h')} AS th, {at('b')} AS tb,
  CASE WHEN quiet THEN 'Warning-level heat possible on D+' || ahead || ' (P = ' || round(({at('w')}) * 100)::INTEGER || '%, trigger ' || ({cut_pct}) || '%)' ELSE {why} END AS reason FROM {name}3)"""


def state_sql(cfg: AlertParams, targets: str = "targets", name: str = "states", until: str | None = None) -> str:
    """Recursion over the issue dates of every place."""
    limit = f"WHERE as_of <= DATE '{until}'" if until else ""
    bar = "CASE s.level " + " ".join(f"WHEN {i} THEN {e - cfg.margin}e0" for i, e in enumerate(BAND_EDGES, start=1)) + " END"
    below = f"CASE WHEN t.target < s.level AND t.h0 < {bar} THEN s.below + 1 ELSE 0 END"
    fall = f"(t.target < s.level AND {below} >= {cfg.min_dwell_days} AND date_diff('day', s.since, t.as_of) >= {cfg.min_dwell_days})"
    moved = f"(t.target > s.level OR {fall})"
    return f"""{name}_seq AS (SELECT *, row_number() OVER (PARTITION BY scope, place_id ORDER BY as_of) AS i FROM {targets} {limit}),
{name}_all AS (
  SELECT scope, place_id, 0::BIGINT AS i, as_of, 0 AS level, as_of AS since, 0 AS below, 0 AS was, false AS moved, 0 AS streak FROM {name}_seq WHERE i = 1
  UNION ALL
  SELECT s.scope, s.place_id, t.i, t.as_of, CASE WHEN t.target > s.level THEN t.target WHEN {fall} THEN s.level - 1 ELSE s.level END,
    CASE WHEN {moved} THEN t.as_of ELSE s.since END, CASE WHEN {moved} THEN 0 ELSE {below} END, s.level, {moved}, {below}
  FROM {name}_all s JOIN {name}_seq t ON t.scope = s.scope AND t.place_id = s.place_id AND t.i = s.i + 1),
{name} AS (SELECT a.*, t.target, t.tl, t.th, t.tb, t.reason FROM {name}_all a JOIN {name}_seq t USING (scope, place_id, i) QUALIFY row_number() OVER (PARTITION BY a.scope, a.place_id ORDER BY a.i DESC) = 1),
{name}_moves AS (SELECT a.scope, a.place_id, a.as_of AS date, a.was, a.level, CASE WHEN a.level > a.was THEN 'escalate' ELSE 'de-escalate' END AS kind,
  CASE WHEN a.level > a.was THEN t.reason ELSE 'HTSI below ' || printf('%.1f', CASE a.was {' '.join(f'WHEN {i} THEN {e - cfg.margin}e0' for i, e in enumerate(BAND_EDGES, start=1))} END) || ' for ' || a.streak || ' consecutive days' END AS reason
  FROM {name}_all a JOIN {name}_seq t USING (scope, place_id, i) WHERE a.moved)"""


BASE = (fx.PANEL, fx.PLACE_DAYS)
STATE = (*BASE, DAYS_SQL, target_sql(POLICY), state_sql(POLICY))


def _days(spark, sf):
    """Nested days, written once: levels, scorecards and changes go over them several times."""
    return cut_lineage(alerts.as_days(fx.place_days(spark, sf)))


def _targets(spark, sf):
    return alerts.target_level(_days(spark, sf), POLICY)


def _states(spark, sf):
    return alerts.with_alert_ids(alerts.run_state(_targets(spark, sf), POLICY))


def daily_levels(spark, sf):
    targets = cut_lineage(_targets(spark, sf))
    return alerts.previous_level(alerts.daily_levels(targets.select("scope", "place_id", "as_of"), alerts.run_state(targets, POLICY)))


def changed_levels(spark, sf):
    targets = cut_lineage(_targets(spark, sf))
    both = alerts.changed_levels(alerts.replay(targets, T1, POLICY), alerts.replay(targets, T2, POLICY))
    return both.select("scope", "place_id", F.col("from").alias("from_level"), F.col("to").alias("to_level"))


QUERIES["target_levels"] = (
    lambda spark, sf: _targets(spark, sf).select("as_of", "scope", "place_id", "target_level", "target_band", "trigger_lead", "reason"),
    with_ctes(f"SELECT as_of, scope, place_id, target AS target_level, {_NAME.format(l='target')} AS target_band, tl AS trigger_lead, reason FROM targets", *BASE, DAYS_SQL, target_sql(POLICY)),
)

QUERIES["alert_states"] = (
    lambda spark, sf: _states(spark, sf).select("scope", "place_id", "level", "band", "since", "below_count", "as_of", "alert_id"),
    with_ctes(
        f"SELECT scope, place_id, level, {_NAME.format(l='level')} AS band, since, below AS below_count, as_of, CASE WHEN level > 0 THEN 'HEAT-' || scope || '-' || place_id || '-' || since END AS alert_id FROM states",
        *STATE, recursive=True,
    ),
)

QUERIES["alert_transitions"] = (
    lambda spark, sf: alerts.transitions(alerts.run_state(_targets(spark, sf), POLICY)).select("scope", "place_id", "date", F.col("from").alias("from_level"), F.col("to").alias("to_level"), "kind", "reason"),
    with_ctes(f"SELECT scope, place_id, date, {_NAME.format(l='was')} AS from_level, {_NAME.format(l='level')} AS to_level, kind, reason FROM states_moves", *STATE, recursive=True),
)

QUERIES["daily_levels"] = (
    daily_levels,
    with_ctes("SELECT scope, place_id, as_of, level, lag(level) OVER (PARTITION BY scope, place_id ORDER BY as_of) AS prev_level FROM states_all WHERE i > 0", *STATE, recursive=True),
)


def policy_scorecard(spark, sf):
    return rounded(alerts.policy_scorecard(_days(spark, sf), {"default": POLICY, "eager": EAGER, "thermometer": THERMOMETER}))


def _score_sql(policy: str, states: str, targets: str) -> str:
    return f"""SELECT count(*) AS place_days, round(100.0e0 * avg((level >= 2)::INT), 4) + 0.0e0 AS warning_plus_pct, round(100.0e0 * avg((level >= 1)::INT), 4) + 0.0e0 AS watch_plus_pct,
round(100.0e0 * count(*) FILTER (WHERE hot AND prev >= 1) / count(*) FILTER (WHERE hot), 4) + 0.0e0 AS warned_day_before_pct,
round(100.0e0 * count(*) FILTER (WHERE hot AND prev >= 2) / count(*) FILTER (WHERE hot), 4) + 0.0e0 AS warning_day_before_pct,
round(count(*) FILTER (WHERE level <> coalesce(prev, 0)) / count(*) FILTER (WHERE prev IS NULL)::DOUBLE, 4) + 0.0e0 AS changes_per_place, '{policy}' AS policy
FROM (SELECT a.level, lag(a.level) OVER w AS prev, t.b0 IN ('Warning', 'Emergency') AND lag(a.level) OVER w IS NOT NULL AS hot
  FROM {states}_all a JOIN {targets} t ON t.scope = a.scope AND t.place_id = a.place_id AND t.as_of = a.as_of WHERE a.i > 0 WINDOW w AS (PARTITION BY a.scope, a.place_id ORDER BY a.as_of))"""


QUERIES["policy_scorecard"] = (
    policy_scorecard,
    with_ctes(
        " UNION ALL ".join(_score_sql(p, s, t) for p, s, t in (("default", "states", "targets"), ("eager", "states_e", "targets_e"), ("thermometer", "states_t", "targets_t"))),
        *STATE, target_sql(EAGER, "targets_e"), state_sql(EAGER, "targets_e", "states_e"), target_sql(THERMOMETER, "targets_t"), state_sql(THERMOMETER, "targets_t", "states_t"),
        recursive=True,
    ),
)

T1, T2 = "2024-05-01", "2024-05-20"
QUERIES["changed_levels"] = (
    changed_levels,
    with_ctes(
        f"SELECT a.scope, a.place_id, {_NAME.format(l='a.level')} AS from_level, {_NAME.format(l='b.level')} AS to_level FROM s1 a JOIN s2 b USING (scope, place_id) WHERE a.level <> b.level",
        *BASE, DAYS_SQL, target_sql(POLICY), state_sql(POLICY, name="s1", until=T1), state_sql(POLICY, name="s2", until=T2), recursive=True,
    ),
)


def _with_place(states, spark, sf):
    """States with the city, district and today's risk of the place."""
    today = fx.place_days(spark, sf).where("lead = 0").select("scope", "place_id", "as_of", "city", "district", "name", "mri", "htsi")
    return states.join(today, ["scope", "place_id", "as_of"])


ACTIVE_SQL = "act AS (SELECT s.*, p.city, p.district, p.name, p.mri, p.htsi, 'HEAT-' || s.scope || '-' || s.place_id || '-' || s.since AS alert_id FROM states s JOIN place_days p ON p.scope = s.scope AND p.place_id = s.place_id AND p.as_of = s.as_of AND p.lead = 0)"

QUERIES["active_alerts"] = (
    lambda spark, sf: rounded(alerts.active_alerts(_with_place(_states(spark, sf), spark, sf), scope="ward", min_level=1).select("place_id", "level", "band", "mri", "city")),
    with_ctes(f"SELECT place_id, level, {_NAME.format(l='level')} AS band, round(mri, 4) + 0.0e0 AS mri, city FROM act WHERE level >= 1 AND scope = 'ward'", *STATE, ACTIVE_SQL, recursive=True),
)

QUERIES["level_counts"] = (
    lambda spark, sf: alerts.level_counts(_states(spark, sf)),
    with_ctes("SELECT b AS band, count(s.level) AS n FROM (VALUES ('Normal', 0), ('Watch', 1), ('Warning', 2), ('Emergency', 3)) v(b, l) LEFT JOIN states s ON s.level = v.l GROUP BY 1", *STATE, recursive=True),
)

QUERIES["transition_history"] = (
    lambda spark, sf: alerts.transition_history(alerts.transitions(_states(spark, sf)), 50).select("scope", "place_id", "date", "kind"),
    with_ctes("SELECT scope, place_id, date, kind FROM states_moves ORDER BY date DESC, scope, place_id LIMIT 50", *STATE, recursive=True),
)

# --- subscribers ---------------------------------------------------------------------


def _subs(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        (k % 3 + 1).cast("int").alias("min_level"),
        F.when(k % 2 == 0, F.array((k % 40).cast("string"), (k % 7).cast("string"))).alias("wards"),
        F.when(k % 3 == 0, F.array((k % 10 + 1).cast("string"))).alias("districts"),
        F.array((F.col("c_nationkey") % 9).cast("string")).alias("cities"),
        F.when(k % 4 == 0, "webhook").when(k % 4 == 1, "whatsapp").otherwise("sms").alias("channel"),
        F.col("c_name").alias("address"),
    )


SUBS_SQL = """subs AS (SELECT c_custkey AS id, (c_custkey % 3 + 1)::INTEGER AS min_level, c_custkey % 2 = 0 AS has_wards, c_custkey % 3 = 0 AS has_district, c_custkey AS k, (c_nationkey % 9)::VARCHAR AS city FROM customer),
matches AS (SELECT a.alert_id, s.id AS subscription_id FROM act a, subs s WHERE a.level >= s.min_level AND (
  (a.scope = 'ward' AND s.has_wards AND (a.place_id = (s.k % 40)::VARCHAR OR a.place_id = (s.k % 7)::VARCHAR))
  OR (a.scope = 'district' AND s.has_district AND a.district = (s.k % 10 + 1)::VARCHAR) OR (a.scope = 'ward' AND a.city = s.city)) AND a.level > 0)"""


def _matches(spark, sf):
    """Pairs of the active alerts, which are written once: few, after many steps."""
    active = cut_lineage(_with_place(_states(spark, sf), spark, sf).where("level > 0").select("alert_id", "scope", "place_id", "city", "district", "level"))
    return alerts.find_matches(active, _subs(spark, sf))


QUERIES["subscription_matches"] = (lambda spark, sf: _matches(spark, sf).pairs(), with_ctes("SELECT alert_id, subscription_id FROM matches", *STATE, ACTIVE_SQL, SUBS_SQL, recursive=True))


def dispatch(spark, sf):
    """Pairs still owed when a quarter was delivered and an eighth failed."""
    m = _matches(spark, sf)
    log = m.pairs().where("subscription_id % 4 = 0").withColumn("status", F.when(F.col("subscription_id") % 8 == 0, "failed").otherwise("sent"))
    return alerts.undelivered(m, log)


QUERIES["dispatch"] = (dispatch, with_ctes("SELECT alert_id, subscription_id FROM matches WHERE subscription_id % 8 <> 4", *STATE, ACTIVE_SQL, SUBS_SQL, recursive=True))


def acknowledgements(spark, sf):
    """Alerts with acknowledged actions and their last transition."""
    st = _states(spark, sf).where("level > 0")
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).cast("string").alias("place_id"), F.col("o_orderpriority").alias("action")).where("action NOT LIKE '5%' OR place_id LIKE '1%'")
    acks = st.select("alert_id", "place_id").join(o, "place_id").select("alert_id", "action")
    out = alerts.with_acks(st.drop("transitions"), acks, alerts.transitions(st))
    return out.select("alert_id", F.array_join("acks", "|").alias("acks"), "last_transition")


QUERIES["acknowledgements"] = (
    acknowledgements,
    with_ctes(
        """, k AS (SELECT DISTINCT alert_id, o_orderpriority AS a FROM act JOIN orders ON place_id = (o_custkey % 40)::VARCHAR WHERE (o_orderpriority NOT LIKE '5%' OR place_id LIKE '1%') AND level > 0),
kk AS (SELECT alert_id, string_agg(a, '|' ORDER BY a) AS acks FROM k GROUP BY 1),
lm AS (SELECT scope, place_id, arg_max(kind, date) AS last_transition FROM states_moves GROUP BY 1, 2)
SELECT alert_id, coalesce(acks, '') AS acks, last_transition FROM act LEFT JOIN kk USING (alert_id) LEFT JOIN lm USING (scope, place_id) WHERE level > 0""",
        *STATE, ACTIVE_SQL, recursive=True,
    ),
)


def action_checklist(spark, sf):
    st = _states(spark, sf).where("level > 0")
    actions = table(spark, sf, "orders").select(F.element_at(F.array(*[F.lit(x) for x in ("Watch", "Warning", "Emergency")]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("band"), F.col("o_orderpriority").alias("action")).distinct()
    acks = st.where("cast(place_id AS int) % 4 = 0").join(actions, "band").where("action LIKE '1%'").select("alert_id", "action")
    return alerts.checklist(st, actions, acks).select("alert_id", "band", "action", "done")


QUERIES["action_checklist"] = (
    action_checklist,
    with_ctes(
        f"""SELECT alert_id, band, action, place_id::INTEGER % 4 = 0 AND action LIKE '1%' AS done FROM (SELECT *, {_NAME.format(l='level')} AS band FROM act WHERE level > 0)
JOIN (SELECT DISTINCT ['Watch', 'Warning', 'Emergency'][o_orderkey % 3 + 1] AS band, o_orderpriority AS action FROM orders) USING (band)""",
        *STATE, ACTIVE_SQL, recursive=True,
    ),
)


def alert_codes(spark, sf):
    """Identifiers, alert-standard codes and masked addresses."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    level = F.element_at(F.array(*[F.lit(x) for x in ("Normal", "Watch", "Warning", "Emergency")]), (F.col("event_id") % 4 + 1).cast("int"))
    lead = (F.col("event_id") % 6).cast("int")
    return e.select(
        "event_id",
        text.alert_id("HEAT", F.lit("ward"), F.col("user_id"), F.to_date("ts")).alias("alert_id"),
        text.severity(level).alias("severity"),
        text.response_type(level).alias("response"),
        text.urgency(lead).alias("urgency"),
        text.certainty(lead, F.when(F.col("event_id") % 3 != 0, F.col("value") / 20.0)).alias("certainty"),
        text.explained_horizon(lead).alias("horizon"),
        text.mask_address(F.concat("event_type", F.lit("@"), F.col("user_id").cast("string"))).alias("masked"),
        text.xml_escape(F.concat(F.lit("<a & 'b' \">"), "event_type")).alias("escaped"),
        text.localise_digits(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "or").otherwise("en")).alias("digits"),
    )


QUERIES["alert_codes"] = (
    alert_codes,
    """WITH e AS (SELECT *, ['Normal', 'Watch', 'Warning', 'Emergency'][event_id % 4 + 1] AS level, event_id % 6 AS lead, event_type || '@' || user_id AS addr FROM events)
SELECT event_id, 'HEAT-ward-' || user_id || '-' || ts::DATE AS alert_id, CASE level WHEN 'Watch' THEN 'Moderate' WHEN 'Warning' THEN 'Severe' WHEN 'Emergency' THEN 'Extreme' ELSE 'Minor' END AS severity,
CASE level WHEN 'Watch' THEN 'Prepare' WHEN 'Warning' THEN 'Avoid' WHEN 'Emergency' THEN 'Shelter' ELSE 'Monitor' END AS response,
CASE WHEN lead <= 0 THEN 'Immediate' WHEN lead <= 2 THEN 'Expected' ELSE 'Future' END AS urgency,
CASE WHEN lead <= 0 THEN 'Observed' WHEN event_id % 3 <> 0 AND value / 20.0e0 >= 0.5e0 THEN 'Likely' ELSE 'Possible' END AS certainty,
CASE WHEN lead = 0 THEN NULL WHEN lead <= 1 THEN 1 WHEN lead <= 3 THEN 3 ELSE 5 END AS horizon, repeat('*', length(addr) - 4) || right(addr, 4) AS masked,
'&lt;a &amp; &apos;b&apos; &quot;&gt;' || event_type AS escaped, CASE WHEN event_id % 2 = 0 THEN translate(event_id::VARCHAR, '0123456789', '୦୧୨୩୪୫୬୭୮୯') ELSE event_id::VARCHAR END AS digits FROM e""",
)

# Small message dictionary; a deployment reads its own from files.
_TEMPLATES = [
    (lang, band, f"{band}-{lang}", "{level} for {place}", "{place} {day}: {htsi}/{wbgt}", "{htsi} ({level}) {day}, night {night}, excess {excess} ({excessLow}-{excessHigh})", "today", "tomorrow", "on {date}")
    for lang in ("en", "or")
    for band in ("Normal", "Watch", "Warning", "Emergency")
]
_TEMPLATE_COLS = "language, band, label, headline, sms, description, today, tomorrow, on_date"
_AUDIENCES = [
    (lang, who, band, [f"{who} drink water", "visits {ed}", "{unknown}stay in"])
    for lang in ("en", "or")
    for who in ("public", "hospitals", "municipal")
    for band in ("Normal", "Watch", "Warning", "Emergency")
]


def _dictionaries(spark):
    t = spark.createDataFrame(_TEMPLATES, ", ".join(f"{c.strip()} string" for c in _TEMPLATE_COLS.split(",")))
    a = spark.createDataFrame(_AUDIENCES, "language string, audience string, band string, actions array<string>")
    return t, a.withColumn("actions", F.transform("actions", lambda x: F.replace(x, F.lit("{unknown}"), F.lit(""))))


def _alert_days(spark, sf):
    """Every place-day as a message candidate with a unique id."""
    d = fx.place_days(spark, sf)
    return d.withColumn("alert_id", F.concat_ws("-", "scope", "place_id", F.col("as_of").cast("string"), F.col("lead").cast("string")))


def advisories(spark, sf):
    t, a = _dictionaries(spark)
    out = alerts.render_advisories(_alert_days(spark, sf), t, a)
    return out.select("alert_id", "language", "audience", "headline", "sms", "description", F.array_join("actions", "|").alias("actions"))


def _fx(c: str, d: int) -> str:
    r = f"(round({c}, {d}) + 0.0e0)"
    return f"CASE WHEN {r} = floor({r}) THEN printf('%.0f', {r}) ELSE printf('%.{d}f', {r}) END"


def _local(x: str) -> str:
    return f"CASE WHEN language = 'or' THEN translate({x}, '0123456789', '୦୧୨୩୪୫୬୭୮୯') ELSE {x} END"


ADVISORY_SQL = f"""langs(language) AS (VALUES ('en'), ('or')),
adv0 AS (SELECT *, scope || '-' || place_id || '-' || as_of || '-' || lead AS alert_id, band || '-' || language AS label FROM place_days, langs),
adv AS (SELECT *, {_local(_fx('htsi', 0))} AS xh, {_local(_fx('wbgt', 1))} AS xw, {_local(_fx('night_wbgt', 1))} AS xn, {_local(_fx('excess_deaths', 1))} AS xe, {_local(_fx('excess_low', 1))} AS xl,
  {_local(_fx('excess_high', 1))} AS xg, {_local(_fx('ed_surge', 0))} AS xd, CASE lead WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE 'on ' || {_local('date::VARCHAR')} END AS xday FROM adv0)"""
QUERIES["advisories"] = (
    advisories,
    with_ctes(
        """SELECT alert_id, language, audience, CASE WHEN band <> 'Normal' THEN label || ' for ' || name END AS headline, CASE WHEN band <> 'Normal' THEN name || ' ' || xday || ': ' || xh || '/' || xw END AS sms,
xh || ' (' || label || ') ' || xday || ', night ' || xn || ', excess ' || xe || ' (' || xl || '-' || xg || ')' AS description,
CASE WHEN band <> 'Normal' THEN audience || ' drink water|visits ' || xd || '|stay in' ELSE '' END AS actions FROM adv, (VALUES ('public'), ('hospitals'), ('municipal')) v(audience)""",
        *BASE, ADVISORY_SQL,
    ),
)


def alert_documents(spark, sf):
    """One alert document per place-day above Normal; those of later leads update the one before."""
    t, a = _dictionaries(spark)
    days = _alert_days(spark, sf).where("band <> 'Normal'")
    ready = days.withColumns(
        {"msg_type": F.when(F.col("lead") > 0, "Update"),
         "references": F.when(F.col("lead") > 0, F.concat(F.lit("alerts@example.org,"), F.concat_ws("-", "scope", "place_id", F.col("as_of").cast("string"), (F.col("lead") - 1).cast("string")), F.lit(","), F.col("as_of").cast("string"), F.lit("T06:00:00+05:30"))),
         "sent": F.concat(F.col("as_of").cast("string"), F.lit("T06:00:00+05:30")), "ring": F.when(F.col("scope") == "ward", F.array(F.array(F.lit(85.8), F.lit(20.3)), F.array(F.lit(85.81), F.lit(20.3)), F.array(F.lit(85.81), F.lit(20.31))))}
    )
    adv = alerts.render_advisories(ready, t, a)
    docs = alerts.alert_documents(ready, adv, "alerts@example.org", "Heat Early Warning", languages=("en", "or"))
    count = lambda tag: F.size(F.split("document", tag)) - 1
    return docs.select(
        "alert_id", count("<info>").alias("infos"), count("<polygon>20.30000,85.80000 20.30000,85.81000 20.31000,85.81000 20.30000,85.80000</polygon>").alias("polygons"),
        F.regexp_extract("document", "<severity>(.*?)</severity>", 1).alias("severity"),
        F.regexp_extract("document", "<onset>(.*?)</onset>", 1).alias("onset"),
        F.regexp_extract("document", "<headline>(.*?)</headline>", 1).alias("headline"),
        F.regexp_extract("document", "<msgType>(.*?)</msgType>", 1).alias("msg_type"),
        F.regexp_extract("document", "<references>(.*?)</references>", 1).alias("refs"),
    )


QUERIES["alert_documents"] = (
    alert_documents,
    with_ctes(
        """SELECT alert_id, 2 AS infos, CASE WHEN scope = 'ward' THEN 2 ELSE 0 END AS polygons, CASE band WHEN 'Watch' THEN 'Moderate' WHEN 'Warning' THEN 'Severe' ELSE 'Extreme' END AS severity,
date || 'T00:00:00+05:30' AS onset, label || ' for ' || name AS headline, CASE WHEN lead > 0 THEN 'Update' ELSE 'Alert' END AS msg_type,
CASE WHEN lead > 0 THEN 'alerts@example.org,' || scope || '-' || place_id || '-' || as_of || '-' || (lead - 1) || ',' || as_of || 'T06:00:00+05:30' ELSE '' END AS refs FROM adv WHERE band <> 'Normal' AND language = 'en'""",
        *BASE, ADVISORY_SQL,
    ),
)


def action_plans(spark, sf):
    """The plan of every level that has alerts: agencies with their actions, and how many alerts ask for them."""
    _, a = _dictionaries(spark)
    counts = cut_lineage(_states(spark, sf).where("level > 0").groupBy("band").agg(F.count("*").alias("alerts")))
    out = None
    for band in ("Watch", "Warning", "Emergency"):
        plan = alerts.action_plan(a, band, agencies=("public", "hospitals", "municipal")).select(F.lit(band).alias("band"), F.explode("plan").alias("audience", "actions"))
        out = plan if out is None else out.unionByName(plan)
    return out.join(counts, "band").select("band", "audience", F.array_join("actions", "|").alias("actions"), "alerts")


def _plan_rows() -> str:
    rows = [f"('{b}', '{a}', '{'|'.join(x.replace('{unknown}', '') for x in actions)}')" for lang, a, b, actions in _AUDIENCES if lang == "en"]
    return f"plans(band, audience, actions) AS (VALUES {', '.join(rows)})"


QUERIES["action_plans"] = (
    action_plans,
    with_ctes(
        f"SELECT band, audience, actions, alerts FROM plans JOIN (SELECT {_NAME.format(l='level')} AS band, count(*) AS alerts FROM act WHERE level > 0 GROUP BY 1) USING (band)",
        *STATE, ACTIVE_SQL, _plan_rows(), recursive=True,
    ),
)

# --- siting -----------------------------------------------------------------------------


def _city_wards(spark, sf):
    """Wards packed into their city's few kilometres."""
    w = fx.wards(spark, sf)
    k = F.col("ward_id")
    return w.select(
        "city", "ward_id", (F.lit(20.0) + F.col("city") * F.lit(0.2) + (k * 37 % 101) * F.lit(0.0007)).alias("lat"),
        (F.lit(85.0) + (k * 53 % 103) * F.lit(0.0007)).alias("lon"), "population", "vuln_mult",
        (F.greatest(F.lit(0.0), F.lit(3.0) - k % 17) / F.lit(7.0)).alias("excess"),
    ).withColumns(
        {"low": F.col("excess") * F.lit(0.5), "high": F.col("excess") * F.lit(1.7), "demand": F.col("excess") + F.lit(1e-6) * F.col("population") * F.col("vuln_mult")}
    )


CITY_SQL = """cw AS (SELECT city, ward_id, 20.0e0 + city * 0.2e0 + (ward_id * 37 % 101) * 0.0007e0 AS lat, 85.0e0 + (ward_id * 53 % 103) * 0.0007e0 AS lon,
  greatest(0.0e0, 3.0e0 - ward_id % 17) / 7.0e0 AS excess FROM wards),
pairs AS (SELECT a.city, a.ward_id AS site_id, b.ward_id, 2 * 6371.0e0 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) AS km
  FROM cw a JOIN cw b ON a.city = b.city)"""

SPOT_SQL = """spots AS (SELECT city, lat, lon, min(ward_id) AS spot, count(*) AS n FROM cw GROUP BY 1, 2, 3),
spot_pairs AS (SELECT a.city, a.spot AS site_spot, b.spot AS ward_spot, a.n AS n_sites, b.n AS n_wards,
  2 * 6371.0e0 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) AS km
  FROM spots a JOIN spots b ON a.city = b.city AND abs(a.lat - b.lat) < 0.02)"""

QUERIES["coverage_pairs"] = (
    lambda spark, sf: rounded(siting.coverage_pairs(_city_wards(spark, sf), _city_wards(spark, sf), 1.5, site_id="ward_id")),
    with_ctes("SELECT city, site_id, ward_id, round(km, 4) + 0.0e0 AS distance_km FROM pairs WHERE km <= 1.5e0", fx.WARDS, CITY_SQL),
)

QUERIES["coverage_members"] = (
    lambda spark, sf: siting.coverage(_city_wards(spark, sf), 1.5)[1],
    with_ctes("SELECT cw.city, spot, ward_id FROM cw JOIN spots USING (city, lat, lon)", fx.WARDS, CITY_SQL, SPOT_SQL),
)

ROUNDS = 5


def _plan_wards(spark, sf):
    """Wards whose demand is a whole number, so that gains add up alike in any order."""
    return _city_wards(spark, sf).withColumn("demand", (F.col("ward_id") * 7 % 23 + 1).cast("double"))


def _greedy_sql() -> str:
    """The greedy rounds, one after another, over wards at distinct spots."""
    parts = [
        "cp AS MATERIALIZED (SELECT *, (ward_id * 7 % 23 + 1)::DOUBLE AS demand FROM cw)",
        "sp AS MATERIALIZED (SELECT city, lat, lon, min(ward_id) AS ward_id, sum(demand) AS demand FROM cp GROUP BY 1, 2, 3)",
        "l1 AS MATERIALIZED (SELECT a.city, a.ward_id AS site, b.ward_id AS w, b.demand FROM sp a JOIN sp b ON a.city = b.city AND abs(a.lat - b.lat) < 0.02 WHERE "
        "2 * 6371.0e0 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) <= 1.5e0)",
    ]
    for r in range(1, ROUNDS + 1):
        least = "WHERE gain > 0" if r > 1 else ""
        parts += [
            f"b{r} AS MATERIALIZED (SELECT city, site, gain FROM (SELECT city, site, sum(demand) AS gain FROM l{r} GROUP BY 1, 2) {least} QUALIFY row_number() OVER (PARTITION BY city ORDER BY gain DESC, site) = 1)",
            f"g{r} AS MATERIALIZED (SELECT city, w FROM l{r} SEMI JOIN b{r} USING (city, site))",
            f"l{r + 1} AS MATERIALIZED (SELECT * FROM (SELECT * FROM l{r} ANTI JOIN g{r} USING (city, w)) ANTI JOIN b{r} USING (city, site))",
        ]
    chosen = " UNION ALL ".join(f"SELECT city, {r} AS rank, site, gain FROM b{r}" for r in range(1, ROUNDS + 1))
    covered = " UNION ALL ".join(f"SELECT city, w FROM g{r}" for r in range(1, ROUNDS + 1))
    parts += [
        f"chosen AS ({chosen})",
        f"hit AS (SELECT DISTINCT cp.city, cp.ward_id FROM ({covered}) c JOIN sp ON sp.city = c.city AND sp.ward_id = c.w JOIN cp ON cp.city = sp.city AND cp.lat = sp.lat AND cp.lon = sp.lon)",
    ]
    return ",\n".join(parts)


def cooling_plan(spark, sf):
    """Five cooling centres for every city at once, with what they cover."""
    w = _plan_wards(spark, sf)
    chosen, covered = siting.cooling_plan(w, ROUNDS, 1.5)
    return rounded(siting.cover_summary(chosen, covered, w, 0.15))


def cooling_sites(spark, sf):
    """The centres themselves, in the order of their choice, with their gains."""
    chosen, _ = siting.cooling_plan(_plan_wards(spark, sf), ROUNDS, 1.5)
    return rounded(chosen.select("city", F.col("rank").cast("int").alias("rank"), F.col("site_id").alias("site"), "gain"))


QUERIES["cooling_plan"] = (
    cooling_plan,
    with_ctes(
        """SELECT city, count(hit.ward_id) AS covered_wards, count(*) AS total_wards, round(coalesce(sum(demand) FILTER (WHERE hit.ward_id IS NOT NULL), 0) / sum(demand), 4) + 0.0e0 AS covered_demand_share,
round(coalesce(sum(excess) FILTER (WHERE hit.ward_id IS NOT NULL), 0), 4) + 0.0e0 AS covered_excess, round(sum(excess), 4) + 0.0e0 AS total_excess,
any_value(centres) AS centres, round(coalesce(sum(excess) FILTER (WHERE hit.ward_id IS NOT NULL), 0) * 0.15e0, 4) + 0.0e0 AS estimated_averted
FROM cp LEFT JOIN hit USING (city, ward_id) LEFT JOIN (SELECT city, count(*) AS centres FROM chosen GROUP BY 1) USING (city) GROUP BY city""",
        fx.WARDS, CITY_SQL, _greedy_sql(),
    ),
)

QUERIES["cooling_sites"] = (
    cooling_sites,
    with_ctes("SELECT city, rank::INTEGER AS rank, site, round(gain, 4) + 0.0e0 AS gain FROM chosen", fx.WARDS, CITY_SQL, _greedy_sql()),
)


def site_lists(spark, sf):
    """Sites written by city and read back."""
    path = scratch_path(spark, "sites")
    siting.write_sites(siting.sites_by_city(_city_wards(spark, sf), ["ward_id", "lat", "lon"]), path)
    back = spark.read.parquet(path).select(F.col("city").cast("long").alias("city"), F.col("ward_id").cast("long").alias("ward_id"), "lat", "lon")
    return rounded(back, 6)


QUERIES["site_lists"] = (
    site_lists,
    with_ctes("SELECT city::BIGINT AS city, ward_id::BIGINT AS ward_id, round(lat, 6) + 0.0e0 AS lat, round(lon, 6) + 0.0e0 AS lon FROM cw", fx.WARDS, CITY_SQL),
)

QUERIES["counterfactual"] = (
    lambda spark, sf: rounded(siting.counterfactual(_city_wards(spark, sf), _city_wards(spark, sf).where("ward_id % 3 = 0"), work_hours=True, advisories=True)),
    with_ctes(
        "SELECT city, " + ", ".join(
            f"round(sum(excess * {m}), 4) + 0.0e0 AS baseline_{c}, round(sum(excess * {m} * keep), 4) + 0.0e0 AS after_{c}, round(sum(excess * {m} * (1 - keep)), 4) + 0.0e0 AS averted_{c}"
            for c, m in (("excess", "1.0e0"), ("low", "0.5e0"), ("high", "1.7e0"))
        ) + " FROM (SELECT *, CASE WHEN ward_id % 3 = 0 THEN 0.85e0 ELSE 1.0e0 END * 0.92e0 * 0.95e0 AS keep FROM cw) GROUP BY 1",
        fx.WARDS, CITY_SQL,
    ),
)

QUERIES["ward_demand"] = (
    lambda spark, sf: rounded(
        risk.ward_demand(
            fx.place_days(spark, sf).where(F.col("as_of") == F.lit("2024-06-01").cast("date")),
            fx.wards(spark, sf).withColumn("ward_id", F.col("ward_id").cast("string")),
        ).select("ward_id", "excess", "low", "high", "demand")
    ),
    with_ctes(
        """, s AS (SELECT place_id, sum(greatest(excess_deaths, 0.0e0)) AS e, sum(greatest(excess_low, 0.0e0)) AS l, sum(greatest(excess_high, 0.0e0)) AS h FROM place_days WHERE scope = 'ward' AND lead IN (1, 2, 3) AND as_of = DATE '2024-06-01' GROUP BY 1)
SELECT ward_id::VARCHAR AS ward_id, round(coalesce(e, 0.0e0), 4) + 0.0e0 AS excess, round(coalesce(l, 0.0e0), 4) + 0.0e0 AS low, round(coalesce(h, 0.0e0), 4) + 0.0e0 AS high,
round(coalesce(e, 0.0e0) + 1e-6 * population * vuln_mult, 4) + 0.0e0 AS demand FROM wards LEFT JOIN s ON s.place_id = ward_id::VARCHAR""",
        *BASE, fx.WARDS,
    ),
)

# --- forecasts in long form -----------------------------------------------------------


def _cell_leads(spark, sf):
    d = fx.place_days(spark, sf)
    return d.select("as_of", "lead", F.col("place_id").cast("int").alias("cell_id"), "q10", F.col("htsi").alias("q50"), "q90", "p_warning", "p_watch", "wbgt", "utci", "night_wbgt")


def _supplier_wards(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("ward_id"), (F.lit(18.0) + F.lit(1.9) * (k * 37 % 97) / F.lit(97.0)).alias("lat"),
        (F.lit(83.0) + F.lit(1.1) * (k * 53 % 89) / F.lit(89.0)).alias("lon"), ((k % 11) / F.lit(11.0)).alias("built_up_frac"),
    )


def ward_forecast(spark, sf):
    """Cell forecasts carried to the wards with the heat-island uplift."""
    cells = fx.panel_cells(fx.panel(spark, sf))
    wards = _supplier_wards(spark, sf)
    w = nearest.inverse_distance_weights(wards, cells)
    out = risk.ward_forecast(_cell_leads(spark, sf), w, wards)
    return rounded(out.groupBy("ward_id", "band").agg(F.count("*").alias("n"), F.avg("htsi").alias("htsi"), F.avg("uhi").alias("uhi"), F.avg("p_warning").alias("p_warning"), F.avg("wbgt").alias("wbgt"), F.avg("night_wbgt").alias("night_wbgt")))


WARD_FORECAST_SQL = f"""sw AS (SELECT s_suppkey AS ward_id, 18.0e0 + 1.9e0 * (s_suppkey * 37 % 97) / 97.0e0 AS lat, 83.0e0 + 1.1e0 * (s_suppkey * 53 % 89) / 89.0e0 AS lon, (s_suppkey % 11) / 11.0e0 AS bu FROM supplier),
nr AS (SELECT ward_id, bu, c.cell_id, sqrt(((c.lon - w.lon) * cos(radians(20.5e0))) ** 2 + (c.lat - w.lat) ** 2) AS d FROM sw w, panel_cells c QUALIFY row_number() OVER (PARTITION BY ward_id ORDER BY d, c.cell_id) <= 4),
wt AS (SELECT *, (1.0e0 / greatest(d, 1e-4) ** 2) / sum(1.0e0 / greatest(d, 1e-4) ** 2) OVER (PARTITION BY ward_id) AS w FROM nr),
v AS (SELECT ward_id, as_of, lead, any_value(bu) AS bu, CASE WHEN count(*) = 4 THEN sum(w * htsi) END AS h, CASE WHEN count(*) = 4 THEN sum(w * p_warning) END AS pw, CASE WHEN count(*) = 4 THEN sum(w * wbgt) END AS wb, CASE WHEN count(*) = 4 THEN sum(w * utci) END AS u, CASE WHEN count(*) = 4 THEN sum(w * night_wbgt) END AS nt
  FROM wt JOIN place_days ON place_id = cell_id::VARCHAR GROUP BY 1, 2, 3),
x AS (SELECT *, 0.3e0 + 1.55e0 * bu AS dd, 0.5e0 + 3.0e0 * bu AS dn FROM v),
y AS (SELECT *, 0.5e0 * (({fx.intensity_sql('(u + dd)')}) - ({fx.intensity_sql('u')})) + 0.2e0 * (({fx.night_sql('(nt + 0.55e0 * dn)')}) - ({fx.night_sql('nt')})) AS uhi FROM x),
z AS (SELECT *, {fx.clip_sql('h + uhi', 0.0, 100.0)} AS htsi FROM y)"""
QUERIES["ward_forecast"] = (
    ward_forecast,
    with_ctes(
        f"""SELECT ward_id, {fx.band_sql('htsi')} AS band, count(*) AS n, round(avg(htsi), 4) + 0.0e0 AS htsi, round(avg(uhi), 4) + 0.0e0 AS uhi, round(avg(CASE WHEN lead = 0 THEN (htsi >= 59.5e0)::INT::DOUBLE ELSE {fx.clip_sql('pw', 0.0, 1.0)} END), 4) + 0.0e0 AS p_warning,
round(avg(wb + 0.55e0 * dd), 4) + 0.0e0 AS wbgt, round(avg(nt + 0.55e0 * dn), 4) + 0.0e0 AS night_wbgt FROM z GROUP BY 1, 2""",
        *BASE, fx.PANEL_CELLS_SQL, WARD_FORECAST_SQL,
    ),
)


def _baseline(spark, sf):
    return mortality.build_baseline(fx.deaths(spark, sf), places.district_table(spark))


def _observed(spark, sf):
    d = fx.place_days(spark, sf).where("lead = 0")
    return d.select(F.col("place_id").cast("int").alias("cell_id"), F.col("as_of").alias("date"), "htsi")


def ward_payload(spark, sf):
    """Full ward chain: weights, heat island, lags over the seam, base rates, deaths."""
    k = F.col("ward_id")
    wards = _supplier_wards(spark, sf).withColumns({"population": F.lit(1000.0) + k * F.lit(17.0), "vuln_mult": F.lit(0.75) + F.lit(0.6) * (k % 13) / F.lit(13.0), "ahs_code": (k % 30 + 1).cast("int")})
    w = nearest.inverse_distance_weights(wards, fx.panel_cells(fx.panel(spark, sf)))
    leads = cut_lineage(_cell_leads(spark, sf))
    out = risk.ward_payload(leads, _observed(spark, sf), w, wards, _baseline(spark, sf))
    return rounded(out.groupBy("place_id", "lead").agg(F.count("*").alias("n"), F.avg("htsi").alias("htsi"), F.avg("rr").alias("rr"), F.max("mri").alias("mri"), F.sum("excess_deaths").alias("excess_deaths"), F.sum("excess_high").alias("excess_high"), F.sum("expected_deaths").alias("expected_deaths")))


def _rr_sql(which: str) -> str:
    c = ExposureResponse()
    return f"exp(vm * least({c.slope(which)!r}::DOUBLE * e, {math.log(c.max_rr)!r}::DOUBLE))"


_LAG = "greatest(coalesce({x}, 0) - 48.5e0, 0.0e0)"


def _payload_tail(source: str, key: str) -> str:
    """Deaths and relative risk from rows that carry l0..l3, doy, ahs_code, vm and pop."""
    e = " + ".join(f"{w}e0 * {_LAG.format(x=f'l{i}')}" for i, w in enumerate((0.5, 0.25, 0.15, 0.1)))
    return f"""pe AS (SELECT *, {e} AS e FROM {source}),
pr AS (SELECT pe.*, daily_deaths_mean * seasonal_factor / pop_now * pop AS expd, {_rr_sql('central')} AS rr, {_rr_sql('high')} AS rrh FROM pe JOIN level USING (ahs_code) JOIN profile USING (doy))
SELECT {key}, lead, count(*) AS n, round(avg(htsi), 4) + 0.0e0 AS htsi, round(avg(rr), 4) + 0.0e0 AS rr, round(max(least(greatest(100.0e0 * (rr - 1) / 0.5e0, 0.0e0), 100.0e0)), 4) + 0.0e0 AS mri,
round(sum(expd * (rr - 1)), 4) + 0.0e0 AS excess_deaths, round(sum(expd * (rrh - 1)), 4) + 0.0e0 AS excess_high, round(sum(expd), 4) + 0.0e0 AS expected_deaths FROM pr GROUP BY 1, 2"""


PEOPLE_CTES = (fx.DEATHS, fx.districts_sql(), LEVEL_SQL, _profile_sql())
QUERIES["ward_payload"] = (
    ward_payload,
    with_ctes(
        f""", ob AS (SELECT place_id, as_of, htsi FROM place_days WHERE lead = 0),
hist AS (SELECT ward_id, as_of + o.o AS as_of, -o.o AS lead, CASE WHEN count(*) = 4 THEN sum(w * htsi) END AS h FROM wt JOIN ob ON ob.place_id = wt.cell_id::VARCHAR, (VALUES (1), (2), (3)) o(o) GROUP BY 1, 2, 3),
both_leads AS (SELECT ward_id, as_of, lead, htsi FROM z UNION ALL SELECT h.ward_id, h.as_of, h.lead, h.h + z.uhi FROM hist h JOIN z ON z.ward_id = h.ward_id AND z.as_of = h.as_of AND z.lead = 0),
pl AS (SELECT z.ward_id AS place_id, z.lead, z.htsi, z.htsi AS l0, b1.htsi AS l1, b2.htsi AS l2, b3.htsi AS l3, {fx.doy('(z.as_of + z.lead)')} AS doy, (z.ward_id % 30 + 1)::INTEGER AS ahs_code,
  0.75e0 + 0.6e0 * (z.ward_id % 13) / 13.0e0 AS vm, 1000.0e0 + z.ward_id * 17.0e0 AS pop FROM z
  LEFT JOIN both_leads b1 ON b1.ward_id = z.ward_id AND b1.as_of = z.as_of AND b1.lead = z.lead - 1 LEFT JOIN both_leads b2 ON b2.ward_id = z.ward_id AND b2.as_of = z.as_of AND b2.lead = z.lead - 2
  LEFT JOIN both_leads b3 ON b3.ward_id = z.ward_id AND b3.as_of = z.as_of AND b3.lead = z.lead - 3),
"""
        + _payload_tail("pl", "place_id"),
        *BASE, fx.PANEL_CELLS_SQL, WARD_FORECAST_SQL, *PEOPLE_CTES,
    ),
)


def district_payload(spark, sf):
    """Full district chain over the cells each district owns."""
    d = places.district_table(spark)
    vuln = d.select("ahs_code", (F.lit(0.75) + F.lit(0.6) * F.col("ahs_code") / F.lit(30.0)).alias("vuln_mult"))
    leads = cut_lineage(_cell_leads(spark, sf))
    out = risk.district_payload(leads, _observed(spark, sf), fx.panel_cells(fx.panel(spark, sf)), _baseline(spark, sf), vuln)
    return rounded(out.groupBy("place_id", "lead").agg(F.count("*").alias("n"), F.avg("htsi").alias("htsi"), F.avg("rr").alias("rr"), F.max("mri").alias("mri"), F.sum("excess_deaths").alias("excess_deaths"), F.sum("excess_high").alias("excess_high"), F.sum("expected_deaths").alias("expected_deaths")))


QUERIES["district_payload"] = (
    district_payload,
    with_ctes(
        f""", df AS (SELECT as_of, lead, ahs_code, avg(htsi) AS htsi FROM place_days JOIN panel_cells ON place_id = cell_id::VARCHAR GROUP BY 1, 2, 3),
db AS (SELECT as_of, lead, ahs_code, htsi FROM df UNION ALL SELECT as_of + o.o, -o.o, ahs_code, htsi FROM df, (VALUES (1), (2), (3)) o(o) WHERE lead = 0),
pl AS (SELECT f.ahs_code AS place_id, f.ahs_code, f.lead, f.htsi, f.htsi AS l0, b1.htsi AS l1, b2.htsi AS l2, b3.htsi AS l3, {fx.doy('(f.as_of + f.lead)')} AS doy, 0.75e0 + 0.6e0 * f.ahs_code / 30.0e0 AS vm, v.pop_now AS pop FROM df f JOIN level v USING (ahs_code)
  LEFT JOIN db b1 ON b1.ahs_code = f.ahs_code AND b1.as_of = f.as_of AND b1.lead = f.lead - 1 LEFT JOIN db b2 ON b2.ahs_code = f.ahs_code AND b2.as_of = f.as_of AND b2.lead = f.lead - 2
  LEFT JOIN db b3 ON b3.ahs_code = f.ahs_code AND b3.as_of = f.as_of AND b3.lead = f.lead - 3),
"""
        + _payload_tail("pl", "place_id"),
        *BASE, fx.PANEL_CELLS_SQL, *PEOPLE_CTES,
    ),
)

QUERIES["district_forecast"] = (
    lambda spark, sf: rounded(risk.district_forecast(_cell_leads(spark, sf), fx.panel_cells(fx.panel(spark, sf))).select("as_of", "lead", "ahs_code", "htsi", "htsi_max", "p_warning", "band")),
    with_ctes(
        f"SELECT as_of, lead, ahs_code, round(avg(htsi), 4) + 0.0e0 AS htsi, round(max(htsi), 4) + 0.0e0 AS htsi_max, round(avg(p_warning), 4) + 0.0e0 AS p_warning, {fx.band_sql('avg(htsi)')} AS band FROM place_days JOIN panel_cells ON place_id = cell_id::VARCHAR GROUP BY 1, 2, 3",
        *BASE, fx.PANEL_CELLS_SQL,
    ),
)


def seam_lags(spark, sf):
    """Lags of every lead that reach back over the observed days."""
    d = fx.place_days(spark, sf)
    observed = d.where("lead = 0").select(F.concat_ws(":", "scope", "place_id").alias("place_id"), F.col("as_of").alias("date"), "htsi")
    f = d.withColumn("place_id", F.concat_ws(":", "scope", "place_id")).select("as_of", "place_id", "lead", "htsi")
    return rounded(risk.lead_lags(f, risk.history_leads(observed, f)))


QUERIES["seam_lags"] = (
    seam_lags,
    with_ctes(
        """, obs AS (SELECT c, s, h FROM place_days0 WHERE lead = 0)
SELECT DATE '2024-01-01' + f.s::INTEGER AS as_of, CASE WHEN f.c % 2 = 0 THEN 'ward:' ELSE 'district:' END || f.c AS place_id, f.lead, round(f.h, 4) + 0.0e0 AS htsi, round(f.h, 4) + 0.0e0 AS lag0,
"""
        + ", ".join(f"round((SELECT o.h FROM seqs o WHERE o.cell_id = f.c AND o.seq = f.s + f.lead - {k}), 4) + 0.0e0 AS lag{k}" for k in (1, 2, 3))
        + " FROM place_days0 f",
        *BASE,
    ),
)

STATEWIDE = "SELECT as_of, lead, round(sum(excess_deaths), 4) + 0.0e0 AS excess_deaths, round(sum(excess_low), 4) + 0.0e0 AS excess_low, round(sum(excess_high), 4) + 0.0e0 AS excess_high FROM place_days WHERE scope = 'district' GROUP BY 1, 2"
QUERIES["statewide_totals"] = (lambda spark, sf: rounded(risk.statewide(fx.place_days(spark, sf))), with_ctes(STATEWIDE, *BASE))

QUERIES["peak_issue_date"] = (
    lambda spark, sf: rounded(risk.default_date(fx.place_days(spark, sf))),
    with_ctes("SELECT as_of, round(sum(excess_deaths), 4) + 0.0e0 AS excess_deaths FROM place_days WHERE scope = 'district' AND lead = 3 GROUP BY 1 ORDER BY sum(excess_deaths) DESC, as_of LIMIT 1", *BASE),
)

QUERIES["payload_as_of"] = (
    lambda spark, sf: rounded(risk.payload_as_of(fx.place_days(spark, sf), "2031-01-01", "2024-03-01").select("as_of", "scope", "place_id", "lead", "htsi")),
    with_ctes("SELECT as_of, scope, place_id, lead, round(htsi, 4) + 0.0e0 AS htsi FROM place_days WHERE as_of = DATE '2024-03-01'", *BASE),
)

QUERIES["latest_as_of"] = (
    lambda spark, sf: rounded(risk.latest_as_of(fx.place_days(spark, sf), "2024-12-20")),
    with_ctes("SELECT scope, place_id, lead, max(as_of) AS as_of, round(arg_max(htsi, as_of), 4) + 0.0e0 AS htsi FROM place_days WHERE as_of <= DATE '2024-12-20' GROUP BY 1, 2, 3", *BASE),
)

# --- read queries ---------------------------------------------------------------------

QUERIES["snapshot"] = (
    lambda spark, sf: rounded(serve.snapshot(fx.place_days(spark, sf).where(F.col("as_of") == F.lit(T2).cast("date")), alerts.replay(_targets(spark, sf), T2, POLICY), 2).select("scope", "place_id", "htsi", "q10", "band", "mri", "excess_deaths", "alert_band")),
    with_ctes(
        f"SELECT p.scope, p.place_id, round(htsi, 4) + 0.0e0 AS htsi, round(q10, 4) + 0.0e0 AS q10, band, round(mri, 4) + 0.0e0 AS mri, round(excess_deaths, 4) + 0.0e0 AS excess_deaths, {_NAME.format(l='s2.level')} AS alert_band FROM place_days p JOIN s2 USING (scope, place_id) WHERE p.as_of = DATE '{T2}' AND p.lead = 2",
        *BASE, DAYS_SQL, target_sql(POLICY), state_sql(POLICY, name="s2", until=T2), recursive=True,
    ),
)

QUERIES["place_detail"] = (
    lambda spark, sf: rounded(serve.place(fx.place_days(spark, sf), _states(spark, sf), "ward", "6").select("as_of", "lead", "htsi", "band", "alert_band", "since")),
    with_ctes(f"SELECT p.as_of, p.lead, round(htsi, 4) + 0.0e0 AS htsi, band, {_NAME.format(l='s.level')} AS alert_band, since FROM place_days p JOIN states s USING (scope, place_id) WHERE scope = 'ward' AND place_id = '6'", *STATE, recursive=True),
)

QUERIES["place_series"] = (
    lambda spark, sf: rounded(serve.series(fx.place_days(spark, sf), T2, 30)),
    with_ctes(
        f"""SELECT scope, place_id, date, round(htsi, 4) + 0.0e0 AS htsi, band, 'history' AS part FROM place_days WHERE lead = 0 AND as_of IN (SELECT DISTINCT as_of FROM place_days WHERE lead = 0 AND as_of < DATE '{T2}' ORDER BY as_of DESC LIMIT 30)
UNION ALL SELECT scope, place_id, date, round(htsi, 4) + 0.0e0, band, 'forecast' FROM place_days WHERE as_of = DATE '{T2}'""",
        *BASE,
    ),
)


def explanations(spark, sf):
    """Sentences for every place-day with drivers of the nearest explained lead."""
    d = fx.place_days(spark, sf).withColumns({"built_up_frac": F.lit(0.37), "vuln_mult": F.lit(1.125), "uhi": F.col("p_watch"), "expected_deaths": F.col("p_watch") + 1, "rr": F.col("p_warning") + 1})
    horizons = d.where("lead IN (1, 3, 5)").select("place_id", "as_of", F.col("lead").alias("horizon"), F.array(
        F.struct(F.lit("htsi_l0").alias("feature"), F.lit("today's thermal stress").alias("label"), F.lit(1.0).alias("value"), (F.col("p_watch") * 10 - 3).alias("contribution")),
        F.struct(F.lit("doy_sin").alias("feature"), F.lit("time of year").alias("label"), F.lit(2.0).alias("value"), F.lit(-1.26).alias("contribution")),
    ).alias("drivers"))
    return serve.explain(d, horizons.where("place_id <> '7'")).select("scope", "place_id", "as_of", "lead", "sentence", "note", "uhi_sentence", "risk_sentence")


_FX1 = _fx("htsi", 1)
QUERIES["explanations"] = (
    explanations,
    with_ctes(
        f""", e AS (SELECT *, CASE WHEN lead = 0 THEN NULL WHEN lead <= 1 THEN 1 WHEN lead <= 3 THEN 3 ELSE 5 END AS hz FROM place_days),
l AS (SELECT e.*, {", ".join(f"max(p_watch) FILTER (WHERE lead = {h}) OVER w AS p{h}, count(*) FILTER (WHERE lead = {h}) OVER w AS n{h}" for h in (1, 3, 5))} FROM e WINDOW w AS (PARTITION BY place_id, as_of)),
j AS (SELECT *, CASE hz WHEN 1 THEN p1 WHEN 3 THEN p3 WHEN 5 THEN p5 END * 10 - 3 AS contr, place_id <> '7' AND CASE hz WHEN 1 THEN n1 WHEN 3 THEN n3 WHEN 5 THEN n5 ELSE 0 END > 0 AS known FROM l)
SELECT scope, place_id, as_of, lead, CASE WHEN lead = 0 THEN 'Today''s observed stress in ' || name || ' is ' || {_FX1} || ' (' || band || ').'
 ELSE 'The D+' || lead || ' forecast for ' || name || ' (HTSI ' || {_FX1} || ', ' || band || ') is driven by ' || CASE WHEN known THEN 'today''s thermal stress (' || CASE WHEN contr >= 0 THEN '+' ELSE '' END || printf('%.1f', round(contr, 1)) || ' pts), time of year (-1.3 pts)' ELSE 'seasonal conditions' END || '.' END AS sentence,
CASE WHEN hz <> lead THEN 'Attributions shown are from the D+' || hz || ' model, the nearest explained horizon.' END AS note,
'Urban heat island adds ' || printf('%.2f', p_watch) || ' HTSI points (built-up fraction 37%).' AS uhi_sentence,
'Expected ' || printf('%.2f', p_watch + 1) || ' deaths/day at baseline x relative risk ' || printf('%.3f', p_warning + 1) || ' (vulnerability x1.125 on the log scale) = ' || printf('%.3f', excess_deaths) || ' excess.' AS risk_sentence FROM j""",
        *BASE,
    ),
)

QUERIES["worst_lead"] = (
    lambda spark, sf: rounded(serve.worst_lead(fx.place_days(spark, sf))),
    with_ctes("SELECT as_of, scope, place_id, lead, date, round(htsi, 4) + 0.0e0 AS htsi, band FROM place_days WHERE lead < 4 QUALIFY row_number() OVER (PARTITION BY as_of, scope, place_id ORDER BY htsi DESC, lead) = 1", *BASE),
)


def field_view(spark, sf):
    d = fx.place_days(spark, sf)
    t, a = _dictionaries(spark)
    st = _states(spark, sf)
    days = serve.trigger_days(st, d)
    adv = alerts.render_advisories(days, t, a).where("audience = 'public' AND language = 'en'").join(days.select("alert_id", "place_id"), "alert_id")
    watch = a.where("audience = 'public' AND language = 'en' AND band = 'Watch'")
    out = serve.field_view(d, st, adv, watch)
    return rounded(out.withColumn("actions", F.array_join("actions", "|")).drop("sms"))


QUERIES["field_view"] = (
    field_view,
    with_ctes(
        f""", pk AS (SELECT as_of, scope, place_id, lead AS peak_lead, band AS peak_band FROM place_days WHERE lead < 4 AND scope = 'ward' QUALIFY row_number() OVER (PARTITION BY as_of, scope, place_id ORDER BY htsi DESC, lead) = 1),
td AS (SELECT s.place_id, s.level, p.ed_surge FROM states s LEFT JOIN place_days p ON p.scope = s.scope AND p.place_id = s.place_id AND p.as_of = s.as_of AND p.lead = s.tl WHERE s.scope = 'ward')
SELECT d.as_of, d.scope, d.place_id, {_NAME.format(l='td.level')} AS level, round(h0, 4) + 0.0e0 AS today_htsi, b0 AS today_band, round(h1, 4) + 0.0e0 AS tomorrow_htsi, b1 AS tomorrow_band, peak_lead, peak_band,
CASE WHEN td.level > 0 THEN 'public drink water|visits ' || {_fx('td.ed_surge', 0)} || '|stay in' ELSE 'public drink water|visits {{ed}}|stay in' END AS actions
FROM days d JOIN pk USING (as_of, scope, place_id) JOIN td USING (place_id) WHERE d.scope = 'ward'""",
        *STATE, recursive=True,
    ),
)

QUERIES["trigger_days"] = (
    lambda spark, sf: rounded(serve.trigger_days(_states(spark, sf), fx.place_days(spark, sf)).select("alert_id", "lead", "date", "htsi", "q90", "wbgt")),
    with_ctes(
        "SELECT alert_id, tl AS lead, p.date, round(p.htsi, 4) + 0.0e0 AS htsi, round(p.q90, 4) + 0.0e0 AS q90, round(p.wbgt, 4) + 0.0e0 AS wbgt FROM act a LEFT JOIN place_days p ON p.scope = a.scope AND p.place_id = a.place_id AND p.as_of = a.as_of AND p.lead = a.tl WHERE a.level > 0",
        *STATE, ACTIVE_SQL, recursive=True,
    ),
)

QUERIES["replay_dates"] = (
    lambda spark, sf: serve.replay_dates(fx.place_days(spark, sf)),
    with_ctes("SELECT as_of, count(*) AS place_days, as_of = (SELECT max(as_of) FROM place_days) AS latest FROM place_days GROUP BY 1", *BASE),
)

QUERIES["audit_list"] = (
    lambda spark, sf: serve.listing(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("action")), 300).select("id", "action"),
    "SELECT event_id AS id, event_type AS action FROM events ORDER BY ts DESC, event_id LIMIT 300",
)

QUERIES["scale_ceiling"] = (
    lambda spark, sf: rounded(serve.scale_ceiling(fx.place_days(spark, sf).where("lead = 1"), "excess_deaths")),
    with_ctes(", r AS (SELECT excess_deaths AS e, row_number() OVER (ORDER BY excess_deaths) - 1 AS i, count(*) OVER () AS n FROM place_days WHERE lead = 1) SELECT round(greatest(e, 0.02e0), 4) + 0.0e0 AS ceiling FROM r WHERE i = floor(0.95e0 * n)", *BASE),
)

QUERIES["subscription_listing"] = (
    lambda spark, sf: serve.listing(_subs(spark, sf).select("id", "channel", "address"), 200, at="id", address="address"),
    "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'webhook' WHEN 1 THEN 'whatsapp' ELSE 'sms' END AS channel, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS address FROM customer ORDER BY id DESC LIMIT 200",
)

QUERIES["current_source"] = (
    lambda spark, sf: rounded(serve.current_source(fx.place_days(spark, sf).where("lead = 0").withColumn("mode", F.when((F.col("scope") == "ward") & (F.col("as_of") <= F.lit(T1).cast("date")), "live").otherwise("replay")))),
    with_ctes(
        f"SELECT scope, place_id, mode, as_of, round(htsi, 4) + 0.0e0 AS htsi FROM (SELECT *, CASE WHEN scope = 'ward' AND as_of <= DATE '{T1}' THEN 'live' ELSE 'replay' END AS mode FROM place_days WHERE lead = 0) QUALIFY row_number() OVER (PARTITION BY scope, place_id ORDER BY (mode = 'live')::INT DESC, as_of DESC) = 1",
        *BASE,
    ),
)

QUERIES["payload_documents"] = (
    lambda spark, sf: documents.payload_documents(fx.place_days(spark, sf), ["band", "date"]).select("as_of", "scope", "place_id", F.to_json("days").alias("days")),
    with_ctes("""SELECT as_of, scope, place_id, '[' || string_agg('{"lead":' || lead || ',"band":"' || band || '","date":"' || date || '"}', ',' ORDER BY lead) || ']' AS days FROM place_days GROUP BY 1, 2, 3""", *BASE),
)


def cell_features(spark, sf):
    c = fx.panel_cells(fx.panel(spark, sf))
    return c.select("cell_id", geojson.cell_feature().alias("feature"))


QUERIES["cell_features"] = (
    cell_features,
    with_ctes(
        """SELECT cell_id, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[' || (lon - 0.125e0) || ',' || (lat - 0.125e0) || '],[' || (lon + 0.125e0) || ',' || (lat - 0.125e0) || '],[' || (lon + 0.125e0) || ',' || (lat + 0.125e0) || '],[' || (lon - 0.125e0) || ',' || (lat + 0.125e0) || '],[' || (lon - 0.125e0) || ',' || (lat - 0.125e0) || ']]]},"properties":{"id":' || cell_id || ',"lat":' || lat || ',"lon":' || lon || ',"district":' || ahs_code || '}}' AS feature FROM panel_cells""",
        fx.PANEL, fx.PANEL_CELLS_SQL,
    ),
)
