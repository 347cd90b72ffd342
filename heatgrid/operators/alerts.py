"""Alert levels: target, hysteresis, transitions, matching and texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.functions import scaling, text
from heatgrid.params import BAND_EDGES, LEVELS, AlertParams

TRIGGER = "lead int, htsi double, band string, p_warning double, p_watch double"
TRANSITION = "array<struct<date: date, from: string, to: string, kind: string, reason: string, trigger: struct<lead: int, htsi: double, band: string, p_warning: double, p_watch: double>>>"


def scale_thresholds(thresholds: DataFrame, k: float) -> DataFrame:
    """Classifier thresholds times k, at most 0.95."""
    return thresholds.withColumns({c: scaling.scaled_threshold(c, k) for c in ("warning", "watch")})


def as_days(place_days: DataFrame, keys: Sequence[str] = ("as_of", "scope", "place_id")) -> DataFrame:
    """Nest the leads of a place and issue date (at most six) into one array."""
    day = F.struct("lead", "htsi", "band", "p_warning", "p_watch", "q10", "q90")
    return place_days.groupBy(*keys).agg(F.array_sort(F.collect_list(day)).alias("days"))


def _percent(c: Column) -> Column:
    return F.concat(F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("%"))


def _number(c: Column) -> Column:
    return F.coalesce(F.format_string("%.1f", c), F.lit("n/a"))


def target_level(df: DataFrame, cfg: AlertParams, days: str = "days") -> DataFrame:
    """Level asked for by today's observation and the forecast, with its reason.

    The first ``lead_days`` forecasts may raise the level to their own band or
    to what a validated probability says; later ones up to ``watch_lead_days``
    raise a quiet place to Watch at most.
    """
    def at(k: int) -> Column:
        return F.try_element_at(F.col(days), F.lit(k + 1))

    def prob(k: int, name: str) -> Column:
        return F.coalesce(at(k)[name], F.lit(0.0))

    today = at(0)
    levels = [scaling.level_number(today["band"])]
    reasons = [F.concat(F.lit("Observed "), today["band"], F.lit(" today (HTSI "), _number(today["htsi"]), F.lit(")"))]
    for k in range(1, cfg.lead_days + 1):
        d, own = at(k), scaling.level_number(at(k)["band"])
        why = F.concat(
            F.lit("Forecast "), d["band"], F.lit(f" on D+{k} (HTSI "), _number(d["htsi"]), F.lit(", 80% band "),
            _number(d["q10"]), F.lit("-"), _number(d["q90"]), F.lit(")"),
        )
        level = own
        if k in cfg.thresholds:
            warning, watch = cfg.thresholds[k]
            by_warning = (prob(k, "p_warning") >= warning) & (own < 2)
            by_watch = (prob(k, "p_watch") >= watch) & (own < 1)
            level = F.when(by_warning, F.lit(2)).when(by_watch, F.lit(1)).otherwise(own)

            def likely(name: str, p: str, cut: float, k: int = k) -> Column:
                return F.concat(
                    F.lit(f"{name}-level heat likely on D+{k}: P = "), _percent(at(k)[p]),
                    F.lit(" against a validated trigger of "), _percent(F.lit(float(cut))),
                )

            why = (
                F.when(by_warning, likely("Warning", "p_warning", warning))
                .when(by_watch, likely("Watch", "p_watch", watch))
                .otherwise(why)
            )
        levels.append(F.when(d.isNotNull(), level).otherwise(F.lit(-1)))
        reasons.append(why)

    cuts = {
        k: cfg.thresholds[k][0] if k in cfg.thresholds else cfg.watch_probability
        for k in range(cfg.lead_days + 1, cfg.watch_lead_days + 1)
    }
    heads_up = F.lit(None).cast("int")
    for k in sorted(cuts, reverse=True):
        heads_up = F.when(at(k).isNotNull() & (prob(k, "p_warning") >= cuts[k]), F.lit(k)).otherwise(heads_up)

    staged = df.withColumns({"_levels": F.array(*levels), "_ahead": heads_up}).withColumn("_top", F.array_max("_levels"))
    first = F.array_position("_levels", F.col("_top")).cast("int") - 1
    quiet = (F.col("_top") < 1) & F.col("_ahead").isNotNull()
    staged = staged.withColumns(
        {
            "target_level": F.when(quiet, F.lit(1)).otherwise(F.col("_top")),
            "trigger_lead": F.when(quiet, F.col("_ahead")).otherwise(first),
        }
    )
    chosen = F.element_at(F.col(days), F.col("trigger_lead") + 1)
    cut = F.element_at(F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("_ahead")) if cuts else F.lit(0.5)
    ahead = F.concat(
        F.lit("Warning-level heat possible on D+"), F.col("_ahead").cast("string"), F.lit(" (P = "),
        _percent(chosen["p_warning"]), F.lit(", trigger "), _percent(cut), F.lit(")"),
    )
    reason = F.when(quiet, ahead).otherwise(F.element_at(F.array(*reasons), first + 1))
    observed = F.col("trigger_lead") == 0
    trigger = F.struct(
        F.col("trigger_lead").alias("lead"), chosen["htsi"].alias("htsi"), chosen["band"].alias("band"),
        F.when(~observed, chosen["p_warning"]).alias("p_warning"),
        F.when(~observed & ~quiet, chosen["p_watch"]).alias("p_watch"),
    )
    return staged.withColumns(
        {
            "target_band": scaling.level_name("target_level"),
            "reason": reason,
            "trigger": trigger,
            "htsi_today": today["htsi"],
        }
    ).drop("_levels", "_ahead", "_top")


def _level_label(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def run_state(targets: DataFrame, cfg: AlertParams, edges: Sequence[float] = BAND_EDGES, place: Sequence[str] = ("scope", "place_id"), date: str = "as_of") -> DataFrame:
    """Fold the daily targets of every place into a level, date by date.

    Escalation is immediate. A level falls by one step only after it was held
    and the index stayed clear of its entry edge for ``min_dwell_days`` days.
    A place has one entry per issue date, which bounds the folded array.
    """
    step = F.struct(
        F.col(date).alias("date"), F.col("target_level").alias("target"), F.col("htsi_today").alias("htsi"), "reason", "trigger"
    )
    series = targets.groupBy(*place).agg(F.array_sort(F.collect_list(step)).alias("_seq"))
    start = F.struct(
        F.lit(0).alias("level"), F.element_at("_seq", 1)["date"].alias("since"), F.lit(0).alias("below"),
        F.array().cast(TRANSITION).alias("transitions"),
    )
    entry = F.array(*[F.lit(float(e) - cfg.margin) for e in edges])

    def advance(state: Column, day: Column) -> Column:
        level, rise = state["level"], day["target"] > state["level"]
        wants_down = day["target"] < level
        bar = F.try_element_at(entry, level)
        clear = wants_down & F.coalesce(day["htsi"] < bar, F.lit(False))
        below = F.when(clear, state["below"] + 1).otherwise(F.lit(0))
        held = F.datediff(day["date"], state["since"]) >= cfg.min_dwell_days
        fall = wants_down & (below >= cfg.min_dwell_days) & held
        moved = rise | fall
        to = F.when(rise, day["target"]).when(fall, level - 1).otherwise(level)
        why = F.when(rise, day["reason"]).otherwise(
            F.concat(F.lit("HTSI below "), _number(bar), F.lit(" for "), below.cast("string"), F.lit(" consecutive days"))
        )
        trigger = F.when(rise, day["trigger"]).otherwise(
            F.struct(
                F.lit(0).alias("lead"), day["htsi"].alias("htsi"), F.lit(None).cast("string").alias("band"),
                F.lit(None).cast("double").alias("p_warning"), F.lit(None).cast("double").alias("p_watch"),
            )
        )
        event = F.struct(
            day["date"].alias("date"), _level_label(level).alias("from"), _level_label(to).alias("to"),
            F.when(rise, F.lit("escalate")).otherwise(F.lit("de-escalate")).alias("kind"), why.alias("reason"), trigger.alias("trigger"),
        )
        return F.struct(
            to.alias("level"),
            F.when(moved, day["date"]).otherwise(state["since"]).alias("since"),
            F.when(moved, F.lit(0)).otherwise(below).alias("below"),
            F.when(moved, F.concat(state["transitions"], F.array(event).cast(TRANSITION))).otherwise(state["transitions"]).alias("transitions"),
        )

    folded = series.select(*place, F.element_at("_seq", -1).alias("_last"), F.aggregate("_seq", start, advance).alias("_s"))
    return folded.select(
        *place,
        F.col("_s.level").alias("level"),
        _level_label(F.col("_s.level")).alias("band"),
        F.col("_s.since").alias("since"),
        F.col("_s.below").alias("below_count"),
        F.col("_last.date").alias(date),
        F.col("_last.trigger").alias("trigger"),
        F.col("_last.target").alias("target_level"),
        F.col("_s.transitions").alias("transitions"),
    )


def replay(targets: DataFrame, as_of: str, cfg: AlertParams, date: str = "as_of", **kw) -> DataFrame:
    """State of every place recomputed from the first day up to a date."""
    return run_state(targets.where(F.col(date) <= F.lit(as_of).cast("date")), cfg, date=date, **kw)


def transitions(states: DataFrame, place: Sequence[str] = ("scope", "place_id")) -> DataFrame:
    return states.select(*place, F.inline("transitions"))


def daily_levels(targets: DataFrame, states: DataFrame, place: Sequence[str] = ("scope", "place_id"), date: str = "as_of") -> DataFrame:
    """Level of every place on every issue date, filled forward from the transitions."""
    moves = transitions(states, place).select(*place, F.col("date").alias(date), scaling.level_number("to").alias("_to"))
    w = Window.partitionBy(*place).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return (
        targets.join(moves, [*place, date], "left")
        .withColumn("level", F.coalesce(F.last("_to", ignorenulls=True).over(w), F.lit(0)))
        .drop("_to")
    )


def previous_level(levels: DataFrame, place: Sequence[str] = ("scope", "place_id"), date: str = "as_of") -> DataFrame:
    return levels.withColumn("prev_level", F.lag("level").over(Window.partitionBy(*place).orderBy(date)))


def policy_scorecard(days: DataFrame, configs: dict[str, AlertParams], edges: Sequence[float] = BAND_EDGES) -> DataFrame:
    """Burden, anticipation and stability of several alert policies.

    ``days`` is the output of :func:`as_days`.
    """
    out = None
    for name, cfg in configs.items():
        targets = target_level(days, cfg).withColumn("observed", scaling.level_number(F.element_at("days", 1)["band"]))
        states = run_state(targets, cfg, edges)
        levels = previous_level(daily_levels(targets.select("scope", "place_id", "as_of", "observed"), states))
        hot = (F.col("observed") >= 2) & F.col("prev_level").isNotNull()
        pct = lambda part, whole: F.lit(100.0) * F.try_divide(F.count_if(part).cast("double"), F.count_if(whole).cast("double"))
        changed = F.col("level") != F.coalesce(F.col("prev_level"), F.lit(0))
        row = levels.agg(
            F.count("*").alias("place_days"),
            pct(F.col("level") >= 2, F.lit(True)).alias("warning_plus_pct"),
            pct(F.col("level") >= 1, F.lit(True)).alias("watch_plus_pct"),
            pct(hot & (F.col("prev_level") >= 1), hot).alias("warned_day_before_pct"),
            pct(hot & (F.col("prev_level") >= 2), hot).alias("warning_day_before_pct"),
            (F.count_if(changed) / F.count_if(F.col("prev_level").isNull())).alias("changes_per_place"),
        ).withColumn("policy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def changed_levels(prev: DataFrame, cur: DataFrame, place: Sequence[str] = ("scope", "place_id")) -> DataFrame:
    """Places whose level differs from the previous evaluation."""
    old = prev.select(*place, F.col("band").alias("from"))
    new = cur.select(*place, F.col("band").alias("to"))
    return new.join(old, list(place)).where(F.col("from") != F.col("to"))


def with_alert_ids(states: DataFrame, prefix: str = "HEAT") -> DataFrame:
    return states.withColumn("alert_id", F.when(F.col("level") > 0, text.alert_id(prefix, "scope", "place_id", "since")))


def active_alerts(states: DataFrame, scope: str | None = None, min_level: int = 1, city: str | None = None) -> DataFrame:
    """Current alerts, highest level first, then highest risk, then id."""
    out = states.where(F.col("level") >= min_level)
    if scope:
        out = out.where(F.col("scope") == scope)
    if city is not None:
        out = out.where(F.col("city") == city)
    return out.orderBy(F.col("level").desc(), F.coalesce("mri", F.lit(0.0)).desc(), "scope", "place_id")


def level_counts(states: DataFrame, col: str = "band") -> DataFrame:
    """Places per level; levels nobody holds are listed with zero."""
    row = states.agg(*[F.count_if(F.col(col) == name).alias(name) for name in LEVELS])
    return row.unpivot([], list(LEVELS), col, "n")


def transition_history(moves: DataFrame, limit: int = 200) -> DataFrame:
    return moves.orderBy(F.col("date").desc(), "scope", "place_id").limit(limit)


PART, HELD = "_part", 4096  # the part of the subscribers that one belongs to; subscribers held together


def part_of(subscription: str, parts: int) -> Column:
    """The part of a subscriber, of so many equal shares of all subscribers."""
    return F.pmod(F.xxhash64(subscription), F.lit(parts)).cast("int")


@dataclass
class Matches:
    """(alert, subscriber) pairs before they are written out, see :func:`find_matches`.

    ``sides``: alerts by part and key; ``groups``: the subscribers of a part that asked for a key from a level on, a few
    thousand together in ``ids``; ``others``: further pairs, as rows.
    """

    sides: DataFrame
    groups: DataFrame
    others: DataFrame
    place: list[str]
    carry: list[str]
    parts: int

    def pairs(self, without: DataFrame | None = None) -> DataFrame:
        """One row a pair, but for those of ``without`` (alert_id, subscription_id)."""
        sides, others, ids, keys = self.sides, self.others, F.col("ids"), ["alert_id", PART]
        if without is not None:
            done = without.dropna().withColumn(PART, part_of("subscription_id", self.parts))
            done = done.groupBy(*keys).agg(F.collect_set("subscription_id").alias("_done"))
            sides, others = sides.join(done.hint("merge"), keys, "left"), others.join(without, ["alert_id", "subscription_id"], "left_anti")
            ids = F.when(F.col("_done").isNull(), ids).otherwise(F.array_except("ids", "_done"))
        met = sides.hint("merge").join(self.groups, [PART, *self.place]).where(F.col("level") >= F.col("min_level"))
        columns = ["alert_id", "subscription_id", *self.carry]
        return met.select("alert_id", *self.carry, F.explode(ids).alias("subscription_id")).select(*columns).unionByName(others.select(*columns))


def find_matches(alerts: DataFrame, subs: DataFrame, carry: Sequence[str] = ()) -> Matches:
    """(alert, subscriber) pairs by ward, district or city, at or above the level asked for.

    The three alternatives become one equality join on (scope, kind, key). Few
    keys can hold very many pairs, so subscribers are dealt over all partitions
    and alerts go to each, where they meet groups of subscribers, not single
    ones. A pair that meets by several keys is kept by the first of them, so
    that pairs are neither shuffled nor compared afterwards; keys that another
    of the alert's precedes meet the subscribers one by one, as these need what
    else a subscriber asked for. ``carry`` names further columns of an alert.
    """
    place = ["scope", "kind", "key"]

    def keys(scope: str, kind: str, c: str) -> Column:
        listed = F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.transform(
            listed, lambda k: F.struct(F.lit(scope).alias("scope"), F.lit(kind).alias("kind"), k.cast("string").alias("key"))
        )

    every = F.concat(keys("ward", "id", "wards"), keys("district", "district", "districts"), keys("ward", "city", "cities"))
    wants = F.filter(every, lambda w: w["key"].isNotNull())
    asked = subs.select(F.col("id").alias("subscription_id"), F.coalesce("min_level", F.lit(1)).alias("min_level"), F.explode(F.array_distinct(wants)).alias("w"))
    asked = asked.select("subscription_id", "min_level", "w.*").groupBy("subscription_id", *place).agg(F.min("min_level").alias("min_level"))
    every_want = F.collect_list(F.struct(*place, "min_level")).over(Window.partitionBy("subscription_id"))
    offered = F.when(
        F.col("scope") == "ward",
        F.array(F.struct(F.lit("id").alias("kind"), F.col("place_id").cast("string").alias("key")), F.struct(F.lit("city").alias("kind"), F.col("city").cast("string").alias("key"))),
    ).otherwise(F.array(F.struct(F.lit("district").alias("kind"), F.col("district").cast("string").alias("key"))))
    sides = alerts.select("alert_id", *carry, "scope", "level", F.explode(offered).alias("o")).select("alert_id", *carry, "scope", "level", "o.*")
    sides = sides.groupBy("alert_id", *carry, *place).agg(F.max("level").alias("level"))
    every_offer = F.collect_list(F.struct(*place, "level")).over(Window.partitionBy("alert_id", *carry))
    here = F.struct(*place)
    sides = sides.withColumn("_offers", every_offer).withColumn("_earlier", F.filter("_offers", lambda o: F.struct(*[o[c].alias(c) for c in place]) < here)).drop("_offers")

    parts = max(int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions")), alerts.sparkSession.sparkContext.defaultParallelism)
    to_all = lambda df: df.withColumn(PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, PART, *place)
    dealt = asked.withColumn(PART, part_of("subscription_id", parts))
    named = F.concat(F.collect_list("subscription_id"), F.array_repeat(F.lit(None).cast(asked.schema["subscription_id"].dataType), F.count_if(F.col("subscription_id").isNull()).cast("int")))
    groups = dealt.groupBy(PART, *place, "min_level").agg(named.alias("ids"))
    some = F.transform(F.sequence(F.lit(0), ((F.size("ids") - 1) / HELD).cast("int")), lambda i: F.slice("ids", i * HELD + 1, HELD))
    groups = groups.withColumn("ids", F.explode(some)).repartition(parts, PART, *place)
    wide = dealt.withColumn("_wants", every_want).repartition(parts, PART, *place)
    met = F.exists("_earlier", lambda o: F.exists("_wants", lambda w: (w["scope"] == o["scope"]) & (w["kind"] == o["kind"]) & (w["key"] == o["key"]) & (o["level"] >= w["min_level"])))
    later = to_all(sides.where(F.size("_earlier") > 0)).hint("merge").join(wide, [PART, *place])
    others = later.where(F.col("level") >= F.col("min_level")).where(~F.coalesce(met, F.lit(False)))
    first = sides.where(F.size("_earlier") <= 0).drop("_earlier").withColumn(PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return Matches(first, groups, others.select("alert_id", "subscription_id", *carry), place, list(carry), parts)


def match_subscriptions(alerts: DataFrame, subs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The pairs of :func:`find_matches`, one row for each."""
    return find_matches(alerts, subs, carry).pairs()


def undelivered(matches: DataFrame | Matches, log: DataFrame) -> DataFrame:
    """Pairs without a delivery; failed attempts do not count.

    Of :class:`Matches`, deliveries meet whole groups of subscribers: the pairs themselves are not shuffled.
    """
    done = log.where(F.col("status") != "failed").select("alert_id", "subscription_id")
    if isinstance(matches, Matches):
        return matches.pairs(without=done)
    return matches.join(done, ["alert_id", "subscription_id"], "left_anti")


def dispatch(alerts: DataFrame, subs: DataFrame, log: DataFrame) -> DataFrame:
    """Messages still owed, once per (alert, subscriber)."""
    return undelivered(find_matches(alerts, subs), log)


def with_acks(alerts: DataFrame, acks: DataFrame, moves: DataFrame, place: Sequence[str] = ("scope", "place_id")) -> DataFrame:
    """Alerts with the actions acknowledged for them and their last transition."""
    done = acks.groupBy("alert_id").agg(F.array_sort(F.collect_set("action")).alias("acks"))
    last = moves.groupBy(*place).agg(F.max_by("kind", "date").alias("last_transition"))
    joined = alerts.join(done, "alert_id", "left").join(last, list(place), "left")
    return joined.withColumn("acks", F.coalesce("acks", F.array().cast("array<string>")))


def checklist(alerts: DataFrame, actions: DataFrame, acks: DataFrame) -> DataFrame:
    """Every action of an alert's level with its state."""
    todo = alerts.select("alert_id", "band").join(actions, "band")
    done = acks.select("alert_id", "action").distinct().withColumn("done", F.lit(True))
    return todo.join(done, ["alert_id", "action"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


# --- advisory texts ----------------------------------------------------------


def render_advisories(alerts: DataFrame, templates: DataFrame, audiences: DataFrame) -> DataFrame:
    """One row per alert, language and audience with filled texts.

    ``alerts``: ``alert_id, name, band, lead, date, htsi, wbgt, night_wbgt,
    excess_deaths, excess_low, excess_high, ed_surge``. ``templates`` has one
    row per (language, band): ``label, headline, sms, description, today,
    tomorrow, on_date``; ``audiences`` one per (language, audience, band) with
    the action texts. Both are dictionaries of fixed size, joined on the level.
    """
    digits = {"htsi": 0, "wbgt": 1, "night_wbgt": 1, "excess_deaths": 1, "excess_low": 1, "excess_high": 1, "ed_surge": 0}
    # Figures are written out once an alert, texts once an alert and language; audiences meet the finished texts.
    shown = alerts.withColumns({f"_n_{c}": text.fixed(c, d) for c, d in digits.items()})
    told = shown.join(templates, "band")
    quiet = F.col("band") == LEVELS[0]

    def number(c: str) -> Column:
        return text.localise_digits(f"_n_{c}", "language")

    values = {
        "place": F.col("name"),
        "day": text.day_phrase("lead", "date", "language", "today", "tomorrow", "on_date"),
        "htsi": number("htsi"),
        "wbgt": number("wbgt"),
        "night": number("night_wbgt"),
        "level": F.col("label"),
        "excess": number("excess_deaths"),
        "excessLow": number("excess_low"),
        "excessHigh": number("excess_high"),
        "ed": number("ed_surge"),
    }
    staged = told.withColumns({f"_v_{k}": v for k, v in values.items()})
    values = {k: F.col(f"_v_{k}") for k in values}
    texts = {"_description": text.fill_template("description", values)} | {f"_{c}": F.when(~quiet, text.fill_template(c, values)) for c in ("headline", "sms")}
    staged = staged.withColumns(texts).join(audiences, ["language", "band"])
    actions = F.transform(F.col("actions"), lambda a: text.fill_template(a, values))
    return staged.select(
        "alert_id",
        "language",
        "audience",
        "band",
        F.col("label").alias("level_label"),
        F.col("_headline").alias("headline"),
        F.col("_sms").alias("sms"),
        F.col("_description").alias("description"),
        F.when(~quiet, actions).otherwise(F.array().cast("array<string>")).alias("actions"),
    )


def action_plan(audiences: DataFrame, band: str, language: str = "en", agencies: Sequence[str] = ("municipal", "hospitals", "power_utility", "schools")) -> DataFrame:
    """Actions of one level for four agencies as one map."""
    picked = audiences.where((F.col("band") == band) & (F.col("language") == language) & F.col("audience").isin(list(agencies)))
    return picked.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("audience", "actions")))).alias("plan"))


def message_text(advisories: DataFrame) -> Column:
    """Text of a message: chat channels carry the actions as a list."""
    bullets = F.concat(F.lit("\n\n• "), F.array_join("actions", "\n• "))
    return F.when(F.col("channel") == "whatsapp", F.concat(F.col("sms"), bullets)).otherwise(F.col("sms"))


def alert_documents(alerts: DataFrame, advisories: DataFrame, sender: str, sender_name: str, event_code: str = "HEAT", mode: str = "replay", note: str = "Historical replay. Not a live warning.", languages: Sequence[str] = ("en", "hi", "or")) -> DataFrame:
    """One CAP 1.2 document per alert with an info block per language.

    ``alerts`` needs ``alert_id, scope, place_id, name, band, lead, date, sent,
    htsi, q10, q90, mri, wbgt, p_warning, ring``. Where it also has ``msg_type``
    (Alert, Update, Cancel) and ``references`` (sender,identifier,sent of the
    alerts it follows), the document carries them.
    """
    esc = text.xml_escape
    given = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in alerts.columns else F.lit(other)

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"    <{name}>"), value, F.lit(f"</{name}>\n"))

    def pair(kind: str, name: str, value: Column) -> Column:
        return F.concat(F.lit(f"    <{kind}><valueName>{name}</valueName><value>"), F.coalesce(value, F.lit("")), F.lit(f"</value></{kind}>\n"))

    both = alerts.join(advisories.where("audience = 'public'").drop("band"), "alert_id").where(F.col("language").isin(list(languages)))
    day = F.col("date").cast("string")
    polygon = F.when(F.col("ring").isNotNull(), F.concat(F.lit("      <polygon>"), text.polygon_text("ring"), F.lit("</polygon>\n"))).otherwise(F.lit(""))
    band_text = F.concat(F.coalesce(text.fixed("q10", 1), F.lit("")), F.lit("-"), F.coalesce(text.fixed("q90", 1), F.lit("")))
    info = F.concat(
        F.lit("  <info>\n"),
        tag("language", text.language_tag("language")),
        F.lit("    <category>Met</category>\n    <category>Health</category>\n"),
        tag("event", esc("level_label")),
        tag("responseType", text.response_type("band")),
        tag("urgency", text.urgency("lead")),
        tag("severity", text.severity("band")),
        tag("certainty", text.certainty("lead", "p_warning")),
        pair("eventCode", event_code, F.concat(F.lit("HEAT-"), F.upper("band"))),
        tag("effective", F.col("sent")),
        tag("onset", F.concat(day, F.lit("T00:00:00+05:30"))),
        tag("expires", F.concat(day, F.lit("T23:59:59+05:30"))),
        tag("senderName", esc(F.lit(sender_name))),
        tag("headline", esc("headline")),
        tag("description", esc("description")),
        tag("instruction", esc(F.array_join("actions", " "))),
        pair("parameter", "HTSI", text.fixed("htsi", 1)),
        pair("parameter", "HTSI_80PCT_BAND", band_text),
        pair("parameter", "MRI", text.fixed("mri", 1)),
        pair("parameter", "WBGT_MAX_C", text.fixed("wbgt", 1)),
        F.lit("    <area>\n"),
        F.concat(F.lit("      <areaDesc>"), esc("name"), F.lit("</areaDesc>\n")),
        polygon,
        F.concat(F.lit(f"      <geocode><valueName>{event_code}_AREA</valueName><value>"), esc(F.concat_ws(":", "scope", "place_id")), F.lit("</value></geocode>\n")),
        F.lit("    </area>\n  </info>\n"),
    )
    order = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    kinds = both.withColumns({"_type": given("msg_type", "Alert"), "_refs": given("references", "")})
    blocks = kinds.groupBy("alert_id", "sent", "_type", "_refs").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), info.alias("x")))).alias("b"))
    status = "Actual" if mode == "live" else "Exercise"
    remark = f"  <note>{note}</note>\n" if status == "Exercise" else ""
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">\n  <identifier>'),
        esc("alert_id"), F.lit("</identifier>\n  <sender>"), esc(F.lit(sender)), F.lit("</sender>\n  <sent>"), F.col("sent"),
        F.lit(f"</sent>\n  <status>{status}</status>\n  <msgType>"), F.col("_type"), F.lit(f"</msgType>\n  <scope>Public</scope>\n{remark}"),
        F.when(F.col("_refs") == "", F.lit("")).otherwise(F.concat(F.lit("  <references>"), esc("_refs"), F.lit("</references>\n"))),
    )
    return blocks.select("alert_id", F.concat(head, F.array_join(F.transform("b", lambda b: b["x"]), ""), F.lit("</alert>\n")).alias("document"))
