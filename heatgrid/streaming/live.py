"""The live run as one stream: landed forecast responses become district payload rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from heatgrid.operators import climatology, index, risk
from heatgrid.operators.daily import NIGHT_INDICES, day_statistics
from heatgrid.params import ExposureResponse
from heatgrid.sources.weather import NWP_SCHEMA, nwp_rows
from heatgrid.streaming.daily import LATENESS, event_time

AT = "day_end"  # event time of every step: the last instant of the day. Processors rename columns with a leading underscore


class NightsAndSpells(StatefulProcessor):
    """Adds a cell's night minima and hot-day run to its days, which come closed and so in the order of dates.

    Remembers one row a cell: the last date, its evening minima and the run.
    """

    def __init__(self, night: Sequence[str]):
        self.night = list(night)

    def init(self, handle: StatefulProcessorHandle) -> None:
        evenings = ", ".join(f"{c} double" for c in self.night)
        self.last = handle.getValueState("last", f"day int, run int, {evenings}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows), ignore_index=True).sort_values("day_no", ignore_index=True)
        day, run, *evening = self.last.get() if self.last.exists() else (None, 0, *[None] * len(self.night))
        runs, minima = [], {c: [] for c in self.night}
        for r in days.to_dict("records"):
            run = run + 1 if r["hot"] else 0
            runs.append(run)
            for i, c in enumerate(self.night):
                parts = [r[f"{c}_morning"], evening[i] if day is not None and r["day_no"] == day + 1 else None]
                minima[c].append(min((x for x in parts if x is not None and not pd.isna(x)), default=None))
            day, evening = int(r["day_no"]), [None if pd.isna(r[f"{c}_evening"]) else float(r[f"{c}_evening"]) for c in self.night]
        self.last.update((day, run, *evening))
        drop = ["hot", "day_no", *[f"{c}_{part}" for c in self.night for part in ("evening", "morning")]]
        yield days.drop(columns=drop).assign(spell_days=runs, **{f"{c}_night_min": pd.Series(minima[c], dtype="float64") for c in self.night})

    def close(self) -> None:
        pass


class Lags(StatefulProcessor):
    """Adds a place's values of the days before; remembers only these."""

    def __init__(self, value: str, names: Sequence[str]):
        self.value, self.names = value, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", ", ".join(f"{n} double" for n in self.names))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows), ignore_index=True).sort_values(AT, ignore_index=True)
        held = list(self.before.get()) if self.before.exists() else [None] * len(self.names)
        out = []
        for v in days[self.value]:
            held = [None if pd.isna(v) else float(v), *held][: len(self.names)]
            out.append(held)
        self.before.update(tuple(held))
        lagged = pd.DataFrame(out, columns=self.names, dtype="float64")
        yield pd.concat([days, lagged], axis=1)

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, key: str, processor: StatefulProcessor, drop: Sequence[str], add: Sequence[StructField]) -> DataFrame:
    """A processor over the days of each key; the event time goes on to the next step."""
    schema = StructType([*[f for f in df.schema.fields if f.name not in drop], *add])
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=AT
    )


def closed_days(hours: DataFrame, indices: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """Statistics of every cell and day once the watermark has passed the day."""
    days = event_time(hours, lateness).groupBy("cell_id", F.window("_at", "1 day")).agg(*day_statistics(indices))
    return days.withColumns({AT: F.window_time("window"), "date": F.to_date("window.start")}).drop("window")


def indexed_days(days: DataFrame, clim: DataFrame, indices: Sequence[str]) -> DataFrame:
    """Closed days with climatology, night minima, spells, index and band."""
    night = [c for c in NIGHT_INDICES if c in indices]
    ranked = climatology.attach_anomaly(days, clim)
    marked = ranked.withColumns({"hot": F.coalesce(index.hot_day(ranked), F.lit(False)), "day_no": F.unix_date("date")})
    drop = ["hot", "day_no", *[f"{c}_{part}" for c in night for part in ("evening", "morning")]]
    add = [StructField("spell_days", IntegerType()), *[StructField(f"{c}_night_min", DoubleType()) for c in night]]
    return index.score(_keyed(marked, "cell_id", NightsAndSpells(night), drop, add))


def district_payload(days: DataFrame, cells: DataFrame, baseline: DataFrame, vuln: DataFrame, curve: ExposureResponse | None = None) -> DataFrame:
    """Payload row of every district and day: index, risk and the index of the days before.

    ``cells`` (cell_id, ahs_code) names the district of each cell; cells that it does not name take no part.
    """
    curve = curve or ExposureResponse()
    placed = days.join(cells.select("cell_id", "ahs_code"), "cell_id")
    means = placed.groupBy("ahs_code", F.window(AT, "1 day")).agg(*risk.district_statistics(days.columns))
    means = means.withColumns({AT: F.window_time("window"), "date": F.to_date("window.start")}).drop("window")
    names = [f"lag{k}" for k in range(len(curve.lag_weights))]
    lagged = _keyed(risk.attach_baseline(means, baseline, vuln), "ahs_code", Lags("htsi", names), [], [StructField(n, DoubleType()) for n in names])
    return risk.excess_deaths(lagged, names, curve).drop(AT)


def live_payload(hours: DataFrame, clim: DataFrame, cells: DataFrame, baseline: DataFrame, vuln: DataFrame, indices: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """From a stream of hourly indices (cell_id, ts_ist, indices) to payload rows, four keyed steps in one query.

    Hours are summed up by day; closed days meet the climatology and go through each cell's state, which holds one row;
    days of a district's cells are averaged; each district's state holds the index of the last days. A day shows when the
    watermark, ``lateness`` behind the latest hour, has passed it; :func:`end_feed` closes a feed that has ended. The
    result equals the batch jobs on the same hours. It needs the RocksDB state store provider.
    """
    days = indexed_days(closed_days(hours, indices, lateness), clim, indices)
    return district_payload(days, cells, baseline, vuln)


def landed_hours(spark: SparkSession, path: str) -> DataFrame:
    """Hourly weather from a folder in which forecast responses land as JSON."""
    return nwp_rows(spark.readStream.schema(NWP_SCHEMA).json(path))


def end_feed(spark: SparkSession, path: str, last: str, days: int = 3) -> None:
    """Land a response of cell -1, ``days`` after the date ``last``, which moves the watermark past every day before.

    Its own day never closes, so the cell is in no result.
    """
    stamp = F.date_format(F.date_add(F.lit(last).cast("date"), days + 1).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm")
    fields = {"time": F.array(stamp), **{c: F.array(F.lit(1.0)) for c in ("temperature_2m", "dew_point_2m", "surface_pressure", "wind_speed_10m", "shortwave_radiation")}}
    row = spark.range(1).select(F.lit(-1).alias("cell_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("hourly"))
    row.coalesce(1).write.mode("append").json(path)
