"""All registered queries."""

from __future__ import annotations

from heatgrid.plans import alerting, files, forecasting, people, streams, weather
from heatgrid.plans.common import Query

QUERIES: dict[str, Query] = {**weather.QUERIES, **people.QUERIES, **alerting.QUERIES, **forecasting.QUERIES, **files.QUERIES, **streams.QUERIES}
