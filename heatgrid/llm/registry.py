"""Registered queries of this subpackage."""

from __future__ import annotations

from heatgrid.llm import chunks, exact, licences, mixing, neighbours, packing, pages, quality, resampling, sharding, simhash, spelling, toxicity
from heatgrid.plans.common import Query

QUERIES: dict[str, Query] = {**simhash.QUERIES, **quality.QUERIES, **toxicity.QUERIES, **sharding.QUERIES, **packing.QUERIES, **chunks.QUERIES, **licences.QUERIES, **neighbours.QUERIES, **pages.QUERIES, **mixing.QUERIES, **exact.QUERIES, **spelling.QUERIES, **resampling.QUERIES}
