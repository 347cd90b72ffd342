"""Cooling-centre siting: coverage pairs, greedy cover and what-if totals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.functions.geo import EARTH_RADIUS_KM, haversine_km
from heatgrid.functions.scaling import interventions_keep
from heatgrid.params import InterventionParams
from heatgrid.session import cut_lineage

HELD = 4096  # sites or points of one spot that are held together


def coverage_pairs(sites: DataFrame, points: DataFrame, radius_km: float, by: str = "city", site_id: str = "site_id", point_id: str = "ward_id") -> DataFrame:
    """(site, point) of the same city within a radius.

    Latitude is cut into bands one radius high, and longitude into columns at
    least one radius wide at the band edge nearest the pole, so a match lies in
    the site's band or a neighbour. Only close pairs are ever formed. Sites, or
    points, of one spot are compared once, a few thousand together, and written
    out behind the comparison.
    """
    step = math.degrees(radius_km / EARTH_RADIUS_KM) * (1 + 1e-9)

    def band(lat):
        return F.floor(F.col(lat) / F.lit(step)).cast("long")

    def column(lon, band_col):
        poleward = F.greatest(F.abs(band_col), F.abs(band_col + 1)) * F.lit(step)
        width = F.lit(step) / F.greatest(F.cos(F.radians(F.least(poleward, F.lit(89.0)))), F.lit(1e-6))
        return F.floor(F.col(lon) / width).cast("long")

    def spots(df, key, name, lat, lon):
        unnamed = F.array_repeat(F.lit(None).cast(df.schema[key].dataType), F.count_if(F.col(key).isNull()).cast("int"))
        held = df.groupBy(by, F.col("lat").alias(lat), F.col("lon").alias(lon)).agg(F.concat(F.collect_list(key), unnamed).alias(name))
        few = F.transform(F.sequence(F.lit(0), ((F.size(name) - 1) / HELD).cast("int")), lambda i: F.slice(name, i * HELD + 1, HELD))
        return held.withColumn(name, F.explode(few))

    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    s = (
        spots(sites, site_id, "_sites", "_slat", "_slon")
        .withColumn("_band", F.explode(F.transform(near, lambda i: band("_slat") + i)))
        .withColumn("_col", F.explode(F.transform(near, lambda i: column("_slon", F.col("_band")) + i)))
    )
    p = spots(points, point_id, "_points", "_plat", "_plon").withColumn("_band", band("_plat"))
    p = p.withColumn("_col", column("_plon", F.col("_band")))
    dist = haversine_km("_slat", "_slon", "_plat", "_plon")
    keys, parts = [by, "_band", "_col"], max(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), sites.sparkSession.sparkContext.defaultParallelism)
    met = s.repartition(parts, *keys).hint("merge").join(p.repartition(parts, *keys), keys).withColumn("distance_km", dist).where(F.col("distance_km") <= radius_km)
    each = met.select(by, F.explode("_sites").alias("site_id"), "_points", "distance_km")
    return each.select(by, "site_id", F.explode("_points").alias("ward_id"), "distance_km")


def max_cover(pairs: DataFrame, demand: DataFrame, n: int, by: str = "city", recomputed: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Greedy maximal cover of every city at once.

    The gain of every site is summed once. Each round takes the best site of
    every city; then only the sites that share a newly covered point with it
    are summed again, over their points that are still uncovered: the gains of
    the others stand. The pairs are written once and never rewritten. A city
    stops once the best gain is zero (after its first pick). Returns the chosen
    sites (city, rank, site, gain) and the covered points (city, ward, rank).
    ``recomputed`` receives the number of pairs summed in every round.
    """
    left = cut_lineage(pairs.join(demand.select("ward_id", "demand"), "ward_id").select(by, "site_id", "ward_id", "demand"))
    gains = cut_lineage(left.groupBy(by, "site_id").agg(F.sum("demand").alias("gain")))
    if recomputed is not None:
        recomputed.append(left.count())
    chosen = covered = None
    for rank in range(1, n + 1):
        best = gains.groupBy(by).agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("site_id"))).alias("b"))
        best = best.select(by, F.col("b.site_id").alias("site_id"), (-F.col("b.g")).alias("gain"))
        if rank > 1:
            best = best.where("gain > 0")
        best = cut_lineage(best.withColumn("rank", F.lit(rank)))
        if best.isEmpty():
            break
        got = left.join(best.select(by, "site_id"), [by, "site_id"], "left_semi").select(by, "ward_id")
        if covered is not None:
            got = got.join(covered.select(by, "ward_id"), [by, "ward_id"], "left_anti")
        got = cut_lineage(got.withColumn("rank", F.lit(rank)))
        chosen = best if chosen is None else chosen.unionByName(best)
        covered = got if covered is None else covered.unionByName(got)
        if rank < n:
            touched = cut_lineage(left.join(got.select(by, "ward_id"), [by, "ward_id"], "left_semi").select(by, "site_id").distinct())
            open_pairs = left.join(touched, [by, "site_id"], "left_semi").join(covered.select(by, "ward_id"), [by, "ward_id"], "left_anti")
            fresh = open_pairs.groupBy(by, "site_id").agg(F.sum("demand").alias("gain"), F.count("*").alias("_n"))
            fresh = cut_lineage(fresh)
            if recomputed is not None:
                recomputed.append(int(fresh.agg(F.sum("_n")).first()[0] or 0))
            gains = cut_lineage(gains.join(touched, [by, "site_id"], "left_anti").unionByName(fresh.drop("_n")))
    return chosen, covered


def locations(wards: DataFrame, by: str = "city") -> DataFrame:
    """Wards at the same spot as one location under their smallest id, with their number."""
    return wards.groupBy(by, "lat", "lon").agg(F.min("ward_id").alias("ward_id"), F.sum("demand").alias("demand"), F.count("*").alias("n_wards"))


def coverage(wards: DataFrame, radius_km: float = InterventionParams.radius_km, by: str = "city") -> tuple[DataFrame, DataFrame]:
    """Coverage between the wards of a city, compressed: (pairs of spots, membership).

    Pairs are (city, site_spot, ward_spot, distance_km, n_sites, n_wards): every
    ward at the first spot reaches every ward at the second. A spot goes by its
    smallest ward_id; the membership (city, spot, ward_id) has one row for each
    ward. Their join is the list of all pairs, which grows with the square of a
    crowded spot and is never formed here.
    """
    spots = cut_lineage(locations(wards, by))
    size = lambda spot, name: spots.select(by, F.col("ward_id").alias(spot), F.col("n_wards").alias(name))
    pairs = coverage_pairs(spots, spots, radius_km, by, site_id="ward_id").withColumnsRenamed({"site_id": "site_spot", "ward_id": "ward_spot"})
    pairs = pairs.join(size("site_spot", "n_sites"), [by, "site_spot"]).join(size("ward_spot", "n_wards"), [by, "ward_spot"])
    members = wards.select(by, "lat", "lon", "ward_id").join(spots.select(by, "lat", "lon", F.col("ward_id").alias("spot")), [by, "lat", "lon"])
    return pairs.select(by, "site_spot", "ward_spot", "distance_km", "n_sites", "n_wards"), members.select(by, "spot", "ward_id")


def cooling_plan(wards: DataFrame, n: int, radius_km: float = InterventionParams.radius_km, by: str = "city") -> tuple[DataFrame, DataFrame]:
    """Chosen centres and covered wards of every city, each ward being a candidate.

    Pairs are formed between distinct locations only; wards that share a spot
    are covered together and expanded at the end.
    """
    spots = cut_lineage(locations(wards, by).drop("n_wards"))
    chosen, covered = max_cover(coverage_pairs(spots, spots, radius_km, by, site_id="ward_id"), spots, n, by)
    at = spots.withColumnRenamed("ward_id", "_spot").drop("demand")
    members = wards.select(by, "lat", "lon", "ward_id").join(at, [by, "lat", "lon"])
    hit = covered.withColumnRenamed("ward_id", "_spot")
    return chosen, members.join(hit, [by, "_spot"]).select(by, "ward_id", "rank")


def cover_summary(chosen: DataFrame, covered: DataFrame, demand: DataFrame, averted: float = InterventionParams.cooling_centre, by: str = "city") -> DataFrame:
    """Covered wards, demand share and excess per city."""
    hit = covered.select(by, "ward_id").distinct().withColumn("_hit", F.lit(True))
    joined = demand.join(hit, [by, "ward_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    inside = lambda c: F.sum(F.when(F.col("_hit"), F.col(c)).otherwise(F.lit(0.0)))
    totals = joined.groupBy(by).agg(
        F.count_if(F.col("_hit")).alias("covered_wards"),
        F.count("*").alias("total_wards"),
        F.coalesce(F.try_divide(inside("demand"), F.sum("demand")), F.lit(0.0)).alias("covered_demand_share"),
        inside("excess").alias("covered_excess"),
        F.sum("excess").alias("total_excess"),
    )
    centres = chosen.groupBy(by).agg(F.count("*").alias("centres"))
    return totals.join(centres, by, "left").withColumn("estimated_averted", F.col("covered_excess") * F.lit(averted))


def counterfactual(demand: DataFrame, covered: DataFrame, work_hours: bool = False, advisories: bool = False, p: InterventionParams | None = None, by: str = "city") -> DataFrame:
    """Totals before and after the measures, with low and high variants."""
    p = p or InterventionParams()
    hit = covered.select(by, "ward_id").distinct().withColumn("_hit", F.lit(True))
    keep = interventions_keep(F.coalesce(F.col("_hit"), F.lit(False)), work_hours, advisories, p)
    joined = demand.join(hit, [by, "ward_id"], "left").withColumn("_keep", keep)
    aggs = []
    for c in ("excess", "low", "high"):
        aggs += [
            F.sum(c).alias(f"baseline_{c}"),
            F.sum(F.col(c) * F.col("_keep")).alias(f"after_{c}"),
            F.sum(F.col(c) * (F.lit(1.0) - F.col("_keep"))).alias(f"averted_{c}"),
        ]
    return joined.groupBy(by).agg(*aggs)


def sites_by_city(sites: DataFrame, cols: Sequence[str], by: str = "city") -> DataFrame:
    """Candidate sites of the export, one row for each, by city; however many a city has, the form is the same."""
    return sites.where(F.col(by).isNotNull()).select(by, *cols).distinct()


def write_sites(sites: DataFrame, path: str, by: str = "city") -> None:
    """One folder for each city, its files as many as its rows need."""
    sites.write.mode("overwrite").partitionBy(by).parquet(path)
