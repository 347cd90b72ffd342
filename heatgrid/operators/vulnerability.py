"""Heat vulnerability from scaled indicators in three pillars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.ranking import average_ranks, quantile_tiers, with_rank_desc
from heatgrid.params import RiskParams
from heatgrid.session import cut_lineage

# Pillars as indicator -> direction (+1: more is worse), weights and tiers: fixed values.
PILLARS = {
    "exposure": {
        "lst_day_mean": 1, "lst_afternoon_mean": 1, "built_surface_mean": 1, "urban_lc_fraction": 1, "viirs_ntl_mean": 1,
    },
    "sensitivity": {
        "elderly_pct": 1, "children_pct": 1, "women_high_bp_pct": 1, "men_high_bp_pct": 1,
        "women_high_sugar_pct": 1, "men_high_sugar_pct": 1, "women_anaemic_pct": 1,
    },
    "adaptive": {
        "electricity_pct": -1, "improved_water_pct": -1, "improved_sanitation_pct": -1, "clean_fuel_pct": -1,
        "health_insurance_pct": -1, "women_literate_pct": -1, "green_fraction": -1, "healthcare_travel_min": 1,
    },
}
EXPERT_WEIGHTS = {"exposure": 0.30, "sensitivity": 0.40, "adaptive": 0.30}
TIERS = ("Very Low", "Low", "Moderate", "High", "Very High")
FLAT_COLUMNS = ("mpi_poverty_pct", "literacy_pct", "outdoor_workers_pct", "sc_st_pct")


def minmax(df: DataFrame, directions: Mapping[str, int], prefix: str = "n_") -> DataFrame:
    """Scale columns to 0..1 over all rows; a flat column becomes 0.5."""
    spans = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in directions])).scalar()

    def scaled(c: str, sign: int) -> Column:
        lo, hi = F.col(f"_spans.{c}.lo").cast("double"), F.col(f"_spans.{c}.hi").cast("double")
        x = (F.col(c) - lo) / (hi - lo)
        flat = lo.isNull() | (hi - lo < 1e-12)
        return F.when(flat, F.lit(0.5)).otherwise(x if sign > 0 else F.lit(1.0) - x)

    held = df.withColumn("_spans", spans)
    return held.withColumns({f"{prefix}{c}": scaled(c, s) for c, s in directions.items()}).drop("_spans")


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the columns that hold a value."""
    values = F.array_compact(F.array(*cols))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def constant_columns(df: DataFrame, cols: Sequence[str] = FLAT_COLUMNS) -> DataFrame:
    """One row per column: distinct values and whether it is flat.

    Flatness needs only the smallest and largest value, not a distinct count.
    """
    present = [c for c in cols if c in df.columns]
    row = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in present])
    return row.unpivot([], present, "column_name", "is_constant")


def first_component(df: DataFrame, cols: Sequence[str], like: str, name: str = "vuln_pca") -> tuple[DataFrame, float]:
    """Score on the first principal component, oriented like another column.

    Returns the frame and the share of variance the component explains. Rows
    are projected in place; only the component itself is held by the driver.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    df = df.withColumn("_means", means)
    centred = df.withColumns({f"_c_{c}": F.coalesce(F.col(c) - F.col(f"_means.{c}"), F.lit(0.0)) for c in cols})
    vectors = VectorAssembler(inputCols=[f"_c_{c}" for c in cols], outputCol="_x").transform(centred)
    vectors = cut_lineage(vectors.drop("_means"))
    model = PCA(k=1, inputCol="_x", outputCol="_pc").fit(vectors)
    scored = model.transform(vectors).withColumn(name, vector_to_array("_pc")[0])
    sign = F.when(scored.agg(F.corr(name, like)).scalar() < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    out = scored.withColumn(name, F.col(name) * sign).drop("_x", "_pc", *[f"_c_{c}" for c in cols])
    return out, float(model.explainedVariance[0])


def composite(df: DataFrame, pillars: Mapping[str, Mapping[str, int]] = PILLARS, weights: Mapping[str, float] = EXPERT_WEIGHTS) -> DataFrame:
    """Scaled indicators, pillar means and the equal and expert composites."""
    scaled = minmax(df, {c: s for items in pillars.values() for c, s in items.items()})
    pillared = scaled.withColumns({f"pillar_{p}": row_mean([f"n_{c}" for c in items]) for p, items in pillars.items()})
    expert = sum((F.lit(float(weights[p])) * F.col(f"pillar_{p}") for p in pillars), F.lit(0.0))
    return pillared.withColumns({"vuln_equal": row_mean([f"pillar_{p}" for p in pillars]), "vuln_expert": expert})


def score_and_tier(df: DataFrame, risk: RiskParams | None = None, key: str = "vuln_equal") -> DataFrame:
    """0..1 score, descending rank, quintile tier and risk multiplier."""
    risk = risk or RiskParams()
    scored = cut_lineage(minmax(df, {key: 1}, prefix="_s_").withColumnRenamed(f"_s_{key}", "vuln_score"))
    ranked = with_rank_desc(scored, "vuln_score", "vuln_rank")
    tiered = quantile_tiers(ranked, "vuln_score", TIERS, "vuln_tier", edges_from=scored)
    spread = F.lit(risk.vuln_mult_max - risk.vuln_mult_min)
    return tiered.withColumn("vuln_mult", F.lit(risk.vuln_mult_min) + spread * F.col("vuln_score"))


def vulnerability(df: DataFrame, pillars=PILLARS, weights=EXPERT_WEIGHTS, risk: RiskParams | None = None, pca: bool = True) -> DataFrame:
    """Full vulnerability table of the districts in ``df``."""
    out = composite(df, pillars, weights)
    if pca:
        indicators = [f"n_{c}" for items in pillars.values() for c in items]
        out, _ = first_component(out, indicators, "vuln_equal")
        out = minmax(out, {"vuln_pca": 1}, "_m_").drop("vuln_pca").withColumnRenamed("_m_vuln_pca", "vuln_pca")
    return score_and_tier(out, risk)


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rank correlation of every column pair, long form."""
    base = cut_lineage(df.select(*cols))
    ranked = base
    for c in cols:
        ranked = ranked.join(average_ranks(base, c, f"_r_{c}"), c, "left")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "rho")
    return long.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "rho"
    )
