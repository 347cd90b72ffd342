"""Districts, cells and wards: keys, assignment and vulnerability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.functions import geo, text
from heatgrid.functions.base import clip, col
from heatgrid.operators.nearest import nearest_k
from heatgrid.params import RiskParams

# District table: fixed values (code, name, its two other spellings, head-quarters with latitude and longitude, Census 2011
# population, approximate centroid, area in km2, further spellings).
DISTRICTS = [
    (1, "BARGARH", "BARGARH", "Bargarh", "Bargarh", 21.333, 83.619, 1481255, 21.25, 83.45, 5837, []),
    (2, "JHARSUGUDA", "JHARSUGUDA", "Jharsuguda", "Jharsuguda", 21.855, 84.006, 579505, 21.8, 84.05, 2081, []),
    (3, "SAMBALPUR", "SAMBALPUR", "Sambalpur", "Sambalpur", 21.467, 83.981, 1041099, 21.45, 84.25, 6657, []),
    (4, "DEBAGARH", "DEOGARH", "Debagarh", "Debagarh", 21.538, 84.733, 312520, 21.55, 84.75, 2940, ["DEOGARH"]),
    (5, "SUNDARGARH", "SUNDARGARH", "Sundargarh", "Sundargarh", 22.117, 84.030, 2093437, 22.1, 84.45, 9712, []),
    (6, "KENDUJHAR", "KEONJHAR (KENDUJHAR)", "Kendujhar", "Kendujhar", 21.630, 85.582, 1801733, 21.55, 85.55, 8303, ["KEONJHAR"]),
    (7, "MAYURBHANJ", "MAYURBHANJ", "Mayurbhanj", "Baripada", 21.936, 86.727, 2519738, 21.9, 86.3, 10418, []),
    (8, "BALESHWAR", "BALASORE", "Baleshwar", "Balasore", 21.494, 86.932, 2320529, 21.45, 86.75, 3806, ["BALASORE"]),
    (9, "BHADRAK", "BHADRAK", "Bhadrak", "Bhadrak", 21.058, 86.496, 1506337, 21.05, 86.55, 2505, []),
    (10, "KENDRAPARA", "KENDRAPARA", "Kendrapara", "Kendrapara", 20.502, 86.422, 1440361, 20.55, 86.6, 2644, []),
    (11, "JAGATSINGHAPUR", "JAGATSINGHPUR", "Jagatsinghapur", "Jagatsinghapur", 20.256, 86.171, 1136971, 20.2, 86.3, 1668, ["JAGATSINGHPUR"]),
    (12, "CUTTACK", "CUTTACK", "Cuttack", "Cuttack", 20.463, 85.883, 2624470, 20.45, 85.8, 3932, []),
    (13, "JAJAPUR", "JAJAPUR", "Jajapur", "Jajpur", 20.849, 86.334, 1827192, 20.85, 86.1, 2899, ["JAJPUR"]),
    (14, "DHENKANAL", "DHENKANAL", "Dhenkanal", "Dhenkanal", 20.659, 85.598, 1192811, 20.75, 85.55, 4452, []),
    (15, "ANUGUL", "ANUGUL", "Anugul", "Angul", 20.840, 85.102, 1273821, 21.0, 84.95, 6375, ["ANGUL"]),
    (16, "NAYAGARH", "NAYAGARH", "Nayagarh", "Nayagarh", 20.129, 85.096, 962789, 20.15, 85.0, 3890, []),
    (17, "KHORDHA", "KHORDHA", "Khordha", "Bhubaneswar", 20.296, 85.825, 2251673, 20.1, 85.55, 2813, ["KHURDA", "KHORDHA_BHUBANESWAR"]),
    (18, "PURI", "PURI", "Puri", "Puri", 19.813, 85.831, 1698730, 19.85, 85.8, 3479, []),
    (19, "GANJAM", "GANJAM", "Ganjam", "Chhatrapur", 19.315, 84.794, 3529031, 19.55, 84.7, 8206, []),
    (20, "GAJAPATI", "GAJAPATI", "Gajapati", "Paralakhemundi", 18.781, 84.093, 577817, 19.05, 84.1, 4325, []),
    (21, "KANDHAMAL", "KANDHAMAL", "Kandhamal", "Phulbani", 20.471, 84.233, 733110, 20.25, 84.1, 8021, []),
    (22, "BAUDH", "BOUDH", "Baudh", "Baudh", 20.836, 84.325, 441162, 20.65, 84.3, 3098, ["BOUDH"]),
    (23, "SONAPUR", "SUBARNAPUR", "Subarnapur", "Sonepur", 20.833, 83.913, 610183, 20.85, 83.85, 2337, ["SUBARNAPUR", "SONEPUR"]),
    (24, "BALANGIR", "BALANGIR", "Balangir", "Balangir", 20.707, 83.484, 1648997, 20.6, 83.3, 6575, ["BOLANGIR"]),
    (25, "NUAPADA", "NUAPARHA", "Nuapada", "Nuapada", 20.817, 82.534, 610382, 20.6, 82.6, 3852, ["NUAPARHA"]),
    (26, "KALAHANDI", "KALAHANDI", "Kalahandi", "Bhawanipatna", 19.907, 83.167, 1576869, 19.95, 83.15, 7920, []),
    (27, "RAYAGADA", "RAYAGARHA", "Rayagada", "Rayagada", 19.171, 83.416, 967911, 19.35, 83.5, 7073, ["RAYAGARHA"]),
    (28, "NABARANGAPUR", "NABARANGAPUR", "Nabarangapur", "Nabarangpur", 19.232, 82.549, 1220946, 19.4, 82.35, 5291, ["NABARANGPUR"]),
    (29, "KORAPUT", "KORAPUT", "Koraput", "Koraput", 18.812, 82.711, 1379647, 18.75, 82.75, 8807, []),
    (30, "MALKANGIRI", "MALKANGIRI", "Malkangiri", "Malkangiri", 18.348, 81.888, 613192, 18.3, 81.95, 5791, []),
]
DISTRICT_SCHEMA = (
    "ahs_code int, district string, hvi_name string, nfhs_name string, hq string, hq_lat double, hq_lon double, "
    "pop_2011 long, c_lat double, c_lon double, area_km2 int, aliases array<string>"
)
CENSUS_CODE_SHIFT = 360


def district_table(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(DISTRICTS, DISTRICT_SCHEMA)
    return df.withColumn("census_2011_code", F.col("ahs_code") + CENSUS_CODE_SHIFT)


def crosswalk(districts: DataFrame) -> DataFrame:
    """(alias, ahs_code): every normalised spelling of a district.

    A spelling claimed by two districts belongs to the later code.
    """
    names = ["district", "hvi_name", "nfhs_name", "hq"]
    spelled = F.array_union(
        text.name_aliases(*[c for c in names if c in districts.columns]),
        F.transform(F.col("aliases"), text.normalise_name) if "aliases" in districts.columns else F.array().cast("array<string>"),
    )
    return (
        districts.select("ahs_code", F.explode(spelled).alias("alias"))
        .groupBy("alias")
        .agg(F.max("ahs_code").alias("ahs_code"))
    )


def resolve_keys(
    df: DataFrame, key: str, walk: DataFrame, on_unknown: str = "fail", name: str = "ahs_code", last_code: int = 30
) -> DataFrame:
    """District code for any spelling, code or census code; unknown keys stop the job."""
    a = walk.select(F.col("alias").alias("_full"), F.col("ahs_code").alias("_by_full"))
    b = walk.select(F.col("alias").alias("_head"), F.col("ahs_code").alias("_by_head"))
    raw = F.col(key).cast("string")
    number = F.when(F.trim(raw).rlike(r"^\d+$"), F.expr(f"try_cast(trim(cast(`{key}` AS string)) AS int)"))
    coded = F.when(number.between(1, last_code), number).when(
        number.between(CENSUS_CODE_SHIFT + 1, CENSUS_CODE_SHIFT + last_code), number - CENSUS_CODE_SHIFT
    )
    joined = (
        df.withColumns({"_full": text.normalise_name(raw), "_head": text.first_token(raw)})
        .join(a, "_full", "left")
        .join(b, "_head", "left")
    )
    found = F.when(number.isNotNull(), coded).otherwise(F.coalesce("_by_full", "_by_head"))
    if on_unknown == "fail":
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("unresolvable district identifier: "), F.coalesce(raw, F.lit("NULL")))))
    return joined.withColumn(name, found.cast("int")).drop("_full", "_head", "_by_full", "_by_head")


def assign_cells(cells: DataFrame, districts: DataFrame, reach: float = 1.2) -> DataFrame:
    """District of every land cell by distance over the district's equivalent radius."""
    one = cells.groupBy("cell_id").agg(F.min(F.struct("lat", "lon")).alias("_c")).select("cell_id", "_c.lat", "_c.lon")
    dim = districts.select(
        "ahs_code",
        F.col("c_lat").alias("lat"),
        F.col("c_lon").alias("lon"),
        (F.sqrt(F.col("area_km2") / F.lit(math.pi)) / F.lit(geo.KM_PER_DEGREE)).alias("radius"),
    )
    best = nearest_k(one, dim, 1, target_id="ahs_code", scale="radius").select("lat", "lon", "ahs_code", F.col("score").alias("ratio"))
    return (
        one.join(best, ["lat", "lon"], "left")
        .withColumn("is_sea", geo.is_sea("lat", "lon"))
        .withColumn("inside", ~F.col("is_sea") & F.coalesce(F.col("ratio") <= reach, F.lit(False)))
    )


def fill_holes(cells: DataFrame, min_neighbours: int = 5, passes: int = 2, resolution: float = 0.25) -> DataFrame:
    """Take in land cells with enough of their eight neighbours inside."""
    spots = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    )
    grid = cells.withColumns(
        {
            "_y": F.round(F.col("lat") / F.lit(resolution)).cast("long"),
            "_x": F.round(F.col("lon") / F.lit(resolution)).cast("long"),
        }
    )
    for _ in range(passes):
        around = (
            grid.where("inside")
            .select("_y", "_x", F.explode(spots).alias("_s"))
            .groupBy((F.col("_y") + F.col("_s.i")).alias("_y"), (F.col("_x") + F.col("_s.j")).alias("_x"))
            .agg(F.count("*").alias("_near"))
        )
        joined = grid.join(around, ["_y", "_x"], "left")
        grown = F.col("inside") | (~F.col("is_sea") & (F.coalesce(F.col("_near"), F.lit(0)) >= min_neighbours))
        grid = joined.withColumn("inside", grown).drop("_near")
    return grid.drop("_y", "_x")


def cell_districts(cells: DataFrame, districts: DataFrame, reach: float = 1.2) -> DataFrame:
    """Cells with their district code, or NULL outside the state."""
    out = fill_holes(assign_cells(cells, districts, reach)).join(districts.select("ahs_code", "district"), "ahs_code", "left")
    inside = F.col("inside")
    return out.select(
        "cell_id",
        "lat",
        "lon",
        F.when(inside, F.col("ahs_code")).alias("ahs_code"),
        F.when(inside, F.col("district")).alias("district"),
        F.round("ratio", 3).alias("reach_ratio"),
        "is_sea",
        inside.alias("in_state"),
    )


def keep_in_state(df: DataFrame, cell_district: DataFrame) -> DataFrame:
    return df.join(cell_district.where("in_state").select("cell_id"), "cell_id", "left_semi")


def attach_district(daily: DataFrame, cell_district: DataFrame) -> DataFrame:
    return daily.join(cell_district.where("in_state").select("cell_id", "ahs_code"), "cell_id")


def zscores(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """(x - mean) / sample deviation within a group; flat groups and gaps give 0.

    The group figures come from an aggregation with partial sums, so a group of
    any size is never gathered.
    """
    stats = df.groupBy(by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols]
    )
    joined = df.join(stats, by, "left")

    def z(c: str) -> Column:
        spread = F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        return F.coalesce((F.col(c) - F.col(f"_m_{c}")) / spread, F.lit(0.0))

    return joined.withColumns({f"z_{c}": z(c) for c in cols}).drop(*[f"_{k}_{c}" for k in "ms" for c in cols])


# Weights of what varies inside a city: fixed values.
WARD_WEIGHTS = {"elderly_pct": 0.06, "slum_pop_pct": 0.08, "built_up_frac": 0.05}


def ward_vulnerability(wards: DataFrame, vulnerability: DataFrame, risk: RiskParams | None = None) -> DataFrame:
    """District score adjusted by what varies inside the city, and the multiplier."""
    risk = risk or RiskParams()
    base = vulnerability.select("ahs_code", F.col("vuln_score").alias("_base"))
    scored = zscores(wards, list(WARD_WEIGHTS), "city").join(base, "ahs_code", "left")
    shift = sum((F.lit(w) * F.col(f"z_{c}") for c, w in WARD_WEIGHTS.items()), F.lit(0.0))
    score = clip(F.col("_base") + shift, 0.0, 1.0)
    return (
        scored.withColumn("vuln_score", score)
        .withColumn("vuln_mult", F.lit(risk.vuln_mult_min) + F.lit(risk.vuln_mult_max - risk.vuln_mult_min) * F.col("vuln_score"))
        .drop("_base", *[f"z_{c}" for c in WARD_WEIGHTS])
    )


def places(wards: DataFrame, districts: DataFrame) -> DataFrame:
    """Wards and districts as one list of alert places."""
    w = wards.select(
        F.lit("ward").alias("scope"), F.col("ward_id").cast("string").alias("id"), F.col("ward_name").alias("name"),
        F.col("city").cast("string").alias("city"), F.col("ahs_code").cast("string").alias("district"),
    )
    d = districts.select(
        F.lit("district").alias("scope"), F.col("ahs_code").cast("string").alias("id"), F.col("district").alias("name"),
        F.lit(None).cast("string").alias("city"), F.col("ahs_code").cast("string").alias("district"),
    )
    return w.unionByName(d)


def district_star(districts: DataFrame, vulnerability: DataFrame, summary: DataFrame, nfhs: DataFrame) -> DataFrame:
    """District facts joined on the code; indicators may be absent."""
    return (
        districts.join(vulnerability.drop("district"), "ahs_code")
        .join(summary, "ahs_code")
        .join(nfhs.drop(*[c for c in nfhs.columns if c != "ahs_code" and c in (*districts.columns, *vulnerability.columns, *summary.columns)]), "ahs_code", "left")
    )




def title_case(c) -> Column:
    return F.initcap(col(c))
