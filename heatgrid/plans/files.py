"""Sources and sinks: tables written in a source format and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heatgrid.functions import scaling
from heatgrid.operators import alerts, mortality, places, reshape
from heatgrid.plans import fixtures as fx
from heatgrid.plans.common import Query, pick, rounded, table, with_ctes
from heatgrid.plans.people import LEVEL_SQL
from heatgrid.session import cut_lineage, scratch_path
from heatgrid.sources import documents, geojson, health, weather

QUERIES: dict[str, Query] = {}


def panel_roundtrip(spark, sf):
    """Year-partitioned panel written, a second write of the same years kept out, read back pruned."""
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).cast("int").alias("cell_id"), F.col("o_orderdate").cast("timestamp").alias("ts_utc"),
        (F.col("o_totalprice") / F.lit(101.0)).alias("T2M"), F.year("o_orderdate").alias("year"),
    )
    path = scratch_path(spark, "panel")
    weather.write_panel(o.where("year < 1998"), path)
    weather.write_panel(o.withColumn("T2M", F.when(F.col("year") < 1998, F.lit(0.0)).otherwise(F.col("T2M"))), path)
    back = weather.load_hourly(spark, path, years=[1996, 1997, 1999], columns=["year", "cell_id", "T2M"])
    return rounded(back.groupBy("year", "cell_id").agg(F.count("*").alias("n"), F.avg("T2M").alias("t")))


QUERIES["panel_roundtrip"] = (
    panel_roundtrip,
    "SELECT year(o_orderdate)::INTEGER AS year, (o_custkey % 40)::INTEGER AS cell_id, count(*) AS n, round(avg(o_totalprice / 101.0e0), 4) + 0.0e0 AS t FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1999) GROUP BY 1, 2",
)


def cell_year_files(spark, sf):
    """Hourly files named by cell and year, with others beside them that do not match, scanned back and counted by file."""
    h = fx.hourly(spark, sf).withColumns({"year": F.year("ts_utc"), "stamp": F.date_format("ts_utc", "yyyyMMddHH")})
    path = scratch_path(spark, "hourly")
    weather.write_cell_years(h, path)
    h.select("stamp").limit(3).write.mode("append").csv(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    raw = cut_lineage(weather.read_hourly_csv(spark, path).coalesce(parts))  # many small files, opened once
    cells = weather.inventory(raw)
    by_file = raw.groupBy("lat", "lon", "year").agg(F.count("*").alias("n"), F.min("stamp").alias("first"), F.max("stamp").alias("last"), F.avg("T2M").alias("t2m"), F.max("PS").alias("ps"))
    return rounded(by_file.join(cells, ["lat", "lon", "year"]))


QUERIES["cell_year_files"] = (
    cell_year_files,
    with_ctes("SELECT lat, lon, year(ts_utc)::INTEGER AS year, count(*) AS n, min(strftime(ts_utc, '%Y%m%d%H')) AS first, max(strftime(ts_utc, '%Y%m%d%H')) AS last, round(avg(t2m), 4) + 0.0e0 AS t2m, round(max(ps), 4) + 0.0e0 AS ps FROM hourly GROUP BY 1, 2, 3", fx.HOURLY),
)


def worst_offenders(spark, sf):
    """The first ten rows that break a rule, as an error message lists them."""
    e = table(spark, sf, "events").select("event_id", "value").where("event_id % 7 = 3 AND value < 40")
    return spark.createDataFrame(geojson.sample_violations(e, "event_id", 10), e.schema)


QUERIES["worst_offenders"] = (worst_offenders, "SELECT event_id, value FROM events WHERE event_id % 7 = 3 AND value < 40 ORDER BY event_id LIMIT 10")


def sorted_table(spark, sf):
    """Range-sorted table, with the place at which each row lies in its files."""
    path = scratch_path(spark, "sorted")
    weather.write_sorted(table(spark, sf, "events").select("user_id", "event_id"), ["user_id", "event_id"], path)
    back = spark.read.parquet(path).select("user_id", "event_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = back.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return back.join(starts, "file").select("user_id", "event_id", (F.col("start") + F.col("row")).alias("position"))


QUERIES["sorted_table"] = (sorted_table, "SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS position FROM events")


def pipe_microdata(spark, sf):
    """Pipe-separated survey file, decedent columns only, cleaned."""
    path = scratch_path(spark, "deaths")
    raw = fx.deaths_raw(spark, sf).withColumn("head_age", F.lit("44"))
    raw.write.option("header", True).option("sep", "|").csv(path)
    clean = mortality.clean_deaths(health.read_deaths(spark, path))
    return rounded(clean.groupBy("ahs_code", "age_band").agg(F.count("*").alias("n"), F.sum("wt").alias("wt"), F.count_if("day_known").alias("known")))


QUERIES["pipe_microdata"] = (
    pipe_microdata,
    with_ctes(
        "SELECT ahs_code, CASE WHEN age_years < 5 THEN '0-4' WHEN age_years < 15 THEN '5-14' WHEN age_years < 45 THEN '15-44' WHEN age_years < 65 THEN '45-64' WHEN age_years < 200 THEN '65+' END AS age_band, count(*) AS n, sum(wt)::DOUBLE AS wt, count(date) AS known FROM deaths GROUP BY 1, 2",
        fx.DEATHS,
    ),
)


def code_book(spark, sf):
    """Code-book sheet with title rows, other states and stray text."""
    path = scratch_path(spark, "codebook")
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    s.select(
        F.when(k % 10 == 0, "State").otherwise((F.lit(20) + k % 3).cast("string")).alias("a"), F.when(k % 11 == 0, "n/a").otherwise(k.cast("string")).alias("b"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("c")
    ).write.option("header", False).csv(path)
    return health.read_codebook(spark, path)


QUERIES["code_book"] = (code_book, "SELECT s_suppkey::INTEGER AS ahs_code, s_name AS codebook_name FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 10 <> 0 AND s_suppkey % 11 <> 0")


def hvi_file(spark, sf):
    """National indicator file: one state, the code kept as text."""
    path = scratch_path(spark, "hvi")
    c = table(spark, sf, "customer")
    c.select(
        F.when(F.col("c_custkey") % 4 == 0, "Odisha").when(F.col("c_custkey") % 4 == 1, "ODISHA").otherwise("Kerala").alias("state"),
        F.col("c_name").alias("district"), F.lpad((F.col("c_custkey") % 100).cast("string"), 3, "0").alias("dist_code"),
        F.when(F.col("c_custkey") % 5 == 0, "na").otherwise(F.col("c_acctbal").cast("string")).alias("elderly_pct"),
    ).write.option("header", True).csv(path)
    return rounded(health.read_hvi(spark, path).select("district", "dist_code", "elderly_pct"))


QUERIES["hvi_file"] = (
    hvi_file,
    "SELECT c_name AS district, lpad((c_custkey % 100)::VARCHAR, 3, '0') AS dist_code, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal, 4) + 0.0e0 END AS elderly_pct FROM customer WHERE c_custkey % 4 IN (0, 1)",
)


def enriched_csv(spark, sf):
    """Daily table with indices written as CSV in a fixed column order."""
    from heatgrid.operators.daily import legacy_daily
    from heatgrid.plans.weather import _master

    path = scratch_path(spark, "enriched")
    cols = ["district", "date", "month", "T2M_MAX", "T2M_MEAN", "WBGT", "AT_C", "WBGT_Risk"]
    weather.write_csv(legacy_daily(_master(spark, sf)), path, cols)
    back = spark.read.option("header", True).schema("district int, date date, month int, T2M_MAX double, T2M_MEAN double, WBGT double, AT_C double, WBGT_Risk string").csv(path)
    return rounded(back.groupBy("district", "WBGT_Risk").agg(F.count("*").alias("n"), F.avg("WBGT").alias("wbgt"), F.max("date").alias("last_date")))


def _master_sql():
    from heatgrid.plans.weather import MASTER_SQL

    return MASTER_SQL


QUERIES["enriched_csv"] = (
    enriched_csv,
    with_ctes(
        """SELECT district, CASE WHEN wbgt >= 35.0e0 THEN 'Red (Severe/Extreme)' WHEN wbgt >= 32.0e0 THEN 'Orange (High)' WHEN wbgt >= 27.0e0 THEN 'Yellow (Moderate)' ELSE 'Green (Low)' END AS "WBGT_Risk",
count(*) AS n, round(avg(wbgt), 4) + 0.0e0 AS wbgt, max(date) AS last_date FROM legacy GROUP BY 1, 2""",
        _master_sql(),
    ),
)


def delivery_log(spark, sf):
    """Log appended in two writes, read newest first."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("status"))
    path = scratch_path(spark, "log")
    documents.append_log(e.where("id % 2 = 0"), path)
    documents.append_log(e.where("id % 2 = 1"), path)
    return documents.read_log(spark, path, 500).select("id", "status")


QUERIES["delivery_log"] = (delivery_log, "SELECT event_id AS id, event_type AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")


def district_documents(spark, sf):
    """Nested district documents from the full people chain."""
    d = places.district_table(spark)
    level = mortality.district_level(fx.deaths(spark, sf), d)
    k = F.col("ahs_code")
    facts = d.select("ahs_code", *[(k * F.lit(w)).alias(c) for w, c in enumerate(("elderly_pct", "children_pct", "electricity_pct", "clean_fuel_pct", "health_insurance_pct", "women_literate_pct", "women_high_bp_pct", "men_high_bp_pct", "women_anaemic_pct", "healthcare_travel_min"), start=1)])
    scores = d.select("ahs_code", (k / F.lit(30.0)).alias("vuln_score"), k.alias("vuln_rank"), F.lit("Low").alias("vuln_tier"), (k / F.lit(7.0)).alias("vuln_mult"), *[(k / F.lit(n)).alias(f"pillar_{p}") for n, p in ((11.0, "exposure"), (13.0, "sensitivity"), (17.0, "adaptive"))])
    star = places.district_star(d, scores, level.drop("district", "pop_2011"), facts)
    return documents.district_documents(star).select("id", "name", "population", F.to_json("vulnerability").alias("vulnerability"), F.to_json("mortality").alias("mortality"))


QUERIES["district_documents"] = (
    district_documents,
    with_ctes(
        """, r AS (SELECT *, round(ahs_code / 30.0e0, 3) AS s, round(ahs_code / 7.0e0, 3) AS m, round(ahs_code / 11.0e0, 3) AS e, round(ahs_code / 13.0e0, 3) AS n, round(ahs_code / 17.0e0, 3) AS ad FROM level)
SELECT ahs_code AS id, upper(left(district, 1)) || lower(substr(district, 2)) AS name, pop_now AS population,
'{"score":' || s || ',"rank":' || ahs_code || ',"tier":"Low","multiplier":' || m || ',"exposure":' || e || ',"sensitivity":' || n || ',"adaptive":' || ad || '}' AS vulnerability,
'{"cdrNow":' || round(cdr_now, 2) || ',"relRate":' || round(rel_rate, 3) || ',"deathsShare65plus":' || round(s65, 3) || '}' AS mortality FROM r""",
        fx.DEATHS, fx.districts_sql(), LEVEL_SQL,
    ),
)


def ward_features(spark, sf):
    """Ward rows as GeoJSON features, read back through the feature schema."""
    w = fx.wards(spark, sf).withColumns({"ulb_name": F.lit("x"), "ndvi": F.lit(0.25), "area_km2": F.col("population") / 997.0})
    from heatgrid.functions.geo import square_ring

    f = w.withColumn("ring", square_ring("lat", "lon", 0.02)).select("ward_id", geojson.ward_feature().alias("json"))
    doc = F.from_json("json", "struct<type: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: struct<id: bigint, population: bigint, builtUp: double, areaKm2: double>>")
    return rounded(f.select("ward_id", doc.alias("d")).select("ward_id", "d.type", "d.properties.population", "d.properties.builtUp", "d.properties.areaKm2", F.size(F.col("d.geometry.coordinates")[0]).alias("points")))


QUERIES["ward_features"] = (
    ward_features,
    with_ctes("SELECT ward_id, 'Feature' AS type, population::BIGINT AS population, round(built_up_frac, 3) + 0.0e0 AS \"builtUp\", round(population / 997.0e0, 2) + 0.0e0 AS \"areaKm2\", 5 AS points FROM wards", fx.WARDS),
)


def payload_export(spark, sf):
    """As-of documents written per issue date and unfolded again."""
    d = fx.place_days(spark, sf).select("as_of", "scope", "place_id", "lead", "band", "htsi")
    path = scratch_path(spark, "payload")
    documents.write_payloads(d, path)
    back = spark.read.schema("scope string, place_id string, days array<struct<lead: int, band: string, htsi: double>>, as_of date").json(path)
    rows = back.select("as_of", "scope", "place_id", F.inline("days"))
    return rounded(rows.groupBy("as_of", "scope", "band").agg(F.count("*").alias("n"), F.avg("htsi").alias("htsi")))


QUERIES["payload_export"] = (
    payload_export,
    with_ctes("SELECT as_of, scope, band, count(*) AS n, round(avg(htsi), 4) + 0.0e0 AS htsi FROM place_days GROUP BY 1, 2, 3", fx.PANEL, fx.PLACE_DAYS),
)

# --- reshaping and small operators ------------------------------------------------------


def seasonal_pivot(spark, sf):
    """Monthly means spread over twelve columns, then back to long form."""
    p = fx.panel(spark, sf).groupBy("cell_id", F.month("date").alias("month")).agg(F.avg("wbgt_max").alias("w"))
    wide = reshape.pivot_long(p, "cell_id", "month", range(1, 13), "w")
    return rounded(reshape.unpivot_wide(wide, "cell_id", [str(m) for m in range(1, 13)], "month", "wbgt"))


QUERIES["seasonal_pivot"] = (
    seasonal_pivot,
    with_ctes("SELECT cell_id, month(date)::VARCHAR AS month, round(avg(wbgt_max), 4) + 0.0e0 AS wbgt FROM panel GROUP BY 1, 2", fx.PANEL),
)


def unioned_years(spark, sf):
    """Frames per year united by name; a column only one of them has is NULL elsewhere."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    years = sorted(r.year for r in o.select("year").distinct().collect())
    parts = [o.where(F.col("year") == y) for y in years]
    parts[0] = parts[0].withColumn("flag", F.lit("first"))
    return rounded(reshape.union_all(*parts).groupBy("year", "flag").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")))


QUERIES["unioned_years"] = (
    unioned_years,
    "SELECT year(o_orderdate)::INTEGER AS year, CASE WHEN year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders) THEN 'first' END AS flag, count(*) AS n, round(max(o_totalprice), 4) + 0.0e0 AS top FROM orders GROUP BY 1, 2",
)


def scaled_thresholds(spark, sf):
    """Thresholds doubled and capped, quantiles put in order."""
    e = table(spark, sf, "events").select("event_id", (F.col("value") % 1.0).alias("warning"), (F.col("value") % 0.7).alias("watch"), "value")
    doubled = alerts.scale_thresholds(e, 2.0)
    q10, q50, q90 = scaling.ordered_quantiles(F.col("value") - F.lit(3.3), (F.col("event_id") % 130).cast("double"), F.col("value") + F.lit(9.1))
    return rounded(doubled.select("event_id", "warning", "watch", q10.alias("q10"), q50.alias("q50"), q90.alias("q90")))


QUERIES["scaled_thresholds"] = (
    scaled_thresholds,
    with_ctes(
        pick(["event_id"], ["least(0.95e0, (value % 1.0e0) * 2) AS warning", "least(0.95e0, (value % 0.7e0) * 2) AS watch", "least(greatest(least(value - 3.3e0, m), 0.0e0), 100.0e0) AS q10", "m AS q50", "least(greatest(greatest(value + 9.1e0, m), 0.0e0), 100.0e0) AS q90"],
             "(SELECT *, least(greatest((event_id % 130)::DOUBLE, 0.0e0), 100.0e0) AS m FROM e)"),
        "e AS (SELECT * FROM events)",
    ),
)


def interpolated_risk(spark, sf):
    """Relative risk, index and deaths straight from four lags of event values."""
    from heatgrid.params import ExposureResponse

    e = table(spark, sf, "events").select("event_id", (F.col("value") % 75.0).alias("a"), (F.col("event_id") % 70).cast("double").alias("b"), F.when(F.col("event_id") % 3 != 0, F.col("value") % 66.0).alias("c"))
    curve = ExposureResponse()
    rr = scaling.relative_risk(scaling.lagged_log_risk(["a", "b", "c", F.lit(60.0)], curve), F.lit(1.1))
    out = e.withColumn("rr", rr)
    return rounded(out.select("event_id", "rr", scaling.mortality_risk_index("rr", curve).alias("mri"), scaling.per_100k("rr", F.lit(5000.0)).alias("rate")))


def _risk_sql() -> str:
    import math

    from heatgrid.params import ExposureResponse

    c = ExposureResponse()
    x = "0.5e0 * greatest(value % 75.0e0 - 48.5e0, 0) + 0.25e0 * greatest(event_id % 70 - 48.5e0, 0) + 0.15e0 * greatest(CASE WHEN event_id % 3 <> 0 THEN value % 66.0e0 ELSE 0 END - 48.5e0, 0) + 0.1e0 * 11.5e0"
    return f"r AS (SELECT event_id, exp(1.1e0 * least({c.slope()!r}::DOUBLE * ({x}), {math.log(c.max_rr)!r}::DOUBLE)) AS rr FROM events)"


QUERIES["risk_curve"] = (
    interpolated_risk,
    with_ctes(pick(["event_id"], ["rr", "least(greatest(100.0e0 * (rr - 1) / 0.5e0, 0.0e0), 100.0e0) AS mri", "100000.0e0 * rr / 5000.0e0 AS rate"], "r"), _risk_sql()),
)
