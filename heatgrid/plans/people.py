"""Places, people, vulnerability and mortality."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import geo, scaling, text
from heatgrid.operators import mortality, nearest, places, ranking, risk, vulnerability
from heatgrid.plans import fixtures as fx
from heatgrid.plans.common import Query, pick, rounded, table, with_ctes
from heatgrid.sources import geojson, health

QUERIES: dict[str, Query] = {}
KX = "cos(radians(20.5e0))"

# --- keys ----------------------------------------------------------------------


def _spelled(spark, sf):
    """Customers that name a district in one of five ways."""
    d = places.district_table(spark)
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 30 + 1).cast("int").alias("ahs_code"))
    way = F.col("c_custkey") % 5
    spelled = (
        F.when(way == 0, F.lower("district"))
        .when(way == 1, F.col("hvi_name"))
        .when(way == 2, F.concat(F.lit("  "), F.replace(F.col("nfhs_name"), F.lit(" "), F.lit("-")), F.lit(" ")))
        .when(way == 3, F.col("census_2011_code").cast("string"))
        .otherwise(F.concat(F.col("hq"), F.lit("_Station")))
    )
    return c.join(d, "ahs_code").select("c_custkey", spelled.alias("key")), d


def resolved_keys(spark, sf):
    df, d = _spelled(spark, sf)
    return places.resolve_keys(df, "key", places.crosswalk(d)).select("c_custkey", "ahs_code")


QUERIES["resolved_keys"] = (resolved_keys, "SELECT c_custkey, (c_custkey % 30 + 1)::INTEGER AS ahs_code FROM customer")


def unknown_keys(spark, sf):
    """Spellings of nations that no district goes by."""
    df, d = _spelled(spark, sf)
    odd = df.withColumn("key", F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("NOWHERE "), F.col("key"))).when(F.col("c_custkey") % 7 == 1, F.lit("999")).otherwise(F.col("key")))
    found = places.resolve_keys(odd, "key", places.crosswalk(d), on_unknown="null")
    return found.where("ahs_code IS NULL").select("c_custkey")


QUERIES["unknown_keys"] = (unknown_keys, "SELECT c_custkey FROM customer WHERE c_custkey % 7 IN (0, 1)")


def name_keys(spark, sf):
    s = table(spark, sf, "supplier").withColumn("n", F.concat(F.lit(" st. "), F.lower("s_name"), F.lit("-ward (alt name)")))
    return s.select("s_suppkey", text.normalise_name("n").alias("key"), text.first_token(F.concat("s_name", F.lit("_x/y"))).alias("head"), text.name_aliases("n")[1].alias("inner"))


QUERIES["name_keys"] = (
    name_keys,
    "SELECT s_suppkey, regexp_replace(translate(upper(trim(' st. ' || lower(s_name) || '-ward (alt name)')), '-.', '  '), '\\s+', ' ', 'g') AS key, upper(s_name) AS head, 'ALT NAME' AS \"inner\" FROM supplier",
)


def star_join(spark, sf):
    """District facts with suppliers' totals in place of survey tables."""
    d = places.district_table(spark).select("ahs_code", "district", "hq", "pop_2011")
    s = table(spark, sf, "supplier")
    vuln = s.groupBy((F.col("s_suppkey") % 25 + 1).cast("int").alias("ahs_code")).agg(F.avg("s_acctbal").alias("vuln_mult"))
    summary = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 28 + 1).cast("int").alias("ahs_code")).agg(F.count("*").alias("records"))
    nfhs = s.where("s_suppkey % 30 < 20").groupBy((F.col("s_suppkey") % 30 + 1).cast("int").alias("ahs_code")).agg(F.max("s_acctbal").alias("electricity_pct"))
    return rounded(places.district_star(d, vuln, summary, nfhs))


QUERIES["star_join"] = (
    star_join,
    with_ctes(
        """, v AS (SELECT (s_suppkey % 25 + 1)::INTEGER AS ahs_code, avg(s_acctbal) AS vuln_mult FROM supplier GROUP BY 1),
s AS (SELECT (o_custkey % 28 + 1)::INTEGER AS ahs_code, count(*) AS records FROM orders GROUP BY 1),
n AS (SELECT (s_suppkey % 30 + 1)::INTEGER AS ahs_code, max(s_acctbal) AS e FROM supplier WHERE s_suppkey % 30 < 20 GROUP BY 1)
SELECT ahs_code, district, hq, pop_2011::BIGINT AS pop_2011, round(vuln_mult, 4) + 0.0e0 AS vuln_mult, records, round(e, 4) + 0.0e0 AS electricity_pct FROM dd JOIN v USING (ahs_code) JOIN s USING (ahs_code) LEFT JOIN n USING (ahs_code)""",
        "dd(ahs_code, district, hq, pop_2011) AS (VALUES " + ", ".join(f"({d[0]}, '{d[1]}', '{d[4]}', {d[7]})" for d in places.DISTRICTS) + ")",
    ),
)

# --- geography -------------------------------------------------------------------


def distances(spark, sf):
    w = fx.wards(spark, sf)
    a = w.select(
        "ward_id",
        geo.haversine_km("lat", "lon", F.lit(20.3), F.lit(85.8)).alias("km"),
        geo.planar_degrees("lat", "lon", F.lit(20.3), F.lit(85.8)).alias("planar"),
        geo.coast_latitude(F.col("lon") + 3.5).alias("coast"),
        geo.is_sea("lat", F.col("lon") + 3.5).alias("sea"),
    )
    return rounded(a)


QUERIES["distances"] = (
    distances,
    with_ctes(
        pick(
            ["ward_id", f"lat < (CASE WHEN lon + 3.5e0 < 84.4e0 THEN -90.0e0 ELSE {fx.interp_sql('(lon + 3.5e0)', geo.COASTLINE)} END) - 0.02e0 AS sea"],
            [
                "2 * 6371.0e0 * asin(sqrt(sin(radians(20.3e0 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(20.3e0)) * sin(radians(85.8e0 - lon) / 2) ** 2)) AS km",
                f"sqrt(((85.8e0 - lon) * {KX}) ** 2 + (20.3e0 - lat) ** 2) AS planar",
                f"CASE WHEN lon + 3.5e0 < 84.4e0 THEN -90.0e0 ELSE {fx.interp_sql('(lon + 3.5e0)', geo.COASTLINE)} END AS coast",
            ],
            "wards",
        ),
        fx.WARDS,
    ),
)

NEAR_SQL = f"""near AS (SELECT ward_id, c.cell_id, sqrt(((c.lon - w.lon) * {KX}) ** 2 + (c.lat - w.lat) ** 2) AS d,
  row_number() OVER (PARTITION BY ward_id ORDER BY sqrt(((c.lon - w.lon) * {KX}) ** 2 + (c.lat - w.lat) ** 2), c.cell_id) AS rk FROM wards w, event_cells c),
weights AS (SELECT ward_id, cell_id, d AS distance, (1.0e0 / greatest(d, 1e-4) ** 2) / sum(1.0e0 / greatest(d, 1e-4) ** 2) OVER (PARTITION BY ward_id) AS weight FROM near WHERE rk <= 4)"""


def idw_weights(spark, sf):
    return rounded(nearest.inverse_distance_weights(fx.wards(spark, sf), fx.event_cells(spark, sf)))


QUERIES["idw_weights"] = (idw_weights, with_ctes(pick(["ward_id", "cell_id"], ["distance", "weight"], "weights"), fx.HOURLY, fx.EVENT_CELLS, fx.WARDS, NEAR_SQL))


def dominant_cells(spark, sf):
    w = nearest.inverse_distance_weights(fx.wards(spark, sf), fx.event_cells(spark, sf))
    return nearest.dominant_cell(w)


QUERIES["dominant_cells"] = (
    dominant_cells,
    with_ctes("SELECT ward_id, cell_id FROM near WHERE rk = 1", fx.HOURLY, fx.EVENT_CELLS, fx.WARDS, NEAR_SQL),
)


def ward_values(spark, sf):
    """Daily cell maxima carried to the wards by their weights."""
    m = fx.moist(spark, sf).groupBy("cell_id", F.to_date("ts_ist").alias("date")).agg(F.max("t2m").alias("t2m"), F.max("wbgt").alias("wbgt"))
    w = nearest.inverse_distance_weights(fx.wards(spark, sf), fx.event_cells(spark, sf))
    return rounded(nearest.apply_weights(m, w, ["t2m", "wbgt"], ["date"]))


QUERIES["ward_values"] = (
    ward_values,
    with_ctes(
        """, m AS (SELECT cell_id, ts_ist::DATE AS date, max(t2m) AS t2m, max(wbgt) AS wbgt FROM moist GROUP BY 1, 2)
SELECT ward_id, date, CASE WHEN count(*) = 4 THEN round(sum(weight * t2m), 4) + 0.0e0 END AS t2m, CASE WHEN count(*) = 4 THEN round(sum(weight * wbgt), 4) + 0.0e0 END AS wbgt FROM m JOIN weights USING (cell_id) GROUP BY 1, 2""",
        fx.HOURLY, fx.MOIST, fx.EVENT_CELLS, fx.WARDS, NEAR_SQL,
    ),
)

ASSIGN_SQL = f"""ratios AS (SELECT cell_id, lat, lon, d.ahs_code, sqrt(((c_lon - lon) * {KX}) ** 2 + (c_lat - lat) ** 2) / (sqrt(area_km2 / pi()) / 111.0e0) AS ratio,
  row_number() OVER (PARTITION BY cell_id ORDER BY sqrt(((c_lon - lon) * {KX}) ** 2 + (c_lat - lat) ** 2) / (sqrt(area_km2 / pi()) / 111.0e0), d.ahs_code) AS rk FROM event_cells, districts d),
best AS (SELECT *, lat < (CASE WHEN lon < 84.4e0 THEN -90.0e0 ELSE {fx.interp_sql('lon', geo.COASTLINE)} END) - 0.02e0 AS is_sea FROM ratios WHERE rk = 1),
pass0 AS (SELECT *, round(lat / 0.25e0)::BIGINT AS y, round(lon / 0.25e0)::BIGINT AS x, NOT is_sea AND ratio <= 1.2e0 AS inside FROM best),
pass1 AS (SELECT a.* EXCLUDE (inside), a.inside OR (NOT a.is_sea AND (SELECT count(*) FROM pass0 b WHERE b.inside AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x)) >= 5) AS inside FROM pass0 a),
pass2 AS (SELECT a.* EXCLUDE (inside), a.inside OR (NOT a.is_sea AND (SELECT count(*) FROM pass1 b WHERE b.inside AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x)) >= 5) AS inside FROM pass1 a)"""


def cell_districts(spark, sf):
    out = places.cell_districts(fx.event_cells(spark, sf), places.district_table(spark))
    return rounded(out.drop("district"))


QUERIES["cell_districts"] = (
    cell_districts,
    with_ctes(
        "SELECT cell_id, lat, lon, CASE WHEN inside THEN ahs_code END AS ahs_code, round(ratio, 3) + 0.0e0 AS reach_ratio, is_sea, inside AS in_state FROM pass2",
        fx.HOURLY, fx.EVENT_CELLS, fx.districts_sql(), ASSIGN_SQL,
    ),
)


def in_state_days(spark, sf):
    """Semi join of the daily records with the cells inside the state, then the district."""
    m = fx.moist(spark, sf)
    cd = places.cell_districts(fx.event_cells(spark, sf), places.district_table(spark))
    kept = places.keep_in_state(m, cd)
    return rounded(places.attach_district(kept, cd).groupBy("ahs_code").agg(F.count("*").alias("n"), F.avg("wbgt").alias("wbgt")))


QUERIES["in_state_days"] = (
    in_state_days,
    with_ctes(
        "SELECT p.ahs_code, count(*) AS n, round(avg(wbgt), 4) + 0.0e0 AS wbgt FROM moist JOIN pass2 p USING (cell_id) WHERE inside GROUP BY 1",
        fx.HOURLY, fx.MOIST, fx.EVENT_CELLS, fx.districts_sql(), ASSIGN_SQL,
    ),
)


def cell_squares(spark, sf):
    c = fx.event_cells(spark, sf).withColumn("ring", geo.square_ring("lat", "lon"))
    centre = geo.ring_centroid("ring")
    return rounded(c.select("cell_id", F.to_json("ring").alias("ring_json"), geo.ring_area_km2("ring", "lat").alias("km2"), centre["lat"].alias("clat"), centre["lon"].alias("clon")))


QUERIES["cell_squares"] = (
    cell_squares,
    with_ctes(
        """SELECT cell_id, '[[' || (lon - 0.125e0) || ',' || (lat - 0.125e0) || '],[' || (lon + 0.125e0) || ',' || (lat - 0.125e0) || '],[' || (lon + 0.125e0) || ',' || (lat + 0.125e0) || '],[' || (lon - 0.125e0) || ',' || (lat + 0.125e0) || '],[' || (lon - 0.125e0) || ',' || (lat - 0.125e0) || ']]' AS ring_json,
round(0.0625e0 * 111.0e0 * 111.0e0 * cos(radians(lat)), 4) + 0.0e0 AS km2, lat AS clat, lon AS clon FROM event_cells""",
        fx.HOURLY, fx.EVENT_CELLS,
    ),
)

# --- ward contract -----------------------------------------------------------------


def _features(spark, sf):
    """Features as JSON text from ``customer``, some of them broken."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    y, x = F.lit(20.0) + (k % 40) * F.lit(0.01), F.lit(85.0) + F.floor(k / 40) * F.lit(0.01)
    ring = geo.square_ring(y, x, 0.01)
    props = F.struct(
        F.when(k % 50 == 7, (k - 1).cast("string")).otherwise(k.cast("string")).alias("ward_id"),
        F.when(k % 60 != 11, F.col("c_name")).alias("ward_name"),
        F.lit("City").alias("ulb_name"),
        F.when(k % 45 == 13, F.lit("Atlantis")).otherwise(F.element_at(F.array(F.lit("Khordha"), F.lit("CUTTACK"), F.lit("Angul")), (k % 3 + 1).cast("int"))).alias("district"),
        F.when(k % 4 != 0, k * F.lit(10.0)).alias("population"),
        F.when(k % 6 != 0, (k % 17) * F.lit(1.0)).alias("elderly_pct"),
        F.when(k % 5 != 0, (k % 20) * F.lit(1.0)).alias("slum_pop_pct"),
        F.when(k % 3 != 0, (k % 10) / F.lit(10.0)).alias("built_up_frac"),
    )
    geometry = F.struct(
        F.when(k % 70 == 17, "Point").otherwise("Polygon").alias("type"),
        F.when(k % 70 != 17, F.array(ring)).alias("coordinates"),
    )
    doc = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")))
    return geojson.parse_features(c.select("c_custkey", doc.alias("json")), "c_custkey", "json")


def ward_contract(spark, sf):
    checked = geojson.check_features(_features(spark, sf), places.crosswalk(places.district_table(spark)))
    return checked.where(F.size("problems") > 0).select("feature_no", F.array_join("problems", "; ").alias("problems"))


QUERIES["ward_contract"] = (
    ward_contract,
    """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 7 THEN c_custkey - 1 ELSE c_custkey END AS wid FROM customer),
g AS (SELECT k, wid, min(k) OVER (PARTITION BY wid) AS first FROM f),
p AS (SELECT k, concat_ws('; ', CASE WHEN k % 60 = 11 THEN 'missing required ward_name' END, CASE WHEN first < k THEN 'duplicate ward_id ' || wid END,
  CASE WHEN k % 45 = 13 THEN 'unresolvable district Atlantis' END, CASE WHEN k % 70 = 17 THEN 'geometry must be Polygon or MultiPolygon' END) AS problems FROM g)
SELECT k AS feature_no, problems FROM p WHERE problems <> ''""",
)


def ward_registry(spark, sf):
    """Clean features to ward rows with filled gaps named."""
    f = _features(spark, sf)
    d = places.district_table(spark)
    checked = geojson.check_features(f, places.crosswalk(d)).where(F.size("problems") == 0)
    elderly = d.select("ahs_code", (F.col("ahs_code") * F.lit(0.5)).alias("elderly_pct"))
    rows = geojson.ward_rows(checked, elderly)
    return rounded(rows.select("ward_id", "ahs_code", "lat", "lon", "area_km2", *geojson.OPTIONAL, "filled_fields"))


QUERIES["ward_registry"] = (
    ward_registry,
    """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 7 THEN c_custkey - 1 ELSE c_custkey END AS wid,
  20.0e0 + (c_custkey % 40) * 0.01e0 AS lat, 85.0e0 + (c_custkey // 40) * 0.01e0 AS lon FROM customer),
g AS (SELECT *, min(k) OVER (PARTITION BY wid) AS first, [17, 12, 15][k % 3 + 1] AS code FROM f)
SELECT k::VARCHAR AS ward_id, code AS ahs_code, round(lat, 4) + 0.0e0 AS lat, round(lon, 4) + 0.0e0 AS lon, round(0.0001e0 * 12321.0e0 * cos(radians(lat)), 4) + 0.0e0 AS area_km2,
CASE WHEN k % 4 <> 0 THEN k * 10.0e0 END AS population, CASE WHEN k % 6 <> 0 THEN (k % 17) * 1.0e0 ELSE code * 0.5e0 END AS elderly_pct,
CASE WHEN k % 5 <> 0 THEN (k % 20) * 1.0e0 ELSE 15.0e0 END AS slum_pop_pct, CASE WHEN k % 3 <> 0 THEN (k % 10) / 10.0e0 ELSE 0.5e0 END AS built_up_frac, 0.3e0 AS ndvi,
concat_ws(',', CASE WHEN k % 4 = 0 THEN 'population' END, CASE WHEN k % 6 = 0 THEN 'elderly_pct' END, CASE WHEN k % 5 = 0 THEN 'slum_pop_pct' END, CASE WHEN k % 3 = 0 THEN 'built_up_frac' END, 'ndvi') AS filled_fields
FROM g WHERE NOT (k % 60 = 11 OR first < k OR k % 45 = 13 OR k % 70 = 17)""",
)


def ward_scores(spark, sf):
    w = fx.wards(spark, sf).drop("vuln_mult")
    base = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("ahs_code"), (F.col("n_nationkey") / F.lit(24.0)).alias("vuln_score"))
    out = places.ward_vulnerability(w, base)
    return rounded(out.select("ward_id", "vuln_score", "vuln_mult"))


_Z = "coalesce(({c} - avg({c}) OVER (PARTITION BY city)) / CASE WHEN stddev_samp({c}) OVER (PARTITION BY city) = 0 THEN 1.0e0 ELSE stddev_samp({c}) OVER (PARTITION BY city) END, 0.0e0)"
QUERIES["ward_scores"] = (
    ward_scores,
    with_ctes(
        f""", z AS (SELECT ward_id, least(greatest((ahs_code - 1) / 24.0e0 + 0.06e0 * {_Z.format(c='elderly_pct')} + 0.08e0 * {_Z.format(c='slum_pop_pct')} + 0.05e0 * {_Z.format(c='built_up_frac')}, 0.0e0), 1.0e0) AS s FROM wards)
SELECT ward_id, round(s, 4) + 0.0e0 AS vuln_score, round(0.75e0 + 0.6e0 * s, 4) + 0.0e0 AS vuln_mult FROM z""",
        fx.WARDS,
    ),
)


def place_list(spark, sf):
    return places.places(fx.wards(spark, sf), places.district_table(spark))


QUERIES["place_list"] = (
    place_list,
    with_ctes(
        "SELECT 'ward' AS scope, ward_id::VARCHAR AS id, ward_name AS name, city::VARCHAR AS city, ahs_code::VARCHAR AS district FROM wards UNION ALL SELECT 'district', ahs_code::VARCHAR, district, NULL, ahs_code::VARCHAR FROM districts",
        fx.WARDS, fx.districts_sql(),
    ),
)

# --- survey text -----------------------------------------------------------------


def fact_sheet_values(spark, sf):
    """Indicator lines planted among the lines of whole documents."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id").cast("string")
    planted = F.concat(
        F.lit("District "), F.translate(k, "0123456789", "abcdefghij"), F.lit(", Odisha - Key Indicators\n"),
        F.translate("text", "%", " "),
        F.lit("\n12. Population living in households with electricity (%) "), F.when(F.col("doc_id") % 7 == 0, F.lit("*")).otherwise(F.concat(F.lit("("), (F.col("doc_id") % 100).cast("string"), F.lit(".5)"))), F.lit(" 80.1"),
        F.lit("\n13. Women who are\n14. Women who are literate, all ages and\nplaces (%) 1,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(".2 50"),
        F.lit("\n20. Elevated blood pressure (%) 21.0\n21. Elevated blood pressure (%) 3"), (F.col("doc_id") % 10).cast("string"), F.lit(".0"),
        F.lit("\n30. Households using clean fuel for cooking\n"), (F.col("doc_id") % 90).cast("string"), F.lit(" 70"),
    )
    lines = health.text_lines(d.select(F.col("doc_id").alias("page"), planted.alias("text")), "page", "text")
    t = health.indicator_table(health.indicator_values(lines))
    return rounded(t.select("name", "electricity_pct", "women_literate_pct", "women_high_bp_pct", "men_high_bp_pct", "clean_fuel_pct", "health_insurance_pct"))


QUERIES["fact_sheet_values"] = (
    fact_sheet_values,
    """SELECT 'District ' || translate(doc_id::VARCHAR, '0123456789', 'abcdefghij') AS name, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 100) + 0.5e0 END AS electricity_pct,
1000.0e0 + doc_id % 1000 + 0.2e0 AS women_literate_pct, 21.0e0 AS women_high_bp_pct, 30.0e0 + doc_id % 10 AS men_high_bp_pct, (doc_id % 90)::DOUBLE AS clean_fuel_pct, NULL::DOUBLE AS health_insurance_pct FROM documents""",
)


def document_lines(spark, sf):
    d = table(spark, sf, "documents")
    lines = health.text_lines(d, "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


QUERIES["document_lines"] = (
    document_lines,
    "SELECT doc_id, len(string_split(text, chr(10))) AS lines, length(text) - len(string_split(text, chr(10))) + 1 AS chars FROM documents",
)

# --- deaths ------------------------------------------------------------------------

QUERIES["deduped_deaths"] = (
    lambda spark, sf: rounded(fx.deaths(spark, sf).select("ahs_code", "hl_id", "house_no", "deceased_sex", "year", "month", "age_years", "age_band", "date", "wt")),
    with_ctes(
        """SELECT ahs_code, l_orderkey::VARCHAR AS hl_id, l_linenumber::VARCHAR AS house_no, l_returnflag AS deceased_sex, year, month::INTEGER AS month, round(age_years, 4) + 0.0e0 AS age_years,
CASE WHEN age_years < 5 THEN '0-4' WHEN age_years < 15 THEN '5-14' WHEN age_years < 45 THEN '15-44' WHEN age_years < 65 THEN '45-64' WHEN age_years < 200 THEN '65+' END AS age_band, date, wt::DOUBLE AS wt FROM deaths""",
        fx.DEATHS,
    ),
)

QUERIES["monthly_district_deaths"] = (
    lambda spark, sf: rounded(mortality.monthly_district_deaths(fx.deaths(spark, sf))),
    with_ctes("SELECT ahs_code, year, month::INTEGER AS month, sum(wt)::DOUBLE AS deaths_weighted, count(*) AS records FROM deaths WHERE month IS NOT NULL AND year BETWEEN 2007 AND 2011 GROUP BY 1, 2, 3", fx.DEATHS),
)


def _profile_sql() -> str:
    days = mortality.DAYS_IN_MONTH
    w = mortality.seasonal_weights()
    months = ", ".join(f"coalesce(sum(wt) FILTER (WHERE month = {m}), 0)::DOUBLE / {float(days[m - 1])!r}e0 AS m{m}" for m in range(1, 13))
    mean = "(" + " + ".join(f"m{m}" for m in range(1, 13)) + ") / 12.0e0"
    coef = ", ".join("(" + " + ".join(f"({float(x)!r})::DOUBLE * m{m}" for m, x in enumerate(row, start=1)) + f") / ({mean}) AS c{i}" for i, row in enumerate(w))
    th = "2.0e0 * pi() * (d - 0.5e0) / 365.25e0"
    return f"""pm AS (SELECT {months} FROM deaths WHERE month IS NOT NULL AND year IN (2007, 2008, 2009)),
pc AS (SELECT {coef} FROM pm),
pf AS (SELECT d, c0 + c1 * cos({th}) + c2 * sin({th}) + c3 * cos(2 * ({th})) + c4 * sin(2 * ({th})) AS f FROM pc, (SELECT unnest(range(1, 366)) AS d)),
profile AS (SELECT d::INTEGER AS doy, f / avg(f) OVER () AS seasonal_factor FROM pf)"""


QUERIES["seasonal_profile"] = (
    lambda spark, sf: rounded(mortality.seasonal_profile(fx.deaths(spark, sf))),
    with_ctes(pick(["doy"], ["seasonal_factor"], "profile"), fx.DEATHS, _profile_sql()),
)

LEVEL_SQL = """yearly AS (SELECT ahs_code, year, sum(wt)::DOUBLE AS wt FROM deaths WHERE year BETWEEN 2007 AND 2011 GROUP BY 1, 2),
annual AS (SELECT ahs_code, median(wt) AS a FROM yearly WHERE wt > 0 GROUP BY 1),
share AS (SELECT ahs_code, coalesce(sum(wt) FILTER (WHERE age_years >= 65), 0)::DOUBLE / greatest(sum(wt)::DOUBLE, 1e-9) AS s65 FROM deaths WHERE year BETWEEN 2007 AND 2011 GROUP BY 1),
lvl0 AS (SELECT d.ahs_code, d.district, pop_2011, a, 1000.0e0 * a / pop_2011 AS cdr, (SELECT 1000.0e0 * sum(a2.a) / sum(d2.pop_2011) FROM districts d2 LEFT JOIN annual a2 USING (ahs_code)) AS st, s65
  FROM districts d LEFT JOIN annual USING (ahs_code) LEFT JOIN share USING (ahs_code)),
lvl AS (SELECT *, CASE WHEN cdr / st IS NOT NULL THEN least(greatest(cdr / st, 0.7e0), 1.4e0) END AS rel_rate, round_even(pop_2011 * 1.12e0, 0)::BIGINT AS pop_now FROM lvl0),
level AS (SELECT *, 7.3e0 * rel_rate AS cdr_now, 7.3e0 * rel_rate / 1000.0e0 * pop_now / 365.0e0 AS daily_deaths_mean FROM lvl)"""


def _districts(spark):
    return places.district_table(spark)


QUERIES["district_level"] = (
    lambda spark, sf: rounded(mortality.district_level(fx.deaths(spark, sf), _districts(spark)).drop("pop_2011")),
    with_ctes(
        pick(["ahs_code", "district", "pop_now"], ["a AS ahs_annual_deaths", "cdr AS ahs_cdr", "cdr / st AS rel_rate_raw", "rel_rate", "cdr_now", "daily_deaths_mean", "s65 AS deaths_share_65plus"], "level"),
        fx.DEATHS, fx.districts_sql(), LEVEL_SQL,
    ),
)

QUERIES["baseline"] = (
    lambda spark, sf: rounded(mortality.build_baseline(fx.deaths(spark, sf), _districts(spark)).select("ahs_code", "doy", "seasonal_factor", "expected_deaths", "rate_per_100k_day")),
    with_ctes(
        pick(["ahs_code", "doy"], ["seasonal_factor", "daily_deaths_mean * seasonal_factor AS expected_deaths", "100000.0e0 * (daily_deaths_mean * seasonal_factor) / pop_now AS rate_per_100k_day"], "level, profile"),
        fx.DEATHS, fx.districts_sql(), LEVEL_SQL, _profile_sql(),
    ),
)

QUERIES["weighted_share"] = (
    lambda spark, sf: rounded(mortality.weighted_share(table(spark, sf, "lineitem"), F.col("l_quantity") >= 30, "l_extendedprice", "l_returnflag", "share")),
    "SELECT l_returnflag, round(sum(l_extendedprice) FILTER (WHERE l_quantity >= 30) / sum(l_extendedprice), 4) + 0.0e0 AS share FROM lineitem GROUP BY 1",
)

# --- vulnerability ------------------------------------------------------------------

TEST_PILLARS = {"exposure": {"a": 1, "b": 1}, "sensitivity": {"c": 1, "d": -1}, "adaptive": {"e": -1, "flat": 1}}


def _indicators(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.col("c_acctbal").alias("a"),
        (k % 101).cast("double").alias("b"),
        F.when(k % 13 != 0, (k * 7 % 97) * F.lit(1.3)).alias("c"),
        (k % 29).cast("double").alias("d"),
        (F.col("c_acctbal") * F.lit(0.5) + k % 53).alias("e"),
        F.lit(2.0).alias("flat"),
    )


INDICATORS_SQL = """ind AS (SELECT c_custkey, c_acctbal AS a, (c_custkey % 101)::DOUBLE AS b, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey * 7 % 97) * 1.3e0 END AS c,
  (c_custkey % 29)::DOUBLE AS d, c_acctbal * 0.5e0 + c_custkey % 53 AS e, 2.0e0 AS flat FROM customer),
scaled AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS n_a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS n_b,
  (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS n_c, 1.0e0 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS n_d,
  1.0e0 - (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ()) AS n_e, 0.5e0 AS n_flat FROM ind),
pillars AS (SELECT *, (n_a + n_b) / 2 AS px, CASE WHEN n_c IS NULL THEN n_d ELSE (n_c + n_d) / 2 END AS ps, (n_e + n_flat) / 2 AS pa FROM scaled),
comp AS (SELECT *, (px + ps + pa) / 3 AS vuln_equal, 0.3e0 * px + 0.4e0 * ps + 0.3e0 * pa AS vuln_expert FROM pillars),
scores AS (SELECT *, (vuln_equal - min(vuln_equal) OVER ()) / (max(vuln_equal) OVER () - min(vuln_equal) OVER ()) AS vuln_score FROM comp),
edges AS (SELECT quantile_cont(vuln_score, 0.2) AS e1, quantile_cont(vuln_score, 0.4) AS e2, quantile_cont(vuln_score, 0.6) AS e3, quantile_cont(vuln_score, 0.8) AS e4 FROM scores)"""


def vulnerability_scores(spark, sf):
    out = vulnerability.vulnerability(_indicators(spark, sf), TEST_PILLARS, pca=False)
    return rounded(out.select("c_custkey", "n_c", "n_d", "pillar_exposure", "pillar_sensitivity", "pillar_adaptive", "vuln_equal", "vuln_expert", "vuln_score", "vuln_rank", "vuln_tier", "vuln_mult"))


QUERIES["vulnerability_scores"] = (
    vulnerability_scores,
    with_ctes(
        pick(
            ["c_custkey", "rank() OVER (ORDER BY vuln_score DESC) AS vuln_rank", "CASE WHEN vuln_score <= e1 THEN 'Very Low' WHEN vuln_score <= e2 THEN 'Low' WHEN vuln_score <= e3 THEN 'Moderate' WHEN vuln_score <= e4 THEN 'High' ELSE 'Very High' END AS vuln_tier"],
            ["n_c", "n_d", "px AS pillar_exposure", "ps AS pillar_sensitivity", "pa AS pillar_adaptive", "vuln_equal", "vuln_expert", "vuln_score", "0.75e0 + 0.6e0 * vuln_score AS vuln_mult"],
            "scores, edges",
        ),
        INDICATORS_SQL,
    ),
)


def principal_component(spark, sf):
    df = vulnerability.composite(_indicators(spark, sf), TEST_PILLARS)
    out, _ = vulnerability.first_component(df, ["n_a", "n_b", "n_c", "n_d", "n_e"], "vuln_equal")
    return rounded(out.select("c_custkey", "vuln_pca"))


def _component_sql() -> str:
    """Power iteration on the covariance matrix of the five indicators, one row for each step."""
    cols = "abcde"
    centred = ", ".join(f"coalesce(n_{c} - avg(n_{c}) OVER (), 0.0e0) AS x{c}" for c in cols)
    moments = ", ".join(f"sum(x{a} * x{b}) AS m{a}{b}" for a in cols for b in cols)
    step = lambda a: "(" + " + ".join(f"m{a}{b} * v{b}" for b in cols) + ")"
    norm = "sqrt(" + " + ".join(f"{step(a)} ** 2" for a in cols) + ")"
    moved = ", ".join(f"{step(a)} / {norm} AS v{a}" for a in cols)
    score = " + ".join(f"x{c} * v{c}" for c in cols)
    return f"""centred AS MATERIALIZED (SELECT c_custkey, vuln_equal, {centred} FROM comp),
moments AS MATERIALIZED (SELECT {moments} FROM centred),
power AS (SELECT 0 AS i, {", ".join(f"{1 + k / 10}e0 AS v{c}" for k, c in enumerate(cols))} UNION ALL SELECT i + 1, {moved} FROM power, moments WHERE i < 1000),
projected AS (SELECT c_custkey, vuln_equal, {score} AS s FROM centred, (SELECT * FROM power WHERE i = 1000))"""


QUERIES["principal_component"] = (
    principal_component,
    with_ctes(
        "SELECT c_custkey, round(s * CASE WHEN (SELECT corr(s, vuln_equal) FROM projected) < 0 THEN -1 ELSE 1 END, 4) + 0.0e0 AS vuln_pca FROM projected",
        INDICATORS_SQL, _component_sql(), recursive=True,
    ),
)

QUERIES["constant_columns"] = (
    lambda spark, sf: vulnerability.constant_columns(_indicators(spark, sf), ["a", "b", "flat"]),
    with_ctes("SELECT 'a' AS column_name, min(a) = max(a) AS is_constant FROM ind UNION ALL SELECT 'b', min(b) = max(b) FROM ind UNION ALL SELECT 'flat', min(flat) = max(flat) FROM ind", INDICATORS_SQL),
)

_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0) AS r_{c}"
QUERIES["spearman"] = (
    lambda spark, sf: rounded(vulnerability.spearman(vulnerability.composite(_indicators(spark, sf), TEST_PILLARS), ["vuln_equal", "vuln_expert", "b"])),
    with_ctes(
        f""", rk AS (SELECT {', '.join(_RANK.format(c=c) for c in ('vuln_equal', 'vuln_expert', 'b'))} FROM comp)
SELECT 'vuln_equal' AS a, 'vuln_expert' AS b, round(corr(r_vuln_equal, r_vuln_expert), 4) + 0.0e0 AS rho FROM rk UNION ALL
SELECT 'vuln_equal', 'b', round(corr(r_vuln_equal, r_b), 4) + 0.0e0 FROM rk UNION ALL SELECT 'vuln_expert', 'b', round(corr(r_vuln_expert, r_b), 4) + 0.0e0 FROM rk""",
        INDICATORS_SQL,
    ),
)


def descending_rank(spark, sf):
    """Rank of line prices within a return flag, ties sharing the smallest rank."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.rint("l_extendedprice").alias("price"))
    r = ranking.with_rank_desc(li, "price", "rank", by=["l_returnflag"])
    return r.groupBy("l_returnflag", "rank").agg(F.count("*").alias("n"))


QUERIES["descending_rank"] = (
    descending_rank,
    "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY round_even(l_extendedprice, 0) DESC) AS rank FROM lineitem) SELECT l_returnflag, rank, count(*) AS n FROM r GROUP BY 1, 2",
)

QUERIES["group_quantiles"] = (
    lambda spark, sf: rounded(ranking.exact_quantiles(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", [0.1, 0.5, 0.95], ["p10", "p50", "p95"], by=["l_returnflag"])),
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) + 0.0e0 AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0e0 AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) + 0.0e0 AS p95 FROM lineitem GROUP BY 1",
)

# --- district risk ------------------------------------------------------------------


def risk_inputs(spark, sf):
    """Baseline deaths and vulnerability of the districts."""
    base = mortality.build_baseline(fx.deaths(spark, sf), _districts(spark))
    return base, _districts(spark).select("ahs_code", (F.lit(0.75) + F.lit(0.6) * F.col("ahs_code") / F.lit(30.0)).alias("vuln_mult"))


def _risk(spark, sf):
    daily = fx.indexed(spark, sf).withColumn("ahs_code", (F.col("cell_id") % 10 + 1).cast("int"))
    return risk.district_risk(daily, *risk_inputs(spark, sf))


def _rr(name: str) -> str:
    import math

    from heatgrid.params import ExposureResponse

    c = ExposureResponse()
    return f"exp(vm * least(({c.slope(name)!r})::DOUBLE * e, {math.log(c.max_rr)!r}::DOUBLE))"


RISK_SQL = f"""dd AS (SELECT (cell_id % 10 + 1)::INTEGER AS ahs_code, date, avg(htsi) AS htsi, max(htsi) AS htsi_max, avg(wbgt_max) AS wbgt_max FROM indexed GROUP BY 1, 2),
dl AS (SELECT *, {fx.doy('date')}::INTEGER AS doy, lag(htsi, 1) OVER w AS l1, lag(htsi, 2) OVER w AS l2, lag(htsi, 3) OVER w AS l3 FROM dd WINDOW w AS (PARTITION BY ahs_code ORDER BY date)),
de AS (SELECT dl.*, daily_deaths_mean * seasonal_factor AS expd, 0.75e0 + 0.6e0 * dl.ahs_code / 30.0e0 AS vm,
  0.5e0 * greatest(htsi - 48.5e0, 0.0e0) + 0.25e0 * greatest(coalesce(l1, 0) - 48.5e0, 0.0e0) + 0.15e0 * greatest(coalesce(l2, 0) - 48.5e0, 0.0e0) + 0.1e0 * greatest(coalesce(l3, 0) - 48.5e0, 0.0e0) AS e
  FROM dl LEFT JOIN level USING (ahs_code) LEFT JOIN profile USING (doy)),
risk AS (SELECT *, {_rr('central')} AS rr, {_rr('low')} AS rr_low, {_rr('high')} AS rr_high FROM de)"""
RISK_CTES = (*fx.INDEX_CTES, fx.DEATHS, fx.districts_sql(), LEVEL_SQL, _profile_sql(), RISK_SQL)

QUERIES["district_risk"] = (
    lambda spark, sf: rounded(_risk(spark, sf).select("ahs_code", "date", "htsi", "htsi_max", "rr", "rr_low", "rr_high", "expected_deaths", "excess_deaths", "excess_deaths_high", "mri", "ed_surge", "ed_surge_low")),
    with_ctes(
        pick(["ahs_code", "date"], ["htsi", "htsi_max", "rr", "rr_low", "rr_high", "expd AS expected_deaths", "expd * (rr - 1) AS excess_deaths", "expd * (rr_high - 1) AS excess_deaths_high", "least(greatest(100.0e0 * (rr - 1) / 0.5e0, 0.0e0), 100.0e0) AS mri", "expd * (rr - 1) * 15 AS ed_surge", "expd * (rr_low - 1) * 8 AS ed_surge_low"], "risk"),
        *RISK_CTES,
    ),
)

QUERIES["annual_summary"] = (
    lambda spark, sf: rounded(risk.with_external_counts(risk.annual_summary(_risk(spark, sf)), {1997: 73, 1999: 100})),
    with_ctes(
        """, y AS (SELECT year(date)::INTEGER AS year, sum(expd * (rr - 1)) AS x, sum(expd * (rr_low - 1)) AS lo, sum(expd * (rr_high - 1)) AS hi, sum(expd) AS ex FROM risk GROUP BY 1),
z AS (SELECT *, CASE year WHEN 1997 THEN 73 WHEN 1999 THEN 100 END AS n FROM y)
"""
        + pick(["year", "n AS external_count"], ["x AS excess_deaths", "lo AS excess_low", "hi AS excess_high", "ex AS expected_deaths", "100.0e0 * x / ex AS attributable_fraction_pct", "x / n AS ratio_to_external"], "z"),
        *RISK_CTES,
    ),
)

QUERIES["monthly_excess"] = (
    lambda spark, sf: rounded(risk.monthly_excess(_risk(spark, sf))),
    with_ctes("SELECT month(date)::INTEGER AS month, round(sum(expd * (rr - 1)), 4) + 0.0e0 AS excess_deaths FROM risk GROUP BY 1", *RISK_CTES),
)


def heat_island(spark, sf):
    w = fx.wards(spark, sf).withColumns({"u": F.lit(25.0) + _mod_col("ward_id", 30), "n": F.lit(22.0) + _mod_col("ward_id", 9)})
    lift = scaling.heat_island("built_up_frac", "u", "n")
    return rounded(w.select("ward_id", *[c.alias(k) for k, c in lift.items()]))


def _mod_col(c: str, m: int):
    return (F.col(c) % m).cast("double")


QUERIES["heat_island"] = (
    heat_island,
    with_ctes(
        pick(
            ["ward_id"],
            ["dday AS d_day", "dnight AS d_night", "u + dday AS utci", "n + 0.55e0 * dnight AS night_wbgt", f"0.5e0 * (({fx.intensity_sql('(u + dday)')}) - ({fx.intensity_sql('u')})) + 0.2e0 * (({fx.night_sql('(n + 0.55e0 * dnight)')}) - ({fx.night_sql('n')})) AS d_htsi"],
            "(SELECT ward_id, 25.0e0 + ward_id % 30 AS u, 22.0e0 + ward_id % 9 AS n, 0.3e0 + 1.55e0 * built_up_frac AS dday, 0.5e0 + 3.0e0 * built_up_frac AS dnight FROM wards)",
        ),
        fx.WARDS,
    ),
)
