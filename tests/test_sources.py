"""Readers, contracts and sinks on small files."""

from __future__ import annotations

import json
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from heatgrid.operators import ingest, places
from heatgrid.params import VALUE_COLUMNS
from heatgrid.sources import geojson, health, weather


def write_hours(path, lat, lon, year, offset, days=40, drop=None, start=1):
    """Hourly file whose irradiance peaks at local solar noon."""
    cols = [c for c in VALUE_COLUMNS if c != drop]
    noon = 12 - lon / 15 + offset
    with open(os.path.join(path, f"{lat}_{lon}_{year}.csv"), "w") as f:
        f.write("," + ",".join(cols) + "\n")
        for d in range(days):
            for h in range(24):
                sun = max(0.0, 900 * math.cos(math.pi * (h + 0.5 - noon) / 12))
                v = {"T2M": 30 + h / 10, "RH2M": 50, "T2MDEW": -999 if h == 5 else 20, "PS": 100, "WS10M": 3, "ALLSKY_SFC_SW_DWN": sun}
                month, day = divmod(d, 28)
                f.write(f"{year}{start + month:02d}{day + 1:02d}{h:02d}," + ",".join(str(v[c]) for c in cols) + "\n")


@pytest.fixture
def folder(tmp_path):
    for lat, lon, off in [(20.0, 82.5, 5), (20.0, 83.0, 6), (20.25, 82.5, 5)]:
        write_hours(tmp_path, lat, lon, 2020, off)
    write_hours(tmp_path, 20.0, 82.5, 2021, 5)
    (tmp_path / "notes.csv").write_text(",T2M,RH2M,T2MDEW,PS,WS10M,ALLSKY_SFC_SW_DWN\n")
    return str(tmp_path)


def test_hourly_files_to_panel(spark, folder, tmp_path_factory):
    raw = weather.read_hourly_csv(spark, folder)
    found = weather.inventory(raw)
    assert found.count() == 4
    cells = ingest.cell_ids(found)
    assert [(r.cell_id, r.lat, r.lon) for r in cells.orderBy("cell_id").collect()] == [(0, 20.0, 82.5), (1, 20.0, 83.0), (2, 20.25, 82.5)]
    keyed = raw.join(cells, ["lat", "lon"])
    local = keyed.where("year = 2020").select(
        "cell_id", "lon", F.dayofyear(F.to_timestamp("stamp", "yyyyMMddHH")).alias("doy"), F.substring("stamp", 9, 2).cast("int").alias("hour"), F.col("ALLSKY_SFC_SW_DWN").alias("sw")
    )
    offsets = ingest.calibrate_offsets(ingest.measure_offset(local))
    assert [r.offset_h for r in offsets.orderBy("cell_id").collect()] == [5, 6, 5]
    panel = ingest.to_panel(keyed, offsets)
    assert panel.where("T2MDEW IS NULL").count() == 4 * 40
    assert {m for (m,) in panel.select(F.minute("ts_ist")).distinct().collect()} == {30}
    absent = ingest.missing_members(found)
    assert absent.count() == 2
    filled = ingest.fill_missing_cells(panel, absent, cells)
    assert filled.where("is_interpolated").count() == 2 * 40 * 24
    assert filled.where("T2MDEW IS NULL").count() == 2 * 40
    out = str(tmp_path_factory.mktemp("panel"))
    weather.write_panel(panel.unionByName(filled), out)
    assert weather.existing_years(spark, out) == {2020, 2021}
    assert weather.load_hourly(spark, out, [2021], ["cell_id"]).count() == 3 * 40 * 24
    late = panel.where("year = 2021").limit(24).withColumn("cell_id", F.lit(999)).select(*panel.columns)
    weather.write_panel(panel.unionByName(filled).unionByName(late), out)
    assert weather.load_hourly(spark, out, [2021], ["cell_id"]).count() == 3 * 40 * 24 + 24


def test_missing_column_is_refused(spark, tmp_path):
    write_hours(tmp_path, 20.0, 82.5, 2020, 5, drop="PS")
    with pytest.raises(ValueError, match="PS"):
        weather.read_hourly_csv(spark, str(tmp_path))


def test_files_must_share_one_header(spark, tmp_path):
    write_hours(tmp_path, 20.0, 82.5, 2020, 5)
    write_hours(tmp_path, 20.0, 83.0, 2020, 5, drop="RH2M")
    with pytest.raises(Exception):
        weather.read_hourly_csv(spark, str(tmp_path)).collect()


def test_no_matching_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",T2M,RH2M,T2MDEW,PS,WS10M,ALLSKY_SFC_SW_DWN\n2020010100,1,1,1,1,1,1\n")
    with pytest.raises(RuntimeError):
        weather.inventory(weather.read_hourly_csv(spark, str(tmp_path)))


def test_ambiguous_time_standard_stops(spark):
    df = spark.createDataFrame([(1, 365, 5.4)], "cell_id int, daylight_days long, measured_h double")
    with pytest.raises(Exception, match="ambiguous"):
        ingest.calibrate_offsets(df).collect()


def test_too_little_daylight_stops(spark):
    df = spark.createDataFrame([(1, 85.0, d, h, 100.0) for d in range(1, 5) for h in (11, 12)], "cell_id int, lon double, doy int, hour int, sw double")
    with pytest.raises(Exception, match="ambiguous"):
        ingest.calibrate_offsets(ingest.measure_offset(df)).collect()


def feature(wid="W1", district="Khordha", kind="Polygon", **props):
    ring = [[85.8, 20.3], [85.81, 20.3], [85.81, 20.31], [85.8, 20.31], [85.8, 20.3]]
    coords = [ring] if kind == "Polygon" else [[ring]] if kind == "MultiPolygon" else ring[0]
    return {"type": "Feature", "properties": {"ward_id": wid, "ward_name": "n", "ulb_name": "u", "district": district, **props}, "geometry": {"type": kind, "coordinates": coords}}


def load(spark, tmp_path, feats):
    path = tmp_path / "wards.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    elderly = places.district_table(spark).select("ahs_code", F.lit(9.5).alias("elderly_pct"))
    return geojson.load_wards(geojson.read_features(spark, str(path)), places.crosswalk(places.district_table(spark)), elderly)


def test_wards_load_with_filled_gaps(spark, tmp_path):
    rows = load(spark, tmp_path, [feature(population=100), feature("W2", "Angul", "MultiPolygon", ndvi=0.7, elderly_pct=3)]).orderBy("ward_id").collect()
    assert [r.ahs_code for r in rows] == [17, 15]
    assert rows[0].filled_fields == "elderly_pct,slum_pop_pct,built_up_frac,ndvi" and rows[0].elderly_pct == 9.5
    assert rows[1].population is None and rows[1].ndvi == 0.7
    assert rows[0].lat == pytest.approx(20.305, abs=1e-6) and rows[0].area_km2 == pytest.approx(0.0001 * 12321 * math.cos(math.radians(20.305)), rel=1e-6)


def test_one_broken_ward_refuses_all(spark, tmp_path):
    bad = [feature(), feature(), feature("W3", "Atlantis"), feature("W4", kind="Point"), feature(ward_name="", wid="W5")]
    with pytest.raises(geojson.ContractError) as e:
        load(spark, tmp_path, bad)
    assert all(x in str(e.value) for x in ("duplicate", "Atlantis", "geometry", "ward_name")) and "feature 0" not in str(e.value)


def test_fact_sheet_lines(spark):
    text = "\n".join(
        [
            "Khordha, Odisha - Key Indicators", "1. Population living in households with electricity (%) (97.1) 80.0", "2. Women who are literate4 (%) * 60",
            "3. Elevated blood pressure (systolic", "or diastolic) (%) 21.5 na", "4. Elevated blood pressure (%) na 30.0", "5. Households using clean fuel for cooking", "1,234 50",
        ]
    )
    docs = spark.createDataFrame([(1, text), (2, "no header\n1. Women who are literate (%) 5")], "page int, text string")
    rows = health.indicator_table(health.indicator_values(health.text_lines(docs, "page", "text"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.electricity_pct, r.women_literate_pct, r.women_high_bp_pct, r.men_high_bp_pct, r.clean_fuel_pct) == (97.1, None, 21.5, None, 1234.0)


def test_nwp_rows(spark, tmp_path):
    doc = {"cell_id": 3, "lat": 20.0, "lon": 85.0, "hourly": {"time": ["2024-05-01T01:00", "2024-05-01T02:00"], "temperature_2m": [30.0, None], "dew_point_2m": [20.0, 20.0], "surface_pressure": [1000.0, 1000.0], "wind_speed_10m": [2.0, 2.0], "shortwave_radiation": [0.0, 0.0]}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = weather.read_nwp(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].PS == 100.0 and str(rows[0].ts_utc) == "2024-05-01 00:00:00" and str(rows[0].ts_ist) == "2024-05-01 05:30:00"


def test_no_stages_are_left_after_a_job(spark, tmp_path, monkeypatch):
    import glob

    from heatgrid import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    total = session.cut_lineage(session.cut_lineage(spark.range(10)).selectExpr("sum(id) AS s"))
    assert total.first().s == 45 and len(glob.glob(f"{tmp_path}/*/stage-*")) == 2
    step = session.distilled(spark, lambda: session.cut_lineage(session.cut_lineage(spark.range(5))))
    assert step.count() == 5 and len(glob.glob(f"{tmp_path}/*/*")) == 3
    session.clear_scratch(spark)
    assert os.listdir(tmp_path) == []


def test_half_written_bundle_is_never_read(spark, tmp_path):
    import shutil

    from heatgrid.sources import documents

    meta = {"generatedAt": "2024", "bandEdges": [1.0], "indexWeights": {}, "exposureResponse": {"threshold": 1.0, "reference": 2.0, "rrAtReference": [1.0], "lagWeights": [1.0]}}
    table = lambda n: {"a": spark.range(n).withColumn("x", F.col("id") / 3), "b": spark.createDataFrame([], "d date, e string")}
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        documents.current_bundle(spark, path)
    first = documents.write_bundle(table(5), meta, path)
    second = documents.write_bundle(table(7), meta, path)
    assert documents.current_bundle(spark, path).endswith(second.rsplit("/", 1)[1])
    back = documents.read_bundle(spark, path)
    assert sorted(back) == ["a", "b", "metadata"] and back["a"].dtypes == table(1)["a"].dtypes
    assert sorted(map(tuple, back["a"].collect())) == sorted(map(tuple, table(7)["a"].collect())) and back["b"].count() == 0
    assert sorted(map(tuple, documents.check_bundle(spark, path).collect())) == [("a", 7, True), ("b", 0, True)]
    shutil.rmtree(f"{second}/manifest")  # as if the job had died before its last step
    assert documents.read_bundle(spark, path)["a"].count() == 5
    broken = next(p for p in (tmp_path / "bundle" / "versions" / first.rsplit("/", 1)[1] / "a").glob("part-*.json") if p.read_text())
    broken.with_name(f".{broken.name}.crc").unlink(missing_ok=True)  # Hadoop's own check, which not every store has
    broken.write_text(broken.read_text().replace('"x":', '"x":7', 1))
    assert not documents.check_bundle(spark, path).where("name = 'a' AND intact").count()


def test_cell_year_files_lie_under_their_names(spark, tmp_path):
    cols = ["lat", "lon", "year", "stamp", *weather.VALUE_COLUMNS]
    rows = [(20.0 + c, 82.5, 2020, f"20200101{h:02d}", *[float(h)] * len(weather.VALUE_COLUMNS)) for c in range(3) for h in range(2)]
    hours = spark.createDataFrame(rows, cols)
    weather.write_cell_years(hours, str(tmp_path / "fresh"))
    assert sorted(p.name for p in (tmp_path / "fresh").glob("*.csv")) == [f"{20.0 + c}_82.5_2020.csv" for c in range(3)]
    assert weather.read_hourly_csv(spark, str(tmp_path / "fresh")).count() == 6
    one = weather._a_file(spark, str(tmp_path / "fresh"))
    assert re.fullmatch(weather.FILE_PATTERN, one.split("/")[-1]) and weather._a_file(spark, str(tmp_path)) is None


def test_cell_year_files_are_written_in_place(spark, tmp_path):
    """Tasks write the files themselves: none is staged, checked beside or moved, and each holds its hours in order."""
    cols = "lat double, lon double, year int, stamp string, " + ", ".join(f"{c} double" for c in weather.VALUE_COLUMNS)
    rest = [None] * (len(weather.VALUE_COLUMNS) - 2)
    rows = [(20.0 + c, -82.5, 2020 + y, f"{2020 + y}0101{h:02d}", h / 4, 1e-5 if h else None, *rest) for c in range(3) for y in range(2) for h in (2, 0, 1)]
    weather.write_cell_years(spark.createDataFrame(rows, cols).repartition(5), str(tmp_path / "fresh"))
    assert sorted(os.listdir(tmp_path / "fresh")) == sorted(f"{20.0 + c}_-82.5_{2020 + y}.csv" for c in range(3) for y in range(2))
    commas = "," * len(rest)
    want = ["," + ",".join(weather.VALUE_COLUMNS), f"2020010100,0.0,{commas}", f"2020010101,0.25,1.0E-5{commas}", f"2020010102,0.5,1.0E-5{commas}"]
    assert (tmp_path / "fresh" / "21.0_-82.5_2020.csv").read_text().split("\n") == [*want, ""]
    back = weather.read_hourly_csv(spark, str(tmp_path / "fresh"))
    assert back.count() == 18 and back.where(f"{weather.VALUE_COLUMNS[1]} IS NULL").count() == 6
    weather.write_cell_years(spark.createDataFrame([], cols), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []
