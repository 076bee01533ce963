"""Readers, feeds, regions, canonical names, rules and summaries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sondeo.functions import domain
from sondeo.operators import enrich, summary
from sondeo.plans import training_table
from sondeo.sources import canonical, files, landed, regions, tables


def test_formats_by_extension(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x,y\n1,a\n2,\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\ta\n")
    (tmp_path / "c.json").write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2, "y": "b"}], indent=1))
    (tmp_path / "d.json").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    (tmp_path / "e.json").write_text('[{"x": 1}, {"x": 2}]')
    a = files.load(spark, str(tmp_path / "a.CSV"))
    assert a.dtypes == [("x", "int"), ("y", "string")]
    assert a.where("y IS NULL").count() == 1
    assert files.load(spark, str(tmp_path / "b.tsv")).first()["y"] == "a"
    assert [files.load(spark, str(tmp_path / f"{n}.json")).count() for n in "cde"] == [2, 3, 2]
    with pytest.raises(ValueError, match="no reader"):
        files.load(spark, "table.xlsx")


def test_nan_becomes_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(str(tmp_path / "n.parquet"))
    assert files.load(spark, str(tmp_path / "n.parquet")).where("x IS NULL").count() == 1


def test_directory_inventory_and_smallest(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "big.csv").write_text("x\n" + "\n".join("12345" for _ in range(50)) + "\n")
    (tmp_path / "deep" / "small.csv").write_text("x\n7\n8\n")
    (tmp_path / "note.txt").write_text("x")
    assert files.load_directory(spark, str(tmp_path)).count() == 52
    names = [r["path"].rsplit("/", 1)[1] for r in files.file_inventory(spark, str(tmp_path)).collect()]
    assert names == ["small.csv", "big.csv"]
    assert [r["x"] for r in files.load_smallest_file(spark, str(tmp_path)).collect()] == [7, 8]


def test_detections_by_region_folder(spark, tmp_path):
    header = "latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,confidence,version,bright_t31,frp,daynight\n"
    for key in ("california", "vietnam"):
        folder = tmp_path / f"region_key={key}"
        folder.mkdir()
        (folder / "f.csv").write_text(header + "10.5,20.5,300,1,1,2024-01-01,45,N,h,2.0,290,12.5,D\n")
    found = landed.read_detections(spark, str(tmp_path), regions.region_table(spark)).orderBy("region_key").collect()
    assert [(r["region_key"], r["region"], r["frp"]) for r in found] == [
        ("california", "California, USA", 12.5), ("vietnam", "Vietnam", 12.5),
    ]


def test_event_documents(spark, tmp_path):
    def point(day, coordinates, value=None):
        return {"date": f"2024-01-0{day}T00:00:00Z", "coordinates": coordinates, "magnitudeValue": value, "magnitudeUnit": None}

    events = [
        {"id": "five", "title": "t", "categories": [{"title": "Wildfires"}, {"title": "x"}], "geometry": [point(d, [d, -d], 1.5) for d in range(1, 6)]},
        {"id": "two", "title": "t", "categories": [], "geometry": [point(1, [1, 2]), point(2, [3, 4])]},
        {"id": "none", "title": "t", "categories": [{"title": "c"}], "geometry": []},
        {"id": "short", "title": "t", "categories": [{"title": "c"}], "geometry": [point(1, [1])]},
        {"id": "polygon", "title": "t", "categories": [{"title": "c"}], "geometry": [point(1, [[[1, 2], [3, 4]]])]},
        {"id": "closed", "title": "t", "closed": "2024-01-09", "categories": [], "geometry": [point(1, [1, 2])]},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"title": "feed", "events": events}))
    nested = landed.read_event_documents(spark, str(tmp_path / "e.json"))
    flat = landed.flatten_events(landed.select_events(nested))
    found = sorted((r["eonet_id"], r["eonet_category"], r["eonet_latitude"], r["eonet_longitude"], r["eonet_magnitude_unit"]) for r in flat.collect())
    assert found == [
        ("five", "Wildfires", -5.0, 5.0, ""), ("five", "Wildfires", -4.0, 4.0, ""), ("five", "Wildfires", -3.0, 3.0, ""),
        ("two", "Unknown", 2.0, 1.0, ""), ("two", "Unknown", 4.0, 3.0, ""),
    ]
    asof = F.lit("2024-01-06").cast("timestamp")
    assert [r["id"] for r in landed.select_events(nested, asof, days=2).collect()] == ["five"]
    assert [r["id"] for r in landed.select_events(nested, status="closed").collect()] == ["closed"]
    assert [r["id"] for r in landed.select_events(nested, limit=1).collect()] == ["five"]


def test_weather_documents(spark, tmp_path):
    parameters = {
        "T2M": {"20240101": 10.0, "20240102": -999.0}, "T2M_MAX": {"20240101": 15.0},
        "PRECTOTCORR": {"20240101": 0.5, "20240102": 1.5, "20240103": 2.5}, "OTHER": {"20240109": 1.0},
    }
    (tmp_path / "w.json").write_text(json.dumps({"geometry": {"coordinates": [77.5, 12.5, 9.0]}, "properties": {"parameter": parameters}}, indent=1))
    flat = landed.flatten_weather(landed.read_weather_documents(spark, str(tmp_path / "w.json")))
    found = {r["date"]: (r["latitude"], r["longitude"], r["t2m"], r["t2m_max"], r["prectotcorr"], r["gwetroot"]) for r in flat.collect()}
    assert found == {
        "20240101": (12.5, 77.5, 10.0, 15.0, 0.5, None),
        "20240102": (12.5, 77.5, None, None, 1.5, None),
        "20240103": (12.5, 77.5, None, None, 2.5, None),
    }


def test_regions(spark):
    table = regions.region_table(spark)
    assert table.count() == 20
    row = table.where("region_key = 'brazil_central'").first()
    assert (row["west"], row["south"], row["east"], row["north"]) == (-55.0, -25.0, -40.0, -10.0)
    points = spark.createDataFrame([("two", 24.5, 69.0), ("asia", 15.0, 104.0), ("edge", 24.0, 69.0), ("none", 80.0, 0.0)], "id string, latitude double, longitude double")
    found = {}
    for r in regions.tag_regions(points, table).collect():
        found.setdefault(r["id"], set()).add(r["region_key"])
    assert found == {"two": {"india_north", "india_west"}, "asia": {"thailand", "vietnam"}, "edge": {"india_north", "india_west"}}


@pytest.mark.parametrize(
    "rules, names",
    [
        (canonical.FLOOD_RULES, {"Rainfall (mm)": "precipitation", "Temp": "temperature", "Humidity": "humidity", "Flood_Risk": "flood_probability", "River Discharge": "river_discharge"}),
        (canonical.DROUGHT_RULES, {"PRECTOT": "precipitation", "T2M": "temperature", "T2M_MAX": "temperature_max", "T2M_MIN": "temperature_min", "QV2M": "specific_humidity", "WS10M": "wind_speed", "score": "drought_score"}),
        (canonical.WILDFIRE_RULES, {"Lat": "latitude", "Lon": "longitude", "Avg_Temp": "temperature", "Wind": "wind_speed", "Humidity": "humidity", "Rain": "precipitation", "Risk_Level": "fire_risk_level", "Fire Level": "fire_risk_level", "Region": "region"}),
    ],
)
def test_canonical_names(rules, names):
    assert canonical.canonical_names([*names, "Population", "Max_Temp_x"][: len(names) + 1], rules) == names


def test_union_widens_and_fills(spark):
    out = canonical.union_all(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2.5, "x")], "a double, b string"))
    assert out.dtypes == [("a", "double"), ("b", "string")]
    assert sorted(out.collect(), key=str) == [(1.0, None), (2.5, "x")]


def test_enrichment_hits_misses_and_rounding(spark):
    weather = spark.createDataFrame(
        [(2.0, 10.0, "20240101", 20.0, None), (2.0, 10.0, "20240102", 21.0, None), (4.0, 10.0, "20240101", 30.0, 1.0), (4.0, 10.0, "20240102", 31.0, None)],
        "latitude double, longitude double, date string, t2m double, prectotcorr double",
    )
    for name in ("t2m_max", "t2m_min", "rh2m", "ws2m", "allsky_sfc_sw_dwn", "gwetroot"):
        weather = weather.withColumn(name, F.lit(50.0))
    # 2.5 and 3.5 round to the even degrees 2 and 4.
    points = spark.createDataFrame([(1, 2.5, 10.2), (2, 3.5, 9.8), (3, 60.0, 60.0)], "id int, latitude double, longitude double")
    found = {r["id"]: r for r in enrich.enrich_with_weather(points, weather).collect()}
    assert (found[1]["temperature_2m"], found[1]["precipitation"], found[1]["drought_severity_index"], found[1]["days_since_rain"]) == (21.0, None, None, None)
    assert (found[2]["temperature_2m"], found[2]["precipitation"], found[2]["days_since_rain"]) == (31.0, 1.0, 5)
    assert (found[3]["temperature_2m"], found[3]["temperature_max"], found[3]["precipitation"], found[3]["relative_humidity"]) == (28.0, 33.0, 2.0, 50.0)
    assert found[3]["elevation_proxy"] == 680.0
    noisy = enrich.enrich_with_weather(points, weather, ["id"], 1.0)
    assert noisy.orderBy("id").collect() == noisy.repartition(5).orderBy("id").collect()


def test_noise_is_a_function_of_the_key(spark):
    df = spark.range(20000)
    stats = df.select(domain.key_normal(["id"], 1, 2.0).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(stats[0]) < 0.1 and abs(stats[1] - 2.0) < 0.1


def test_impact_rules_at_their_means(spark):
    df = spark.createDataFrame(
        [("flood", 0.7, 0.0), ("drought", 0.1, 3.0), ("wildfire", 0.0, 1.0), ("storm", 0.0, 0.0), ("flood", None, 0.0), ("drought", 0.0, None)],
        "event_type string, flood_probability double, drought_score double",
    )
    found = [(r["crop_yield_loss_pct"], r["crop_impact"]) for r in training_table.add_crop_impact(df).collect()]
    assert found == [(10.4, "low"), (50.0, "medium"), (65.0, "medium"), (17.5, "low"), (40.0, "medium"), (35.0, "medium")]


def test_precipitation_stands_in_only_for_an_absent_column(spark):
    df = spark.createDataFrame([("flood", 100.0, None)], "event_type string, precipitation double, flood_probability double")
    assert training_table.add_crop_impact(df).first()["crop_yield_loss_pct"] == 40.0
    assert training_table.add_crop_impact(df.drop("flood_probability")).first()["crop_yield_loss_pct"] == 70.0
    text = df.drop("flood_probability").withColumn("precipitation", F.lit("heavy"))
    assert training_table.add_crop_impact(text).first()["crop_yield_loss_pct"] == 40.0


def test_training_table_is_built_once(spark, tmp_path):
    for event, text in {"flood": "Rainfall (mm),Temp\n10,20\n30,\n", "wildfire": "Lat,Lon,Rain,Population\n1,2,3,4\n"}.items():
        (tmp_path / event).mkdir()
        (tmp_path / event / "x.csv").write_text(text)
    built = training_table.build_training_table(spark, str(tmp_path))
    assert set(built.columns) <= set(training_table.TRAINING_COLUMNS)
    assert built.count() == 3 and built.where("temperature IS NULL OR latitude IS NULL").isEmpty()
    (tmp_path / "flood" / "y.csv").write_text("Rainfall (mm),Temp\n1,1\n")
    assert training_table.build_training_table(spark, str(tmp_path)).count() == 3
    assert training_table.build_training_table(spark, str(tmp_path), force=True).count() == 4


def test_alignment_keeps_existing_columns(spark):
    df = spark.createDataFrame([(50.0, "h", 2023, 4)], "severity double, confidence string, year int, month int")
    row = training_table.align_to_detections(df).first()
    assert (row["frp"], row["confidence"], row["brightness"], row["acq_date"]) == (50.0, "h", 360.0, "2023-04-15")
    bare = training_table.align_to_detections(spark.createDataFrame([("x",)], "name string")).first()
    assert (bare["brightness"], bare["confidence"], bare["acq_date"]) == (312.0, "l", "2025-01-15")


def test_empty_disaster_type_shows_zeros(spark):
    df = spark.createDataFrame(
        [("Fire", 5.0, "high", 300.0, 5.0, 0.0, 0.1), ("Drought", -3.0, "low", 0.0, 0.0, 0.0, 0.25)],
        "disaster_type string, severity_value double, confidence string, brightness double, frp double, precipitation double, soil_moisture double",
    )
    found = {r["kind"]: r for r in summary.disaster_summary(df).collect()}
    assert (found["flood"]["count"], found["flood"]["avg_water_level"]) == (0, 0.0)
    assert (found["drought"]["avg_severity"], found["drought"]["avg_pdsi"], found["drought"]["avg_soil_moisture"]) == (3.0, -3.0, 0.25)
    assert (found["total"]["count"], found["fire"]["high_count"]) == (2, 1)


def test_versions(spark, tmp_path):
    base = str(tmp_path / "store")
    assert tables.read_version(spark, base, "k") is None
    assert not tables.has_key(spark, base, "k")
    assert tables.store_version(spark.createDataFrame([(1,)], "v int"), base, "k", "first") == 1
    assert tables.store_version(spark.createDataFrame([(2,)], "v int"), base, "k") == 2
    assert tables.read_version(spark, base, "k").first()["v"] == 2
    assert tables.read_version(spark, base, "k", 0).first()["v"] == 1
    with pytest.raises(IndexError):
        tables.read_version(spark, base, "k", 2)
    default = spark.range(1)
    assert tables.read_version(spark, base, "other", default=default) is default
    assert [(r["key"], r["version"]) for r in tables.keys(spark, base).collect()] == [("k", 2)]
    assert [(r["source"], r["version"]) for r in tables.lineage(spark, base).collect()] == [("first", 1)]
    tables.clear(spark, base)
    assert tables.current_version(spark, base, "k") == 0


def test_a_broken_line_leaves_the_other_records(spark, tmp_path):
    (tmp_path / "broken.json").write_text('{"a": 1, "b"\n' + "".join(f'{{"a": {i}}}\n' for i in range(2, 1001)))
    found = files.load(spark, str(tmp_path / "broken.json"), schema="a long")
    assert sorted(r["a"] for r in found.where("a IS NOT NULL").collect()) == list(range(2, 1001)) and found.count() == 1000
    (tmp_path / "pretty.json").write_text('{\n "a": 1,\n "b": [\n  {"c": 2}\n ]\n}')
    assert files.load(spark, str(tmp_path / "pretty.json")).select("a").collect()[0]["a"] == 1
    (tmp_path / "open.json").write_text('{"a": 5,\n "b": 6\n}')
    assert [tuple(r) for r in files.load(spark, str(tmp_path / "open.json")).collect()] == [(5, 6)]


def test_json_layouts_may_be_mixed_in_a_folder(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "lines.json").write_text('\n{"a": 1}\n{"a": 2}\n')
    (folder / "array.json").write_text('[{"a": 3},\n {"a": 4, "b": "x"}]')
    assert sorted(r["a"] for r in files.load(spark, str(folder)).collect()) == [1, 2, 3, 4]
    assert sorted(r["a"] for r in files.load_directory(spark, str(folder), ".json").collect()) == [1, 2, 3, 4]
