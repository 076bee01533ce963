"""Domain queries: feeds, region tags, weather enrichment, impact rules and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.functions import domain, timestamps
from sondeo.functions.moments import clip
from sondeo.operators import enrich, gates, summary
from sondeo.operators import clean as cleaning
from sondeo.plans import training_table
from sondeo.plans.catalog import decimal_round, query, table
from sondeo.plans.inputs import (
    DETECTIONS_SQL,
    DIRTY_ORDERS_SQL,
    WEATHER_SQL,
    detections,
    dirty_orders,
    weather,
)
from sondeo.sources import landed, regions
from sondeo.workspace import cut_lineage

_REGIONS_SQL = (
    "regions(region_key, region, west, south, east, north) AS (VALUES "
    + ", ".join(
        f"('{key}', '{name}', {', '.join(str(float(v)) + '::DOUBLE' for v in box.split(','))})"
        for key, name, box, _, _ in regions.REGIONS
    )
    + ")"
)


@query(
    f"""WITH {DETECTIONS_SQL}, {_REGIONS_SQL}
    SELECT event_id, latitude, longitude, region, region_key FROM detections JOIN regions
    ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east"""
)
def region_tag(spark, folder):
    points = detections(spark, folder).select("event_id", "latitude", "longitude")
    return regions.tag_regions(points, regions.region_table(spark))


@query(
    f"""WITH {DETECTIONS_SQL}, {_REGIONS_SQL}
    SELECT region_key, count(*) AS n, round(avg(frp), 8) AS avg_frp FROM detections JOIN regions
    ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east GROUP BY region_key"""
)
def region_activity(spark, folder):
    points = detections(spark, folder).select("latitude", "longitude", "frp")
    tagged = regions.tag_regions(points, regions.region_table(spark))
    return tagged.groupBy("region_key").agg(
        F.count("*").alias("n"), F.round(F.avg("frp"), 8).alias("avg_frp")
    )


@query(
    """SELECT c_custkey, c_acctbal, band FROM customer JOIN
    (VALUES ('debt', -2000.0::DOUBLE, 0.0::DOUBLE), ('low', 0.0, 4000.0), ('middle', 3000.0, 7000.0), ('high', 6500.0, 20000.0))
      bands(band, lo, hi) ON c_acctbal BETWEEN lo AND hi"""
)
def range_tag(spark, folder):
    bands = spark.createDataFrame(
        [("debt", -2000.0, 0.0), ("low", 0.0, 4000.0), ("middle", 3000.0, 7000.0), ("high", 6500.0, 20000.0)],
        "band string, lo double, hi double",
    )
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return regions.tag_ranges(df, "c_acctbal", bands, "lo", "hi", 500.0).drop("lo", "hi")


@query(
    f"""WITH {DETECTIONS_SQL}
    SELECT round_even(latitude, 0) AS lat_key, round_even(longitude, 0) AS lon_key, count(*) AS count
    FROM detections GROUP BY 1, 2"""
)
def cluster_sizes(spark, folder):
    return enrich.cluster_sizes(detections(spark, folder))


@query(
    """WITH s AS (SELECT round_even(s_acctbal / 100, 0) AS bal_key, avg(s_acctbal) AS avg_bal,
        CASE WHEN count(*) > 1 THEN min(s_nationkey) END AS nation FROM supplier GROUP BY 1)
    SELECT c_custkey, round_even(c_acctbal / 100, 0) AS bal_key,
      CASE WHEN s.bal_key IS NULL THEN -1 ELSE round(avg_bal, 4) END AS avg_bal,
      CASE WHEN s.bal_key IS NULL THEN -1 ELSE nation END AS nation
    FROM customer LEFT JOIN s ON s.bal_key = round_even(c_acctbal / 100, 0)"""
)
def rounded_key_enrich(spark, folder):
    lookup = (
        table(spark, folder, "supplier")
        .groupBy(F.bround(F.col("s_acctbal") / 100, 0).alias("bal_key"))
        .agg(
            F.round(F.avg("s_acctbal"), 4).alias("avg_bal"),
            F.when(F.count("*") > 1, F.min("s_nationkey")).alias("nation"),
        )
    )
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.bround(F.col("c_acctbal") / 100, 0).alias("bal_key")
    )
    defaults = {"avg_bal": F.lit(-1.0), "nation": F.lit(-1)}
    return enrich.lookup_with_defaults(customers, lookup, ["bal_key"], defaults).select(
        "c_custkey", "bal_key", "avg_bal", "nation"
    )


_READINGS = ["t2m", "t2m_max", "t2m_min", "prectotcorr", "rh2m", "ws2m", "allsky_sfc_sw_dwn", "gwetroot"]
_NEWEST = ", ".join(
    f"max({{'d': date, 'v': {c}}}) FILTER (WHERE {c} IS NOT NULL)['v'] AS {c}" for c in _READINGS
)


@query(
    f"""WITH {DETECTIONS_SQL}, {WEATHER_SQL},
    latest AS (SELECT round_even(latitude, 0) AS lat_key, round_even(longitude, 0) AS lon_key, true AS hit, {_NEWEST}
      FROM weather GROUP BY 1, 2),
    j AS (SELECT event_id, latitude, longitude, frp,
      CASE WHEN hit THEN t2m ELSE 28 END AS t, CASE WHEN hit THEN t2m_max ELSE 33 END AS tmax,
      CASE WHEN hit THEN t2m_min ELSE 23 END AS tmin, CASE WHEN hit THEN prectotcorr ELSE 2 END AS p,
      CASE WHEN hit THEN rh2m ELSE 50 END AS rh, CASE WHEN hit THEN ws2m ELSE exp(1.125) END AS ws,
      CASE WHEN hit THEN allsky_sfc_sw_dwn ELSE 15 END AS sr, CASE WHEN hit THEN gwetroot ELSE 0.4 END AS sm
      FROM detections d LEFT JOIN latest l ON l.lat_key = round_even(d.latitude, 0) AND l.lon_key = round_even(d.longitude, 0))
    SELECT event_id, latitude, longitude, frp, round(t, 2) AS temperature_2m, round(tmax, 2) AS temperature_max,
      round(tmin, 2) AS temperature_min, round(p, 2) AS precipitation, round(least(greatest(rh, 5), 100), 2) AS relative_humidity,
      round(ws, 2) AS wind_speed, round(sr, 2) AS solar_radiation, round(least(greatest(sm, 0), 1), 4) AS soil_moisture,
      CAST(0.5 AS DOUBLE) AS vegetation_index,
      CASE WHEN p IS NOT NULL THEN round(least(greatest(-1.5 - frp * 0.02 + p * 0.5, -6), 6), 2) END AS drought_severity_index,
      CASE WHEN p IS NOT NULL THEN round(least(greatest(p * 0.8 + rh * 0.03, 0), 10), 2) END AS flood_risk_score,
      CASE WHEN p IS NOT NULL THEN CAST(greatest(trunc(7 - p * 2), 0) AS INTEGER) END AS days_since_rain,
      round(abs(latitude) * 8 + 200, 0) AS elevation_proxy FROM j"""
)
def weather_enrichment(spark, folder):
    points = detections(spark, folder).select("event_id", "latitude", "longitude", "frp")
    return enrich.enrich_with_weather(points, weather(spark, folder))


@query(
    """SELECT l_orderkey, l_linenumber,
      round(least(greatest(-1.5 - l_quantity * 0.02 + l_tax * 100 * 0.5, -6), 6), 2) AS drought_index,
      round(least(greatest(l_tax * 100 * 0.8 + l_discount * 500 * 0.03, 0), 10), 2) AS flood_score,
      CAST(greatest(trunc(7 - l_tax * 100 * 2), 0) AS INTEGER) AS days_since_rain,
      round(abs(l_quantity) * 8 + 200, 0) AS elevation_proxy, round(l_quantity * 1.2 + 300, 4) AS brightness,
      CASE WHEN l_quantity > 30 THEN 'h' WHEN l_quantity > 10 THEN 'n' ELSE 'l' END AS confidence,
      CAST(year(l_shipdate) AS VARCHAR) || '-' || lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0') || '-15' AS acq_date
    FROM lineitem"""
)
def derived_indices(spark, folder):
    rain, humidity = F.col("l_tax") * 100, F.col("l_discount") * 500
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        domain.drought_index(F.col("l_quantity"), rain).alias("drought_index"),
        domain.flood_score(rain, humidity).alias("flood_score"),
        domain.days_since_rain(rain).alias("days_since_rain"),
        domain.elevation_proxy(F.col("l_quantity")).alias("elevation_proxy"),
        F.round(domain.brightness_from_power(F.col("l_quantity")), 4).alias("brightness"),
        domain.confidence_band(F.col("l_quantity")).alias("confidence"),
        domain.mid_month_date(F.year("l_shipdate"), F.month("l_shipdate")).alias("acq_date"),
    )


# Every event as a disaster record: its type names the disaster, its value the severity.
_DISASTERS_SQL = """
kinds AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'flood' WHEN 1 THEN 'drought' WHEN 2 THEN 'wildfire' ELSE 'storm' END AS kind,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS severity FROM events)
"""


def _disasters(spark, folder):
    key = F.col("event_id") % 4
    kind = F.when(key == 0, "flood").when(key == 1, "drought").when(key == 2, "wildfire").otherwise("storm")
    return table(spark, folder, "events").select(
        "event_id",
        kind.alias("event_type"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("flood_probability"),
        (F.col("event_id") % 6).cast("double").alias("drought_score"),
    )


@query(
    f"""WITH {_DISASTERS_SQL}, losses AS (SELECT event_id, kind, CASE kind
        WHEN 'flood' THEN least(greatest(coalesce(severity, 50) * 0.6 + 10, 5), 95)
        WHEN 'drought' THEN least(greatest(CAST(event_id % 6 AS DOUBLE) * 15 + 5, 5), 85)
        WHEN 'wildfire' THEN 65.0::DOUBLE ELSE 17.5::DOUBLE END AS loss FROM kinds)
    SELECT event_id, kind AS event_type, {decimal_round("loss", 1)} AS crop_yield_loss_pct, CASE
        WHEN kind = 'flood' THEN CASE WHEN loss > 60 THEN 'high' WHEN loss > 30 THEN 'medium' ELSE 'low' END
        WHEN kind = 'drought' THEN CASE WHEN loss > 50 THEN 'high' WHEN loss > 25 THEN 'medium' ELSE 'low' END
        WHEN kind = 'wildfire' THEN CASE WHEN loss > 70 THEN 'high' WHEN loss > 40 THEN 'medium' ELSE 'low' END
        ELSE 'low' END AS crop_impact FROM losses"""
)
def impact_rules(spark, folder):
    impacted = training_table.add_crop_impact(_disasters(spark, folder))
    return impacted.select("event_id", "event_type", "crop_yield_loss_pct", "crop_impact")


# Every event as a dashboard location.
_LOCATIONS_SQL = f"""
locations AS (SELECT event_id, value AS frp, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'nominal' ELSE 'low' END AS confidence,
  CASE event_id % 3 WHEN 0 THEN 'Fire' WHEN 1 THEN 'Flood' ELSE 'Drought' END AS disaster_type, CAST(event_id % 3 AS DOUBLE) AS step FROM events),
valued AS (SELECT *, {decimal_round("CASE disaster_type WHEN 'Flood' THEN frp * 0.1 + step * 0.15 WHEN 'Drought' THEN frp * -0.2 - step * 0.1 ELSE frp + step * 0.9 END", 2)} AS severity_value,
  frp * 1.2 + 300 AS brightness, frp / 10 AS precipitation, frp / 1000 AS soil_moisture FROM locations)
"""


def _locations(spark, folder):
    kind = F.col("event_id") % 3
    base = table(spark, folder, "events").select(
        "event_id",
        F.col("value").alias("frp"),
        F.when(F.col("event_type") == "error", "high")
        .when(F.col("event_type") == "click", "nominal")
        .otherwise("low")
        .alias("confidence"),
        F.when(kind == 0, "Fire").when(kind == 1, "Flood").otherwise("Drought").alias("disaster_type"),
        kind.cast("double").alias("step"),
    )
    frp = F.col("frp")
    return base.withColumns(
        {
            "severity_value": domain.severity_value(F.col("disaster_type"), frp, F.col("step")),
            "brightness": frp * 1.2 + 300,
            "precipitation": frp / 10,
            "soil_moisture": frp / 1000,
        }
    )


@query(
    f"""WITH {_LOCATIONS_SQL}
    SELECT event_id, severity_value, CASE disaster_type WHEN 'Flood' THEN 'Water Level (m)' WHEN 'Drought' THEN 'PDSI Index'
        ELSE 'MW (Radiative Power)' END AS severity_unit,
      CASE WHEN confidence = 'high' OR frp > 25 THEN 'Total Destruction Expected'
        WHEN confidence = 'nominal' THEN 'Moderate Damage Expected' ELSE 'Minimal To No Harm Expected' END AS crop_impact
    FROM valued"""
)
def severity_and_damage(spark, folder):
    return _locations(spark, folder).select(
        "event_id",
        "severity_value",
        domain.severity_unit(F.col("disaster_type")).alias("severity_unit"),
        domain.damage_text(F.col("confidence"), F.col("frp")).alias("crop_impact"),
    )


@query(
    f"""WITH {_LOCATIONS_SQL}, g AS (SELECT lower(disaster_type) AS kind, count(*) AS c, count(*) FILTER (WHERE confidence = 'high') AS h,
      round(avg(abs(severity_value)), 2) AS a, round(max(abs(severity_value)), 2) AS m, round(avg(brightness), 1) AS b,
      round(avg(frp), 1) AS f, round(avg(precipitation), 2) AS p, round(avg(severity_value), 2) AS s, round(avg(soil_moisture), 3) AS sm
      FROM valued GROUP BY 1)
    SELECT kind, c AS count, h AS high_count, a AS avg_severity, m AS max_severity,
      CASE WHEN kind = 'fire' THEN b END AS avg_brightness, CASE WHEN kind = 'fire' THEN f END AS avg_frp,
      CASE WHEN kind = 'flood' THEN a END AS avg_water_level, CASE WHEN kind = 'flood' THEN p END AS avg_precipitation,
      CASE WHEN kind = 'drought' THEN s END AS avg_pdsi, CASE WHEN kind = 'drought' THEN sm END AS avg_soil_moisture FROM g
    UNION ALL SELECT 'total', CAST(sum(c) AS BIGINT), CAST(sum(h) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g"""
)
def disaster_summary(spark, folder):
    return summary.disaster_summary(_locations(spark, folder))


@query(
    """SELECT coalesce(event_type, 'total') AS event_type, count(*) AS count, round(avg(abs(value)), 2) AS avg_severity,
      round(max(abs(value)), 2) AS max_severity FROM events GROUP BY ROLLUP (event_type)"""
)
def type_summary(spark, folder):
    return summary.type_summary(table(spark, folder, "events"), "event_type", "value")


@query(
    """SELECT s.event_type, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS available, coalesce(n, 0) AS n_rows, last_updated
    FROM (VALUES ('click'), ('error'), ('absent')) s(event_type)
    LEFT JOIN (SELECT event_type, count(*) AS n, max(ts) AS last_updated FROM events GROUP BY event_type) USING (event_type)"""
)
def freshness(spark, folder):
    return summary.freshness(table(spark, folder, "events"), "event_type", "ts", ["click", "error", "absent"])


# Every order as a nested event with up to five observations, some of them malformed.
_GEOMETRY_SQL = """
points AS (SELECT o_orderkey, i, o_orderkey % 6 AS n FROM orders, range(1, 7) r(i) WHERE i <= o_orderkey % 6),
recent AS (SELECT * FROM points WHERE i > n - 3 AND i % 4 <> 3)
"""


def _nested_events(spark, folder):
    key, size = F.col("o_orderkey"), (F.col("o_orderkey") % 6).cast("int")

    def observation(i):
        place = F.array((i + 10).cast("string"), F.when(i == 2, F.lit("[1, 2]")).otherwise((i + 20).cast("string")))
        return F.struct(
            F.concat(F.lit("2024-01-0"), i.cast("string"), F.lit("T00:00:00Z")).alias("date"),
            F.when(i % 4 == 3, F.slice(place, 1, 1)).otherwise(place).alias("coordinates"),
            F.when(i != 1, i.cast("double")).alias("magnitudeValue"),
            F.when(i != 1, F.lit("m")).alias("magnitudeUnit"),
        )

    steps = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    category = F.array(F.struct(F.col("o_orderpriority").alias("title")))
    return table(spark, folder, "orders").select(
        key.cast("string").alias("id"),
        F.concat(F.lit("Event "), key.cast("string")).alias("title"),
        F.when(key % 5 == 0, F.lit("2024-02-01")).alias("closed"),
        F.when(key % 7 == 0, F.slice(category, 1, 0)).otherwise(category).alias("categories"),
        F.transform(steps, observation).alias("geometry"),
    )


@query(
    f"""WITH {_GEOMETRY_SQL}
    SELECT CAST(o_orderkey AS VARCHAR) AS eonet_id, 'Event ' || o_orderkey AS eonet_title,
      CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown' ELSE o_orderpriority END AS eonet_category,
      '2024-01-0' || i || 'T00:00:00Z' AS eonet_date, CASE WHEN i = 2 THEN NULL ELSE CAST(i + 20 AS DOUBLE) END AS eonet_latitude,
      CAST(i + 10 AS DOUBLE) AS eonet_longitude, CASE WHEN i = 1 THEN NULL ELSE CAST(i AS DOUBLE) END AS eonet_magnitude_value,
      CASE WHEN i = 1 THEN '' ELSE 'm' END AS eonet_magnitude_unit, 'nasa_eonet' AS data_source
    FROM recent JOIN orders USING (o_orderkey) WHERE o_orderkey % 5 <> 0"""
)
def geometry_flatten(spark, folder):
    return landed.flatten_events(landed.select_events(_nested_events(spark, folder)))


@query(
    """WITH r AS (SELECT user_id, strftime(ts, '%Y%m%d') AS date, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)
    SELECT date, user_id, max(k) AS k, max(value) AS reading FROM r GROUP BY date, user_id"""
)
def json_map_pivot(spark, folder):
    day = F.date_format("ts", "yyyyMMdd")
    props = F.from_json("props", "map<string,double>")
    reading = F.when(F.col("event_id") % 9 == 0, F.lit(-999.0)).otherwise(F.col("value"))
    documents = table(spark, folder, "events").select(
        "user_id",
        F.create_map(
            F.lit("K"), F.create_map(day, props["k"]), F.lit("READING"), F.create_map(day, reading),
            F.lit("IGNORED"), F.create_map(day, F.lit(1.0)),
        ).alias("parameters"),
    )
    return landed.pivot_parameters(documents, ["user_id"], "parameters", ["K", "READING"])


@query(
    """SELECT strftime(o_orderdate, '%Y%m%d') AS date, count(*) AS n FROM orders
    WHERE o_orderdate BETWEEN DATE '1998-06-23' AND DATE '1998-06-30' GROUP BY 1"""
)
def recent_days(spark, folder):
    dated = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("date"))
    recent = landed.recent_days(dated, F.lit("1998-06-30").cast("date"), 7)
    return recent.groupBy("date").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 2 = 0 THEN NULL ELSE
      least(greatest(l_quantity, 10), 40) END AS clipped FROM lineitem"""
)
def clip_values(spark, folder):
    value = F.when(F.col("l_quantity") % 2 != 0, F.col("l_quantity"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", clip(value, 10.0, 40.0).alias("clipped")
    )


@query(
    """SELECT event_id, value AS frp, value AS severity, 2024 AS year, CAST(month(ts) AS INTEGER) AS month, value / 2 AS temperature,
      value / 2 AS temperature_2m, 300 + value * 1.2 AS brightness,
      CASE WHEN value > 30 THEN 'h' WHEN value > 10 THEN 'n' ELSE 'l' END AS confidence, 'N' AS satellite, 'D' AS daynight,
      '2024-' || lpad(CAST(month(ts) AS VARCHAR), 2, '0') || '-15' AS acq_date, 'kaggle_training' AS data_source FROM events"""
)
def align_training_rows(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id",
        F.col("value").alias("severity"),
        F.lit(2024).alias("year"),
        F.month("ts").alias("month"),
        (F.col("value") / 2).alias("temperature"),
    )
    return training_table.align_to_detections(rows)


@query(
    f"""WITH {_DISASTERS_SQL}, flood AS (SELECT 'flood' AS event_type, CAST(user_id AS DOUBLE) AS temperature, value AS precipitation,
        CAST(NULL AS DOUBLE) AS latitude, 'kaggle_flood' AS data_source, least(greatest(value * 0.6 + 10, 5), 95) AS loss FROM events),
      fire AS (SELECT 'wildfire' AS event_type, CAST(NULL AS DOUBLE) AS temperature, l_tax AS precipitation, l_quantity AS latitude,
        'kaggle_wildfire' AS data_source, 65.0::DOUBLE AS loss FROM lineitem),
      u AS (SELECT * FROM flood UNION ALL SELECT * FROM fire)
    SELECT event_type, round(coalesce(latitude, (SELECT quantile_cont(latitude, 0.5) FROM u)), 4) AS latitude,
      round(coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM u)), 4) AS temperature,
      precipitation, {decimal_round("loss", 1)} AS crop_yield_loss_pct,
      CASE WHEN event_type = 'flood' THEN CASE WHEN loss > 60 THEN 'high' WHEN loss > 30 THEN 'medium' ELSE 'low' END ELSE 'medium' END AS crop_impact,
      data_source FROM u"""
)
def training_table_build(spark, folder):
    flood = table(spark, folder, "events").select(
        F.col("user_id").cast("double").alias("Temp"), F.col("value").alias("Rainfall (mm)")
    )
    fire = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("Lat"), F.col("l_tax").alias("Rain"), F.col("l_suppkey").alias("Population")
    )
    frames = [
        training_table.add_crop_impact(training_table.canonical_source(df, event))
        for df, event in ((flood, "flood"), (fire, "wildfire"))
    ]
    built = training_table.combine_sources(frames).drop("crop_type")
    return built.withColumns({c: F.round(c, 4) for c in ("latitude", "temperature")})


_GATES_SQL = f"""WITH {DIRTY_ORDERS_SQL}, d AS (SELECT DISTINCT * FROM dirty)
SELECT 'data_collection' AS stage, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value, 10.0::DOUBLE AS threshold,
  CASE WHEN count(*) >= 10 THEN 1 ELSE 0 END AS passed FROM dirty
UNION ALL SELECT 'data_collection', 'columns', 5, 2, 1
UNION ALL SELECT 'data_cleaning', 'max_missing_pct', v, 0.05, CASE WHEN v <= 0.05 THEN 1 ELSE 0 END FROM
  (SELECT greatest(round(1 - CAST(count(o_totalprice) AS DOUBLE) / count(*), 4), round(1 - CAST(count(o_orderpriority) AS DOUBLE) / count(*), 4)) AS v FROM d)
UNION ALL SELECT 'data_cleaning', 'rows_retained_pct', v, 0.8, CASE WHEN v >= 0.8 THEN 1 ELSE 0 END FROM
  (SELECT round(CAST((SELECT count(*) FROM d) AS DOUBLE) / count(*), 4) AS v FROM dirty)"""


@query(_GATES_SQL)
def quality_gates(spark, folder):
    raw = dirty_orders(spark, folder)
    deduplicated = cleaning.drop_duplicates(raw)
    return gates.collection_gate(raw).unionByName(gates.cleaning_gate(deduplicated, raw))


@query(
    """SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day_number,
      epoch_us(ts) AS micros FROM events"""
)
def wall_clock(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        F.datediff(timestamps.day("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day_number"),
        timestamps.wall_micros("ts").alias("micros"),
    )


# The same figures, gathered by the job that writes the table without repeated rows.
@query(_GATES_SQL)
def observed_gates(spark, folder):
    raw = gates.ObservedGates(dirty_orders(spark, folder))
    unique = gates.ObservedGates(cleaning.drop_duplicates(raw.rows))
    cut_lineage(unique.rows)
    return raw.collection_gate().unionByName(unique.cleaning_gate(raw))
