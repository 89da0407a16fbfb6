"""Queries of land cover, features, neighbourhoods, plans, tables and rules, with the same in SQL; see queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions import confidence, dates, geo, hashing, indices, probability, projection
from cinderlake.operators import boosting, evaluation, features, gate, landcover, morphology, planning, points, polygons, raster, reports, selection
from cinderlake.plans.derived import Tables
from cinderlake.queries import EVENTS, INTERVAL, ON, PX, VERDICT, B, D, N, S, drawn, focal, marked, query, rounded
from cinderlake.sources import detections as exports
from cinderlake.sources import store, tables, tiff
from cinderlake.staging import shared_folder, staged

# --- detections and land cover -----------------------------------------------------------------------------------

#: Tiles of 30 x 30 pixels between 82 and 100 degrees east, a quarter of them cropland.
LAND = """land AS (SELECT 'N' || CAST(51 + 3 * ty AS INT) || 'E' || lpad(CAST(CAST(81 + 3 * tx AS INT) AS VARCHAR), 3, '0') AS tile, CAST(pr AS INT) AS pr, CAST(pc AS INT) AS pc, CASE WHEN (pr + pc) % 4 = 0 THEN 1 ELSE 0 END AS cropland
FROM range(0, 4) a(ty), range(0, 6) b(tx), range(0, 30) c(pr), range(0, 30) e(pc))"""
CLASSED = f"""{D}, {LAND}, cl AS (SELECT d.*, CASE WHEN cropland = 1 THEN 'cropland' WHEN cropland = 0 THEN 'other' ELSE 'unknown' END AS land_class FROM d LEFT JOIN land
ON tile = 'N' || lpad(CAST(CAST(floor(latitude / 3) * 3 AS INT) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(floor(longitude / 3) * 3 AS INT) AS VARCHAR), 3, '0')
AND pr = CAST(floor((floor(latitude / 3) * 3 + 3 - latitude) / 0.1::DOUBLE) AS INT) AND pc = CAST(floor((longitude - floor(longitude / 3) * 3) / 0.1::DOUBLE) AS INT))"""


def _classed(t: Tables) -> DataFrame:
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    land = t.spark.range(1).select(spread(4, "ty")).select("ty", spread(6, "tx")).select("ty", "tx", spread(30, "row")).select("ty", "tx", "row", spread(30, "col"))
    name = F.concat(F.lit("N"), (F.col("ty") * 3 + 51).cast("string"), F.lit("E"), F.lpad((F.col("tx") * 3 + 81).cast("string"), 3, "0"))
    land = land.select(name.alias("tile"), "row", "col", F.when((F.col("row") + F.col("col")) % 4 == 0, 1).otherwise(0).alias("cropland"))
    return landcover.land_class(t.detections(), land, side=30)


@query(f"WITH {CLASSED} SELECT ordinal, land_class FROM cl")
def p11_land_class(t: Tables) -> DataFrame:
    return _classed(t).select("ordinal", "land_class")


@query(f"WITH {CLASSED} SELECT ordinal, land_class = 'cropland' AND month(acquired_at) * 100 + day(acquired_at) BETWEEN 105 AND 118 AS flagged FROM cl")
def p12_agricultural(t: Tables) -> DataFrame:
    kept, flagged = landcover.agricultural(_classed(t), [(105, 118)])
    return kept.select("ordinal", F.lit(False).alias("flagged")).unionByName(flagged.select("ordinal", F.lit(True).alias("flagged")))


@query(f"WITH {D} SELECT ordinal, CASE WHEN upper(sensor) LIKE 'VIIRS%' THEN 'categorical' WHEN upper(sensor) LIKE 'MODIS%' THEN 'numeric' END AS scale FROM d")
def p01_scale(t: Tables) -> DataFrame:
    return t.detections().select("ordinal", confidence.scale_of(F.col("sensor")).alias("scale"))


@query(f"""WITH {D}, x AS (SELECT ordinal, CAST(acquired_at AS DATE) + 5 AS e, CASE WHEN latitude <= 55 THEN 115 WHEN latitude <= 58 THEN 201 END AS a, CASE WHEN latitude <= 55 THEN 120 WHEN latitude <= 58 THEN 930 END AS z FROM d),
y AS (SELECT *, month(e) * 100 + day(e) AS md FROM x) SELECT ordinal, md BETWEEN a AND z AS ok, strftime(e, '%Y-%m-%d') AS earliest,
CASE WHEN NOT (md BETWEEN a AND z) THEN strftime(make_date(CAST(year(e) + CASE WHEN md > z THEN 1 ELSE 0 END AS BIGINT), CAST(a // 100 AS BIGINT), CAST(a % 100 AS BIGINT)), '%Y-%m-%d') END AS next_start FROM y""")
def p10_season_check(t: Tables) -> DataFrame:
    band = dates.season_band(F.col("latitude"), [(58.0, 201, 930), (55.0, 115, 120)])
    found = t.detections().select("ordinal", dates.season_check(F.to_date("acquired_at"), band).alias("x"))
    return found.select("ordinal", "x.ok", F.col("x.earliest").cast("string").alias("earliest"), F.col("x.next_start").cast("string").alias("next_start"))


@query(f"WITH RECURSIVE {EVENTS} SELECT event_root FROM ev WHERE last_seen >= TIMESTAMP '2024-01-10' AND first_seen <= TIMESTAMP '2024-01-14'")
def p07_events_between(t: Tables) -> DataFrame:
    ev = points.events(points.event_members(t.detections()))
    return tables.events_between(ev, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-14").cast("timestamp")).select("event_root")


@query(f"WITH RECURSIVE {EVENTS} SELECT event_root, n, event_root * 2.5::DOUBLE AS area_ha FROM ev WHERE event_root % 3 = 0")
def j05_burns_of_events(t: Tables) -> DataFrame:
    ev = points.events(points.event_members(t.detections())).select("event_root", "n")
    burns = t.detections().where("ordinal % 3 = 0").select(F.col("ordinal").alias("event_root"), (F.col("ordinal") * 2.5).alias("area_ha"))
    return tables.burns_of_events(ev, burns, "event_root")


@query(f"WITH RECURSIVE {EVENTS} SELECT event_root, list_transform(list_sort(list((acquired_at, ordinal))), lambda x: x[2])::VARCHAR AS history FROM m GROUP BY event_root")
def a04_history(t: Tables) -> DataFrame:
    h = points.history(points.event_members(t.detections()))
    return h.select("event_root", F.concat(F.lit("["), F.array_join(F.transform("history", lambda x: x["ordinal"].cast("string")), ", "), F.lit("]")).alias("history"))


@query(f"WITH RECURSIVE {EVENTS}, p AS (SELECT event_root, 500 / 111320.0::DOUBLE AS dlat, 500 / (111320.0::DOUBLE * greatest(cos(radians((south + north) / 2)), 1e-6)) AS dlon, west, south, east, north FROM ev) SELECT event_root, round(west - dlon, 6) AS w, round(south - dlat, 6) AS s, round(east + dlon, 6) AS e, round(north + dlat, 6) AS n FROM p")
def a03_padded_bbox(t: Tables) -> DataFrame:
    ev = points.events(points.event_members(t.detections()))
    w, s, e, n = geo.padded_bbox(F.col("west"), F.col("south"), F.col("east"), F.col("north"), 500.0)
    return rounded(ev.select("event_root", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n")), "w", "s", "e", "n")


@query(f"""WITH RECURSIVE {EVENTS}, b AS (SELECT event_root % 3 AS kind, CASE WHEN event_root % 4 = 0 THEN 'masked' ELSE 'ok' END AS status, CAST(n AS DOUBLE) AS area_ha, event_root % 5 <> 0 AS validated FROM ev)
SELECT coalesce(sum(area_ha) FILTER (status = 'ok'), 0.0) AS area_ha, count(*) FILTER (status = 'ok') AS counted, count(*) FILTER (status = 'ok' AND NOT validated) AS unvalidated, count(*) FILTER (status <> 'ok') AS other,
count(*) FILTER (status = 'ok') > 0 AND count(*) FILTER (status = 'ok' AND NOT validated) = 0 AS validated FROM b""")
def a15_area_stats(t: Tables) -> DataFrame:
    ev = points.events(points.event_members(t.detections()))
    status = F.when(F.col("event_root") % 4 == 0, "masked").otherwise("ok")
    return reports.area_stats(ev.select(status.alias("status"), F.col("n").cast("double").alias("area_ha"), (F.col("event_root") % 5 != 0).alias("validated")))


@query(f"""WITH {D}, k AS (SELECT *, CASE WHEN sensor LIKE 'MODIS%' THEN 'fire_M-C61_x.csv' WHEN sensor LIKE '%SNPP%' THEN 'fire_SV-C2_x.csv' ELSE 'fire_J1V-C2_x.csv' END AS member FROM d)
SELECT ordinal, CASE WHEN member LIKE '%M-C61%' THEN 'MODIS_SP' WHEN member LIKE '%SV-C2%' THEN 'VIIRS_SNPP_SP' ELSE 'VIIRS_NOAA20_SP' END AS sensor FROM k""")
def s09_sensor_of_name(t: Tables) -> DataFrame:
    s = F.col("sensor")
    name = F.when(s.startswith("MODIS"), "fire_M-C61_x.csv").when(s.contains("SNPP"), "fire_SV-C2_x.csv").otherwise("fire_J1V-C2_x.csv")
    return t.detections().select("ordinal", exports.sensor_of_name(name).alias("sensor"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day FROM events), h AS (SELECT max(day) + 1 AS stop, max(day) + 1 - min(day) AS days FROM e), w AS (SELECT unnest(range(0, days, 5)) AS back, stop, days FROM h),
n AS (SELECT (stop - 1 - day) // 5 * 5 AS back, count(*) AS n FROM e, h GROUP BY 1) SELECT strftime(stop - CAST(least(back + 5, days) AS INT), '%Y-%m-%d') AS a, strftime(stop - CAST(back AS INT), '%Y-%m-%d') AS z, coalesce(n, 0) AS detections FROM w LEFT JOIN n USING (back)""")
def s10_backfill_windows(t: Tables) -> DataFrame:
    """The steps back over all days that the events have, and the events of each."""
    day = t.read("events").select(F.to_date("ts").alias("day"))
    span = day.agg(F.date_add(F.max("day"), 1).alias("stop"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days")).first()
    w = exports.backfill_windows(t.spark, str(span.stop), span.days).withColumn("back", F.datediff(F.lit(span.stop), "window_end"))
    n = day.groupBy((F.floor((F.datediff(F.lit(span.stop), "day") - 1) / 5) * 5).cast("int").alias("back")).agg(F.count("*").alias("detections"))
    return w.join(n, "back", "left").select(F.col("window_start").cast("string").alias("a"), F.col("window_end").cast("string").alias("z"), F.coalesce("detections", F.lit(0)).alias("detections"))


JOURNALLED = "j AS (SELECT user_id % 4 AS source, event_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN value > 40 THEN 1 ELSE 0 END AS found, ts FROM events)"


@query(f"WITH {JOURNALLED} SELECT source, strftime(min(CAST(ts AS DATE)) FILTER (status = 'ok' AND found > 0), '%Y-%m-%d') AS first_day FROM j GROUP BY source")
def s11_first_day_with_data(t: Tables) -> DataFrame:
    e = t.read("events")
    j = e.select((F.col("user_id") % 4).alias("source"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("value") > 40, 1).otherwise(0).alias("detection_count"), F.col("ts").alias("window_start"))
    return tables.first_day_with_data(j).select("source", F.col("first_day").cast("string").alias("first_day"))


@query(f"WITH {D}, k AS (SELECT *, row_number() OVER (PARTITION BY sensor, acquired_at, round(latitude, 5), round(longitude, 5) ORDER BY ordinal % 2 = 1, ordinal) AS n FROM d) SELECT ordinal, ordinal % 2 = 0 AS in_event FROM k WHERE n = 1")
def s17_snapshot(t: Tables) -> DataFrame:
    """Detections saved with an event each, if their number is even, and read again."""
    import uuid

    from cinderlake.staging import shared_folder

    d = t.detections()
    alone = points.event_id(F.col("latitude"), F.col("longitude"), F.col("acquired_at"))
    path = f"{shared_folder(t.spark)}/snapshots-{uuid.uuid4().hex}"
    # an event per place and time, so that its id is that of any of its detections
    store.save_snapshot(t.spark, path, d.withColumn("event_id", F.when(F.col("ordinal") % 2 == 0, alone)), t.spark.createDataFrame([("a",)], "source string"), {"radius_m": 3000})
    if store.load_snapshot(t.spark, path, {"radius_m": 1}) is not None:
        raise ValueError("a snapshot of another configuration was loaded")
    loaded = store.load_snapshot(t.spark, path, {"radius_m": 3000})
    return loaded[0].select("ordinal", F.col("event_id").isNotNull().alias("in_event"))


@query("""WITH a AS (SELECT p_partkey AS code, CASE p_size % 4 WHEN 0 THEN ['Spain', p_brand] WHEN 1 THEN [p_brand] WHEN 2 THEN [] ELSE NULL END AS c, CASE WHEN p_size % 2 = 0 THEN 'Wildfire' ELSE 'Flood' END AS category FROM part)
SELECT code, array_to_string(coalesce(c, []), ',') AS countries, coalesce(len(c), 0) = 0 AS unknown_country, category FROM a""")
def s32_activations(t: Tables) -> DataFrame:
    m, brand = F.col("p_size") % 4, F.col("p_brand")
    text = F.when(m == 0, F.concat(F.lit('[{"name": " Spain "}, {"name": "'), brand, F.lit('"}]'))).when(m == 1, F.concat(F.lit('["'), brand, F.lit('"]'))).when(m == 2, F.lit("[]"))
    kind = F.when(F.col("p_size") % 2 == 0, F.lit('{"name": "Wildfire"}')).otherwise(F.lit('"Flood"'))
    found = exports.activations(t.read("part").select(F.col("p_partkey").alias("code"), text.alias("countries"), kind.alias("category")))
    return found.select("code", F.array_join("countries", ",").alias("countries"), "unknown_country", "category")


@query("SELECT p_partkey AS k, 'T' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') || 'ABC' AS tile, strftime(DATE '2024-01-01' + CAST(p_partkey % 366 AS INT), '%Y-%m-%d') AS day FROM part")
def s33_product_name(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 366).cast("int"))
    name = F.concat(F.lit("HLS.S30.T"), F.lpad((F.col("p_size") % 60).cast("string"), 2, "0"), F.lit("ABC."), F.date_format(day, "yyyyDDD"), F.lit("T101010.v2.0"))
    found = t.read("part").select(F.col("p_partkey").alias("k"), exports.product_name(name).alias("x"))
    return found.select("k", F.concat(F.lit("T"), F.col("x.tile")).alias("tile"), F.col("x.day").cast("string").alias("day"))


@query("SELECT o_orderkey AS k, strftime(CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 2 DAY END AS DATE), '%Y-%m-%d') AS start FROM orders")
def s31_fire_start(t: Tables) -> DataFrame:
    o = t.read("orders").withColumn("d", F.to_date("o_orderdate"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "perimeter").when(F.col("o_orderkey") % 3 == 1, "activation").otherwise("scene")
    return o.select(F.col("o_orderkey").alias("k"), tables.fire_start(kind, F.col("d"), F.date_add("d", 1), F.date_add("d", 2)).cast("string").alias("start"))


@query(f"WITH {S} SELECT ordinal, CASE WHEN ordinal % 5 = 0 THEN 100.0 ELSE cloud END AS cloud FROM s WHERE ordinal % 7 <> 0")
def s22_scene_candidates(t: Tables) -> DataFrame:
    s = t.scenes()
    found = s.select("ordinal", F.when(F.col("ordinal") % 7 != 0, F.col("tile")).alias("tile"), F.when(F.col("ordinal") % 5 != 0, F.col("cloud")).alias("cloud"))
    return tables.scene_candidates(found).select("ordinal", "cloud")


@query("SELECT o.o_orderkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS value FROM orders o LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def s25_product_windows(t: Tables) -> DataFrame:
    c = t.read("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("value"))
    return tables.product_windows(t.read("orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select(F.col("o_orderkey").alias("k"), "value")


@query("SELECT p_partkey AS k, p_size AS width FROM part WHERE p_size % 2 = 0")
def s21_chip_metadata(t: Tables) -> DataFrame:
    shared = t.read("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("width"), F.when(F.col("p_size") % 2 == 0, "bs").otherwise("af").alias("kind"))
    return tables.chip_metadata(None, shared, "bs").select("k", "width")


RUNS_OF = """rn AS (SELECT chip_id, cls, min(pos) AS s, count(*) AS n FROM (SELECT chip_id, cls, pos, pos - row_number() OVER (PARTITION BY chip_id, cls ORDER BY pos) AS g FROM c3) GROUP BY chip_id, cls, g)"""
CHIP_CLASS = "CAST(CASE WHEN valid THEN (dnbr >= 0.10::DOUBLE)::INT + (dnbr >= 0.27::DOUBLE)::INT + (dnbr >= 0.66::DOUBLE)::INT ELSE 0 END AS INT)"


@query(f"""WITH {PX}, c3 AS (SELECT chip_id, pos, {CHIP_CLASS} AS cls FROM px), {RUNS_OF}
SELECT k.chip_id, CAST(c.class_id AS INT) AS class_id, coalesce((SELECT string_agg(s || ' ' || n, ' ' ORDER BY s) FROM rn WHERE rn.chip_id = k.chip_id AND rn.cls = c.class_id), '') AS rle FROM (SELECT DISTINCT chip_id FROM px) k, range(1, 5) c(class_id)""")
def s26_submission(t: Tables) -> DataFrame:
    px = t.pixels().select("chip_id", "pos", indices.severity_chip(F.col("dnbr"), F.col("valid")).alias("cls"))
    return tables.submission(px, (1, 2, 3, 4))


@query(f"WITH {PX}, k AS (SELECT DISTINCT tile FROM px) SELECT tile, CASE WHEN tile % 4 = 0 THEN tile * 1.0::DOUBLE WHEN tile % 4 = 1 THEN tile * 2.0::DOUBLE WHEN tile % 4 = 2 THEN tile * 3.0::DOUBLE END AS value, CASE tile % 4 WHEN 0 THEN 'ensemble' WHEN 1 THEN 'network' WHEN 2 THEN 'threshold' END AS source FROM k")
def s27_fallback(t: Tables) -> DataFrame:
    chips = t.pixels().select("tile").distinct()
    of = lambda keep, times: chips.where(keep).select("tile", (F.col("tile") * F.lit(times)).alias("value"))
    ranked = [("ensemble", of("tile % 4 = 0", 1.0)), ("network", of("tile % 4 < 2", 2.0)), ("threshold", of("tile % 4 < 3", 3.0))]
    return features.fallback(chips, ranked, ["tile"], "value")


@query(f"""WITH {B} SELECT id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]]}},"properties":{{"id":' || id || ',"part":' || CASE WHEN id % 2 = 0 THEN '"' || partition || '"' ELSE 'null' END || '}}}}' AS feature FROM b""")
def s28_geojson(t: Tables) -> DataFrame:
    part = F.when(F.col("id") % 2 == 0, F.col("partition")).alias("part")
    return t.boxes().select("id", tables.feature(tables.box_polygon(F.col("w"), F.col("s"), F.col("e"), F.col("n")), F.struct("id", part)).alias("feature"))


# --- rules of pixels ---------------------------------------------------------------------------------------------

SCL = "CAST((pos + chip_id) % 12 AS INT)"
SCL2 = "CASE WHEN pos % 10 = 0 THEN NULL ELSE CAST(pos * 5 % 12 AS INT) END"


def _scl(t: Tables) -> DataFrame:
    px = t.pixels()
    return px.withColumns({"scl": ((F.col("pos") + F.col("chip_id")) % 12).cast("int"), "scl2": F.when(F.col("pos") % 10 != 0, (F.col("pos") * 5 % 12).cast("int"))})


@query(f"WITH {PX}, q AS (SELECT *, {SCL} AS scl, {SCL2} AS scl2 FROM px) SELECT chip_id, pos, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND a - 0.9::DOUBLE > 0 AND b - 0.9::DOUBLE > 0 AS p14, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND coalesce(scl2 NOT IN (0, 1, 3, 8, 9, 10, 11), true) AS p15, scl IN (0, 1, 3, 9, 11) OR coalesce(scl2 IN (0, 1, 3, 9, 11), false) AS p16 FROM q")
def p14_validity(t: Tables) -> DataFrame:
    """P14, P15 and P16: valid pixels of a scene, of a chip's two dates, and pixels whose label is zero."""
    a, b, x, y = F.col("a") - 0.9, F.col("b") - 0.9, F.col("scl"), F.col("scl2")
    return _scl(t).select("chip_id", "pos", indices.valid_pixel(x, a, b).alias("p14"), indices.chip_valid(x, y).alias("p15"), indices.label_zero(x, y).alias("p16"))


@query(f"WITH {PX}, f AS (SELECT *, CAST(pos * 37 % 256 AS INT) AS m FROM px) SELECT chip_id, pos, m <> 255 AND m // 32 % 2 = 1 AS water, m = 255 OR m // 2 % 2 = 1 OR m // 8 % 2 = 1 AS bad, CAST((pos + chip_id) % 12 AS INT) = 6 AND (a - b) / (a + b + 1e-6) > 0 AS scene_water FROM f")
def p21_water_and_bad(t: Tables) -> DataFrame:
    m = (F.col("pos") * 37 % 256).cast("int")
    return _scl(t).select("chip_id", "pos", indices.water_bit(m).alias("water"), indices.hls_bad(m).alias("bad"), indices.scene_water(F.col("a"), F.col("b"), F.col("scl")).alias("scene_water"))


@query(f"WITH {PX} SELECT chip_id, pos, pos % 11 <> 0 AND pos % 13 <> 0 AND CAST((pos + chip_id) % 12 AS INT) NOT IN (0, 1, 3, 8, 9, 10, 11) AND truth - 1 >= 0 AS fine FROM px")
def p23_scene_valid(t: Tables) -> DataFrame:
    bands = F.array(F.when(F.col("pos") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("a")), F.when(F.col("pos") % 13 == 0, F.lit(-9999.0)).otherwise(F.col("b")))
    return _scl(t).select("chip_id", "pos", indices.scene_valid(bands, F.col("scl"), F.col("truth") - 1).alias("fine"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN CAST(o_orderdate AS DATE) <= DATE '1995-06-01' ELSE false END AS prior FROM orders")
def p27_prior_ignition(t: Tables) -> DataFrame:
    o = t.read("orders")
    text = F.when(F.col("o_orderkey") % 3 == 1, F.to_date("o_orderdate").cast("string")).when(F.col("o_orderkey") % 3 == 2, F.lit("unknown"))
    return o.select(F.col("o_orderkey").alias("k"), planning.prior_ignition(text, F.lit("1995-06-01")).alias("prior"))


@query(f"WITH {S} SELECT ordinal FROM s WHERE tile = 'T7' AND cloud BETWEEN 0 AND 80 AND day_no BETWEEN 30 AND 300 ORDER BY cloud, day_no, ordinal LIMIT 3")
def p28_candidates(t: Tables) -> DataFrame:
    return planning.candidates(t.scenes(), "T7", "2024-01-31", "2024-10-27").select("ordinal")


@query(f"WITH {PX}, m AS (SELECT *, CAST(pos % 7 AS INT) AS raw FROM px) SELECT chip_id, pos, CAST(CASE WHEN NOT valid THEN -1 WHEN raw = 2 THEN 0 WHEN raw = 3 THEN 1 WHEN raw = 4 THEN 2 ELSE -1 END AS INT) AS target, CAST(CASE WHEN NOT valid THEN -1 WHEN raw IN (0, 1, 5) THEN 0 WHEN raw = 2 THEN 1 WHEN raw = 3 THEN 2 WHEN raw = 4 THEN 3 ELSE -1 END AS INT) AS label FROM m")
def p29_relabelled(t: Tables) -> DataFrame:
    raw, ok = (F.col("pos") % 7).cast("int"), F.col("valid")
    return t.pixels().select("chip_id", "pos", indices.relabelled(raw, ok, indices.TARGETS).alias("target"), indices.relabelled(raw, ok, indices.EVALUATION_LABELS).alias("label"))


@query(f"WITH {PX} SELECT chip_id, pos, pred > 2 OR (dnbr > 0.27::DOUBLE AND valid) AS p30, CAST(CASE WHEN a > 1 AND valid THEN severity ELSE 0 END AS INT) AS p31 FROM px")
def p30_two_date(t: Tables) -> DataFrame:
    """P30 and P31: the two-date rule, and severity within a fixed boundary."""
    px = t.pixels()
    return px.select("chip_id", "pos", indices.two_date(F.col("pred") > 2, F.col("dnbr"), F.col("valid")).alias("p30"), indices.within_boundary(F.col("severity"), F.col("a") > 1, F.col("valid")).alias("p31"))


PROB_A, PROB_B = "least(greatest(a - 0.5::DOUBLE, 0), 1)", "least(greatest(b - 0.5::DOUBLE, 0), 1)"


def _p(name: str) -> Column:
    return F.least(F.greatest(F.col(name) - 0.5, F.lit(0.0)), F.lit(1.0))


@query(f"WITH {PX}, k AS (SELECT *, {PROB_A} >= 0.5::DOUBLE AND valid AS kept, {PROB_B} >= 0.6::DOUBLE AND valid AND NOT ({PROB_A} >= 0.5::DOUBLE AND valid) AS added FROM px) SELECT chip_id, count(*) FILTER (kept) AS kept, count(*) FILTER (added) AS added, count(*) FILTER (kept OR added) AS positive FROM k GROUP BY chip_id")
def p32_additions(t: Tables) -> DataFrame:
    px = t.pixels().withColumn("x", indices.with_additions(_p("a"), _p("b"), F.col("valid"), sure=0.6))
    return px.groupBy("chip_id").agg(*[F.count_if(F.col(f"x.{c}")).alias(c) for c in ("kept", "added", "positive")])


@query(f"WITH {PX} SELECT chip_id, (pos - 1) // 8 AS byte, CAST(sum(CASE WHEN severity > 0 THEN 1 << CAST((pos - 1) % 8 AS INT) ELSE 0 END) AS INT) AS bits FROM px GROUP BY ALL")
def p33_packed(t: Tables) -> DataFrame:
    return raster.packed(t.pixels().withColumn("m", F.col("severity") > 0), "m", ["chip_id"])


@query(f"WITH {PX} SELECT chip_id, pos, severity > 0 AS \"on\" FROM px")
def p33_unpacked(t: Tables) -> DataFrame:
    return raster.unpacked(p33_packed(t), ["chip_id"])


@query(f"WITH {PX} SELECT chip_id, pos, CASE WHEN pos % 9 <> 0 THEN round((pos * 3) * 0.0001::DOUBLE - 0.1::DOUBLE, 6) END AS refl, CASE WHEN pos % 2 = 0 THEN greatest(pos - 1000, 0) ELSE pos END AS dn FROM px")
def f10_reflectance(t: Tables) -> DataFrame:
    raw = F.when(F.col("pos") % 9 == 0, F.lit(-9999.0)).otherwise(F.col("pos") * 3.0)
    base = F.when(F.col("pos") % 2 == 0, "04.00").otherwise("03.01")
    return rounded(t.pixels().select("chip_id", "pos", indices.reflectance(raw, 0.0001, -0.1, -9999).alias("refl"), indices.harmonised_dn(F.col("pos"), base).alias("dn")), "refl")


@query(f"WITH {PX} SELECT chip_id, pos, CASE WHEN a + b <> 0 THEN (a - b) / (a + b) ELSE 0 END AS zero, CASE WHEN u + v <> 0 THEN (u - v) / (u + v) END AS ndvi FROM px")
def f05_ratios(t: Tables) -> DataFrame:
    return t.pixels().select("chip_id", "pos", indices.nbr_or_zero(F.col("a"), F.col("b")).alias("zero"), indices.ndvi(F.col("u"), F.col("v")).alias("ndvi"))


@query(f"WITH {PX} SELECT chip_id, pos, CAST(trunc((c * 20.0 + 7 - 3) / 20) AS BIGINT) AS col, CAST(trunc((500 - (r * -20.0 + 490)) / 20 * -1) AS BIGINT) AS neg FROM px")
def f07_pixel_index(t: Tables) -> DataFrame:
    row, col = geo.pixel_index(F.col("col") * 20.0 + 7, F.col("row") * -20.0 + 490, (20.0, 0.0, 3.0, 0.0, -20.0, 500.0))
    return t.pixels().select("chip_id", "pos", col.alias("col"), (-row).alias("neg"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS at FROM events")
def f09_iso_utc(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", points.iso_utc(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'ems:' || o_custkey WHEN 1 THEN 'floga:' || o_orderkey WHEN 2 THEN 'mtbs:' || o_orderstatus ELSE 'russia:' || o_orderpriority END AS name FROM orders")
def f14_event_group(t: Tables) -> DataFrame:
    m = F.col("o_orderkey") % 4
    kind = F.when(m == 0, "ems").when(m == 1, "floga").when(m == 2, "mtbs").otherwise("russia")
    return t.read("orders").select(F.col("o_orderkey").alias("k"), planning.event_group(kind, F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("name"))


@query("""WITH v AS (SELECT vec_id, [abs(x) + 0.01::DOUBLE for x in embedding::DOUBLE[]] AS x FROM embeddings), n AS (SELECT vec_id, [y / list_sum(x) for y in x] AS p FROM v),
w AS (SELECT vec_id, p, [p[i] * ([1.0::DOUBLE, 2.0, 1.0, 0.5])[(i - 1) % 4 + 1] for i in range(1, len(p) + 1)] AS w FROM n)
SELECT vec_id, round(-list_sum([y * ln(y) for y in p]), 6) AS entropy, CAST(list_position(w, list_max(w)) - 1 AS INT) AS best FROM w""")
def f17_entropy(t: Tables) -> DataFrame:
    """F17 and X07: entropy, and the first largest of weighted probabilities."""
    p = probability.normalised(F.transform("embedding", lambda v: F.abs(v.cast("double")) + 0.01))
    v = t.read("embeddings").select("vec_id", p.alias("p"))
    return rounded(v.select("vec_id", probability.entropy(F.col("p")).alias("entropy"), probability.weighted_argmax(F.col("p"), [1, 2, 1, 0.5] * 16).alias("best")), "entropy")


# --- features ----------------------------------------------------------------------------------------------------

BANDS = "SELECT *, a * 1000 AS red_pre, a * 3000 AS nir_pre, u * 2000 AS swir1_pre, b * 1500 AS swir2_pre, v * 900 AS red_post, b * 2800 AS nir_post, u * 2100 AS swir1_post, a * 1700 AS swir2_post FROM px"
DNBR = "(nir_pre - swir2_pre) / (nir_pre + swir2_pre) - (nir_post - swir2_post) / (nir_post + swir2_post)"


def _bands(t: Tables) -> DataFrame:
    made = {"red_pre": ("a", 1000), "nir_pre": ("a", 3000), "swir1_pre": ("u", 2000), "swir2_pre": ("b", 1500), "red_post": ("v", 900), "nir_post": ("b", 2800), "swir1_post": ("u", 2100), "swir2_post": ("a", 1700)}
    px = t.pixels().withColumns({n: F.col(c) * k for n, (c, k) in made.items()})
    none = F.lit(None).cast("double")
    return px.withColumns({"dem": F.col("pos") * 1.0, "slope": F.col("u") * 10, "landcover": (F.col("pos") % 9 * 10).cast("int"), "vv": F.col("a") * 500, "vh": F.col("b") * 500, "vv_after": F.when(F.col("pos") % 2 == 0, F.col("u") * 500).otherwise(none), "vh_after": none})


@query(f"""WITH {PX}, bd AS ({BANDS}), {focal(5, DNBR, "bd")}, md AS (SELECT chip_id, quantile_cont({DNBR}, 0.5) FILTER (valid) AS med FROM bd GROUP BY chip_id)
SELECT bd.chip_id, bd.pos, round({DNBR}, 6) AS dnbr, round(({DNBR}) / ((nir_pre - swir2_pre) / (nir_pre + swir2_pre) + 1.001::DOUBLE), 6) AS rbr, round((nir_post - red_post) / (nir_post + red_post), 6) AS ndvi_post,
round((swir1_pre - swir2_pre) / (swir1_pre + swir2_pre) - (swir1_post - swir2_post) / (swir1_post + swir2_post), 6) AS dnbr2, round((10 * swir2_post - 9.8::DOUBLE * swir1_post - 10 * swir2_pre + 9.8::DOUBLE * swir1_pre) / 10000, 6) AS dmirbi,
round(mu, 6) AS dnbr_win5, round(sqrt(greatest(sq - mu * mu, 0)), 5) AS dnbr_std5, round(coalesce(med, 0), 6) AS dnbr_chip, round(CASE WHEN bd.pos % 2 = 0 THEN (u - a) / 2 ELSE 0 END, 6) AS dvv, bd.pos / 1000.0::DOUBLE AS dem
FROM bd JOIN fm USING (chip_id, pos) JOIN md USING (chip_id)""")
def m01_burn_features(t: Tables) -> DataFrame:
    names = ("dnbr", "rbr", "ndvi_post", "dnbr2", "dmirbi", "dnbr_win5", "dnbr_std5", "dnbr_chip", "dvv", "dem")
    f = features.burn_features(_bands(t).drop("dnbr"), names).select("chip_id", "pos", *names)
    return rounded(rounded(f, *[n for n in names if n not in ("dem", "dnbr_std5")]), "dnbr_std5", digits=5)


@query()
def m03_boosted_trees(t: Tables) -> DataFrame:
    """Trees trained on all valid pixels' features and truth, then M04: their probability, decided at one half.

    12 rounds of up to 31 leaves; `boosting.Rules` has 300 unless told otherwise."""
    names = ("dnbr", "rbr", "ndvi_post", "dnbr2", "dmirbi", "dnbr_win5", "dnbr_std5", "dnbr_chip", "dvv", "dem", "landcover")
    f = features.burn_features(_bands(t).drop("dnbr"), names).select("chip_id", "pos", "valid", (F.col("truth") > 1).cast("long").alias("burnt"), *names)
    table = staged(f, "features")
    model = boosting.train(table.where("valid"), "burnt", names, ["landcover"], boosting.Rules(rounds=12))
    scored = boosting.predict(table, model, "p").withColumn("burnt_p", boosting.share(model, 1, "p"))
    return rounded(features.decided(scored, "burnt_p", F.col("valid")).select("chip_id", "pos", "burnt", "burnt_p", "pred"), "burnt_p")


FIRE = "SELECT *, a * 300 AS i4, b * 290 AS i5, a * 300 - b * 290 AS dt, CASE WHEN pos % 13 = 0 THEN 0 ELSE 1 END AS quality, CAST(pos % 9 * 10 AS INT) AS landcover FROM px"


def _fire(t: Tables) -> DataFrame:
    return t.pixels().withColumns({"i4": F.col("a") * 300, "i5": F.col("b") * 290, "quality": F.when(F.col("pos") % 13 == 0, 0).otherwise(1), "landcover": (F.col("pos") % 9 * 10).cast("int")})


@query(f"WITH {PX}, fr AS ({FIRE}), {focal(15, 'i4', 'fr')} SELECT fr.chip_id, fr.pos, round(dt, 5) AS dt, round(mu, 5) AS i4_bg, round(i4 - mu, 5) AS i4_anom FROM fr JOIN fm USING (chip_id, pos)")
def m02_active_fire_features(t: Tables) -> DataFrame:
    return rounded(features.active_fire_features(_fire(t)).select("chip_id", "pos", "dt", "i4_bg", "i4_anom"), "dt", "i4_bg", "i4_anom", digits=5)


@query(f"""WITH {PX}, fr AS ({FIRE}), {focal(15, 'i4', 'fr')}, bg AS (SELECT chip_id, pos, mu AS bg4 FROM fm), {focal(15, 'dt', 'fr').replace('ext AS', 'ext2 AS').replace('ext p', 'ext2 p').replace('ext q', 'ext2 q').replace('rp AS', 'rp2 AS').replace('FROM rp p', 'FROM rp2 p').replace('rp q', 'rp2 q').replace('fm AS', 'fm2 AS')}
SELECT fr.chip_id, fr.pos, i4 > 300 AND i4 - bg4 > 20 AND dt > 5 AND dt - mu > 0 AND landcover NOT IN (50, 80) AND quality > 0 AS fire FROM fr JOIN bg USING (chip_id, pos) JOIN fm2 USING (chip_id, pos)""")
def p18_active_fire(t: Tables) -> DataFrame:
    return features.active_fire(_fire(t)).select("chip_id", "pos", "fire")


@query(f"WITH {PX} SELECT chip_id, pos, {PROB_A} >= 0.6::DOUBLE AND pos % 13 <> 0 AS pred FROM px")
def m04_decided(t: Tables) -> DataFrame:
    """M04 and P17: a cutoff over probabilities on pixels of good quality."""
    return features.decided(_fire(t).withColumn("p", _p("a")), "p", F.col("quality") > 0, 0.6).select("chip_id", "pos", "pred")


# --- neighbourhoods ----------------------------------------------------------------------------------------------

SQUARES = "sqd AS (SELECT p.chip_id, p.pos, bool_or(q.severity > 3) AS d, bool_and(q.severity > 0) FILTER (abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1) AS e FROM px p JOIN px q ON q.chip_id = p.chip_id AND abs(q.r - p.r) <= 2 AND abs(q.c - p.c) <= 2 GROUP BY ALL)"


@query(f"WITH {PX}, {SQUARES} SELECT chip_id, pos, d AS dilated, e AS eroded FROM sqd")
def w22_dilated_and_eroded(t: Tables) -> DataFrame:
    px = t.pixels().withColumns({"core": F.col("severity") > 3, "any": F.col("severity") > 0})
    return morphology.eroded(morphology.dilated(px, "core", 2, "dilated"), "any", 1, "eroded").select("chip_id", "pos", "dilated", "eroded")


@query(f"WITH {PX}, x AS (SELECT p.chip_id, p.pos, bool_or(q.severity > 3) AS d, bool_and(q.severity > 3) FILTER (abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1) AS e FROM px p JOIN px q ON q.chip_id = p.chip_id AND abs(q.r - p.r) <= 2 AND abs(q.c - p.c) <= 2 GROUP BY ALL) SELECT chip_id, pos, d AND NOT e AS ring FROM x")
def w22_ring(t: Tables) -> DataFrame:
    return morphology.ring(t.pixels().withColumn("core", F.col("severity") > 3), "core", 2, 1, "ring").select("chip_id", "pos", "ring")


@query(f"WITH {PX}, f AS (SELECT chip_id, r, c FROM px WHERE pos % 101 = 0) SELECT p.chip_id, p.pos, round(20 * sqrt(min((p.r - f.r) * (p.r - f.r) + (p.c - f.c) * (p.c - f.c))), 5) AS metres FROM px p JOIN f USING (chip_id) GROUP BY p.chip_id, p.pos")
def w25_distance(t: Tables) -> DataFrame:
    return rounded(morphology.with_distance(t.pixels().withColumn("hit", F.col("pos") % 101 == 0), "hit", "metres", 20.0).select("chip_id", "pos", "metres"), "metres", digits=5)


@query()
def x04_median_filter(t: Tables) -> DataFrame:
    """Of whole rectangles, as a chip is; the derived table's last chip may be ragged, so this has a test of its own."""
    return morphology.median_filter(t.pixels(), "severity", 3, "middle").select("chip_id", "pos", "middle")


@query(f"WITH RECURSIVE {PX}, {marked('severity > 1')}, y AS (SELECT *, max(px_n) OVER (PARTITION BY chip_id) AS top, max(component) OVER (PARTITION BY chip_id) AS parts FROM cm) SELECT px.chip_id, pos, CAST(CASE WHEN y.id IS NULL THEN 0 WHEN parts > 1 AND (px_n < top * 0.25::DOUBLE OR px_n < 3) THEN 0 ELSE cls END AS INT) AS cls FROM (SELECT *, CASE WHEN severity > 1 THEN severity ELSE 0 END AS cls FROM px) px LEFT JOIN y ON y.id = px.chip_id * 10000 + pos")
def x05_relatively_small(t: Tables) -> DataFrame:
    px = t.pixels().withColumn("cls", F.when(F.col("severity") > 1, F.col("severity")).otherwise(0))
    return morphology.drop_relatively_small(px, "cls", 0.25, 3).select("chip_id", "pos", "cls")


@query(f"""WITH RECURSIVE {PX}, {marked('severity > 2')}, main AS (SELECT chip_id, arg_min(root, (-px_n, root)) AS root FROM cm GROUP BY chip_id),
far AS (SELECT p.chip_id, p.root, min(sqrt((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c))) AS distance FROM cm p JOIN main USING (chip_id) JOIN cm q ON q.chip_id = p.chip_id AND q.root = main.root GROUP BY ALL),
g AS (SELECT cm.chip_id, component, cm.root, count(*) AS px, avg({PROB_A}) AS mp FROM px JOIN cm ON cm.id = px.chip_id * 10000 + pos GROUP BY ALL)
SELECT g.chip_id, CAST(component AS INT) AS component, px, g.root = main.root AS main, round(distance, 5) AS distance, round(mp, 6) AS mean_probability FROM g JOIN far ON far.root = g.root JOIN main ON main.chip_id = g.chip_id""")
def x06_component_table(t: Tables) -> DataFrame:
    found = morphology.component_table(t.pixels().withColumns({"m": F.col("severity") > 2, "p": _p("a")}), "m", "p")
    return rounded(rounded(found, "distance", digits=5), "mean_probability")


@query(f"""WITH {PX}, w AS (SELECT *, pos % 3 = 0 AS ok FROM px), n AS (SELECT p.chip_id, p.pos, arg_min(q.severity, ((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c), q.pos)) AS near FROM w p JOIN w q ON q.chip_id = p.chip_id AND q.ok AND abs(p.r - q.r) <= 4 AND abs(p.c - q.c) <= 4 GROUP BY p.chip_id, p.pos)
SELECT w.chip_id, w.pos, CASE WHEN ok THEN severity ELSE near END AS filled FROM w JOIN n USING (chip_id, pos)""")
def x08_nearest_valid(t: Tables) -> DataFrame:
    return morphology.nearest_valid(t.pixels().withColumn("ok", F.col("pos") % 3 == 0), "severity", "ok", "filled").select("chip_id", "pos", "filled")


@query(f"""WITH {PX}, h AS (SELECT *, sqrt((r - 32.0) * (r - 32.0) + (c - 32.0) * (c - 32.0)) AS d, truth > 1 AS t, pred > 1 AND truth <= 1 AS w FROM px), k AS (SELECT CASE WHEN d < 8 THEN 0 WHEN d < 16 THEN 1 WHEN d < 24 THEN 2 WHEN d < 50 THEN 3 END AS ring, t, w FROM h)
SELECT ring, count(*) FILTER (t) / (SELECT count(*) FROM k WHERE t) AS truth_share, count(*) FILTER (w) / (SELECT count(*) FROM k WHERE w) AS wrong_share, count(*) / (SELECT count(*) FROM k) AS area_share FROM k WHERE ring IS NOT NULL GROUP BY ring""")
def x09_radial_histogram(t: Tables) -> DataFrame:
    px = t.pixels().withColumns({"t": F.col("truth") > 1, "w": (F.col("pred") > 1) & (F.col("truth") <= 1)})
    return morphology.radial_histogram(px, "t", "w", 64, 64, (0, 8, 16, 24, 50))


@query(f"""WITH {PX}, h AS (SELECT *, truth > 1 AS t, pred > 1 AS p FROM px), e AS (SELECT p.chip_id, p.pos, any_value(p.t) AS t, any_value(p.p) AS p, sqrt(min((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c))) AS d FROM h p JOIN h q ON q.chip_id = p.chip_id AND q.t <> p.t GROUP BY p.chip_id, p.pos)
SELECT CASE WHEN d <= 2 THEN 'edge' WHEN d <= 10 THEN 'near' ELSE 'far' END AS zone, count(*) FILTER (p AND NOT t) AS false_positives, count(*) FILTER (t AND NOT p) AS false_negatives FROM e GROUP BY 1""")
def x10_error_profile(t: Tables) -> DataFrame:
    return morphology.error_profile(t.pixels().withColumns({"t": F.col("truth") > 1, "p": F.col("pred") > 1}), "t", "p")


@query(f"WITH {PX}, s AS (SELECT tile, count(*) FILTER (truth > 1 AND pred > 1) AS i, count(*) FILTER (truth > 1 OR pred > 1) AS u, count(*) FILTER (truth > 1) AS n FROM px GROUP BY tile) SELECT tile, round(i / u, 6) AS iou FROM s WHERE n > 0 AND i / u < 0.6::DOUBLE")
def x10_lost(t: Tables) -> DataFrame:
    return rounded(morphology.lost(t.pixels().withColumns({"t": F.col("truth") > 1, "p": F.col("pred") > 1}), "t", "p", 0.6, by="tile"), "iou")


@query(f"WITH RECURSIVE {PX}, {marked(f'NOT (severity > 2) AND 1 - {PROB_B} > 0.55::DOUBLE')} SELECT px.chip_id, pos, severity > 2 OR coalesce(px_n >= 4, false) AS m FROM px {ON}")
def x11_override(t: Tables) -> DataFrame:
    px = t.pixels().withColumns({"burned": F.col("severity") > 2, "bg": _p("b")})
    return morphology.override(px, "burned", "bg", 0.55, 4, "m").select("chip_id", "pos", "m")


@query(f"""WITH RECURSIVE {PX}, {marked('severity > 1')}, g AS (SELECT cm.root, bool_or(pred > 3) AS hit, avg({PROB_A}) AS x, avg(1 - {PROB_B}) AS y FROM px JOIN cm ON cm.id = px.chip_id * 10000 + pos GROUP BY cm.root)
SELECT px.chip_id, pos, pred > 3 OR coalesce(px_n >= 2 AND NOT hit AND x > 0.55::DOUBLE AND y > 0.55::DOUBLE, false) AS m FROM px {ON} LEFT JOIN g ON g.root = cm.root""")
def x12_accepted(t: Tables) -> DataFrame:
    px = t.pixels().withColumns({"c": F.col("severity") > 1, "chosen": F.col("pred") > 3, "x": _p("a"), "y": 1 - _p("b")})
    return morphology.accepted_components(px, "c", "chosen", "x", "y", 2, 0.55, 0.55, "m").select("chip_id", "pos", "m")


# --- evaluation --------------------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT tile, count(*) FILTER (CAST(truth AS INT) - 1 > 0) * 25.0::DOUBLE AS product_ha FROM px GROUP BY tile")
def a18_product_area(t: Tables) -> DataFrame:
    return raster.product_area(t.pixels().withColumn("day", F.col("truth") - 1), "day", by="tile")


CELLS = [(m, x, y) for m in "ab" for x in range(4) for y in range(4)]
MIOU = lambda m: " + ".join(f"{m}{k}{k} / ({' + '.join([f'{m}{k}{k}', *[f'{m}{k}{j} + {m}{j}{k}' for j in range(4) if j != k]])})" for k in (1, 2, 3))


@query(f"""WITH {PX}, z AS (SELECT tile % 12 AS g, least(truth, 3) AS t, least(severity, 3) AS p, least(pred, 3) AS q FROM px),
o AS (SELECT g, row_number() OVER (ORDER BY g) AS place, {", ".join(f"count(*) FILTER (t = {x} AND {'p' if m == 'a' else 'q'} = {y}) AS {m}{x}{y}" for m, x, y in CELLS)} FROM z GROUP BY g),
{drawn("severity", "o", 200)}, s AS (SELECT draw, {", ".join(f"sum({m}{x}{y}) AS {m}{x}{y}" for m, x, y in CELLS)} FROM dr JOIN o USING (place) GROUP BY draw), d AS (SELECT ({MIOU('b')}) / 3 - ({MIOU('a')}) / 3 AS d FROM s), i AS (SELECT {INTERVAL} FROM d),
w AS (SELECT count(*) AS groups, {", ".join(f"sum({m}{x}{y}) AS {m}{x}{y}" for m, x, y in CELLS)} FROM o) SELECT groups, round(({MIOU('b')}) / 3 - ({MIOU('a')}) / 3, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, {VERDICT} FROM w, i""")
def a29_severity_bootstrap(t: Tables) -> DataFrame:
    px = t.pixels().select((F.col("tile") % 12).alias("g"), F.least("truth", F.lit(3)).alias("truth"), F.explode(F.array(F.struct(F.lit("a").alias("model"), F.least("severity", F.lit(3)).alias("pred")), F.struct(F.lit("b").alias("model"), F.least("pred", F.lit(3)).alias("pred")))).alias("m"))
    counts = px.select("g", "truth", "m.model", "m.pred").groupBy("g", "model", "truth", "pred").agg(F.count("*").alias("n"))
    return rounded(evaluation.severity_bootstrap(counts, "g", "a", "b", draws=200), "delta", "low", "high")


@query(f"""WITH {N}, o AS (SELECT group_id % 20 AS u, row_number() OVER (ORDER BY group_id % 20) AS place, {", ".join(f"sum({c}) FILTER (model = '{m}') AS {c}_{m}" for m in ("first", "second") for c in ("tp", "fp", "fn"))} FROM n GROUP BY group_id % 20),
{drawn("f1", "o", 500)}, s AS (SELECT draw, {", ".join(f"sum({c}_{m}) AS {c}_{m}" for m in ("first", "second") for c in ("tp", "fp", "fn"))} FROM dr JOIN o USING (place) GROUP BY draw),
d AS (SELECT 2 * tp_second / (2 * tp_second + fp_second + fn_second) - 2 * tp_first / (2 * tp_first + fp_first + fn_first) AS d FROM s), i AS (SELECT {INTERVAL} FROM d),
w AS (SELECT count(*) AS groups, 2 * sum(tp_second) / sum(2 * tp_second + fp_second + fn_second) - 2 * sum(tp_first) / sum(2 * tp_first + fp_first + fn_first) AS delta FROM o) SELECT groups, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, {VERDICT} FROM w, i""")
def a30_f1_bootstrap(t: Tables) -> DataFrame:
    return rounded(evaluation.f1_bootstrap(t.counts().withColumn("u", F.col("group_id") % 20), "u", "first", "second", draws=500), "delta", "low", "high")


WINDOWED = ", ".join(f"sum({c}_{k}) AS {c}_{k}" for k in "ab" for c in ("inter", "union"))


@query(f"""WITH {PX}, o AS (SELECT tile, row_number() OVER (ORDER BY tile) AS place, count(*) FILTER (truth > 1 AND severity > 1) AS inter_a, count(*) FILTER (truth > 1 OR severity > 1) AS union_a, count(*) FILTER (truth > 1 AND pred > 1) AS inter_b, count(*) FILTER (truth > 1 OR pred > 1) AS union_b FROM px GROUP BY tile),
{drawn("windows", "o", 300)}, s AS (SELECT draw, {WINDOWED} FROM dr JOIN o USING (place) GROUP BY draw), d AS (SELECT inter_b / union_b - inter_a / union_a AS d FROM s), i AS (SELECT {INTERVAL} FROM d),
w AS (SELECT count(*) AS groups, sum(inter_b) / sum(union_b) - sum(inter_a) / sum(union_a) AS delta FROM o) SELECT groups, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN delta > 0 AND low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'level' END AS verdict FROM w, i""")
def a31_window_bootstrap(t: Tables) -> DataFrame:
    hit = lambda c, k: [F.count_if((F.col("truth") > 1) & (F.col(c) > 1)).alias(f"inter_{k}"), F.count_if((F.col("truth") > 1) | (F.col(c) > 1)).alias(f"union_{k}")]
    return rounded(evaluation.window_bootstrap(t.pixels().groupBy("tile").agg(*hit("severity", "a"), *hit("pred", "b")), "tile", draws=300), "delta", "low", "high")


@query(f"WITH {PX} SELECT tile, bool_or(pos % 3 = 1 AND valid) AS known_event_survives, count(*) FILTER (pos % 3 = 2) AS protected_pixels, count(*) FILTER (pos % 3 = 2 AND NOT valid) AS lost_protected_pixels FROM px GROUP BY tile")
def a37_pixel_survival(t: Tables) -> DataFrame:
    return evaluation.pixel_survival(t.pixels().withColumn("proof", F.col("pos") % 3), "proof", "valid", "tile")


@query("SELECT p_partkey AS k, CASE WHEN p_size < 25 THEN '1-25' WHEN p_size < 250 THEN '25-250' ELSE '250+' END AS bin FROM part")
def a38_size_bin(t: Tables) -> DataFrame:
    return t.read("part").select(F.col("p_partkey").alias("k"), evaluation.size_bin(F.col("p_size")).alias("bin"))


@query("SELECT count(*) AS records, count(*) FILTER (p_size % 4 = 2) AS unknown_country, count(*) FILTER (p_size % 4 < 2 AND p_brand = 'Brand#11') AS declared, count(*) FILTER (p_size % 4 = 0 AND p_brand = 'Brand#11') AS declared_wildfires, min(p_name) AS first, max(p_name) AS last FROM part")
def a39_listing_summary(t: Tables) -> DataFrame:
    p = t.read("part")
    m = F.col("p_size") % 4
    rows = p.select(F.col("p_partkey").alias("code"), F.when(m < 2, F.array("p_brand")).otherwise(F.array(F.lit("elsewhere"))).alias("countries"), (m == 2).alias("unknown_country"), (F.col("p_size") % 2 == 0).alias("wildfire"), F.col("p_name").alias("activated"))
    return evaluation.listing_summary(rows, p.count(), ["BRAND#11"])


@query(f"WITH {PX} SELECT chip_id, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM px WHERE (pos - 1) % 37 = 0 GROUP BY chip_id")
def a41_band_statistics(t: Tables) -> DataFrame:
    return rounded(evaluation.band_statistics(t.pixels(), "a", by=["chip_id"]), "mean", "std")


WATCHED = """ob AS (SELECT user_id % 6 AS sample_id, CAST(ts AS DATE) AS taken, event_id % 50 = 0 AS usable, event_id % 100 = 0 AS extra FROM events),
fr AS (SELECT k.sample_id, count(DISTINCT taken) AS usable_dates, date_diff('day', min(taken), max(taken)) * 1.0::DOUBLE AS span_days, bool_or(extra) AS ex FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS sample_id) k LEFT JOIN ob ON ob.sample_id = k.sample_id AND usable GROUP BY k.sample_id),
f2 AS (SELECT *, usable_dates >= 2 AND coalesce(span_days >= 14, false) AS assessable FROM fr)"""


def _watched(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.read("events")
    ob = e.select((F.col("user_id") % 6).alias("sample_id"), F.to_date("ts").cast("timestamp").alias("taken"), (F.col("event_id") % 50 == 0).alias("usable"), (F.col("event_id") % 100 == 0).alias("extra_separation"))
    return evaluation.visibility(ob, t.spark.createDataFrame([(k,) for k in range(6)], "sample_id long"))


@query(f"WITH {WATCHED} SELECT CAST(sample_id AS BIGINT) AS sample_id, usable_dates, span_days, assessable, assessable AND coalesce(ex, false) AS supported FROM f2")
def a44_visibility_frames(t: Tables) -> DataFrame:
    return _watched(t)[0]


@query(f"WITH {WATCHED}, n AS (SELECT count(*) FILTER (assessable) AS assessable_frames, count(*) FILTER (assessable AND coalesce(ex, false)) AS supported_frames FROM f2) SELECT *, CASE WHEN assessable_frames < 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN supported_frames >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM n")
def a44_visibility(t: Tables) -> DataFrame:
    return _watched(t)[1]


@query("SELECT event_type AS source, count(*) AS n, round(quantile_cont(user_id * 0.5::DOUBLE, 0.5), 6) AS median_h, round(quantile_cont(user_id * 0.5::DOUBLE, 0.9), 6) AS p90_h FROM events GROUP BY event_type")
def a45_lags(t: Tables) -> DataFrame:
    e = t.read("events").select("event_type", F.col("ts").cast("timestamp").alias("taken"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("user_id") * 1_800_000_000).alias("us"))
    return rounded(evaluation.lags(e.withColumn("published", F.timestamp_micros("us")), "event_type", "taken", "published").withColumnRenamed("event_type", "source"), "median_h", "p90_h")


@query(f"WITH {N} SELECT model, round(sum(fp) / sum(tp + fp + fn + 40 - tp - fn), 6) AS fp_share FROM n GROUP BY model")
def a32_false_positive_share(t: Tables) -> DataFrame:
    rows = t.counts().withColumn("valid_pixels", F.col("tp") + F.col("fp") + F.col("fn") + 40)
    return rounded(evaluation.false_positive_share(rows), "fp_share")


@query(f"""WITH {PX}, w AS (SELECT *, 0.5::DOUBLE + (u - 1) * 0.3::DOUBLE AS cosi FROM px), f AS (SELECT chip_id, regr_slope(a, cosi) AS k, regr_intercept(a, cosi) AS i FROM w WHERE valid GROUP BY chip_id)
SELECT w.chip_id, pos, round(CASE WHEN k IS NOT NULL AND k <> 0 THEN a * least(greatest((cos(radians(40)) + i / k) / (cosi + i / k), 0.5), 2.0) ELSE a END, 5) AS corrected FROM w JOIN f USING (chip_id)""")
def w26_terrain_corrected(t: Tables) -> DataFrame:
    px = t.pixels().withColumn("cosi", F.lit(0.5) + (F.col("u") - 1) * 0.3)
    return rounded(raster.terrain_corrected(px, "a", "cosi", 40.0, "corrected").select("chip_id", "pos", "corrected"), "corrected", digits=5)


@query(f"WITH {PX} SELECT chip_id, pos, round(cos(radians(35)) * cos(radians(u * 10)) + sin(radians(35)) * sin(radians(u * 10)) * cos(radians(150 - v * 90)), 6) AS cosi FROM px")
def w26_incidence(t: Tables) -> DataFrame:
    return rounded(t.pixels().select("chip_id", "pos", raster.incidence_cosine(F.col("u") * 10, F.col("v") * 90, 35.0, 150.0).alias("cosi")), "cosi")


# --- plans -------------------------------------------------------------------------------------------------------

FRAMES = "fb AS (SELECT o_orderkey AS id, o_custkey * 37 % 3000 * 100.0::DOUBLE AS w, o_orderkey * 61 % 3000 * 100.0::DOUBLE AS s, o_custkey * 37 % 3000 * 100.0::DOUBLE + 90 + o_orderkey % 9 * 10 AS e, o_orderkey * 61 % 3000 * 100.0::DOUBLE + 80 + o_custkey % 7 * 10 AS n FROM orders)"


def _frames(t: Tables) -> DataFrame:
    o = t.read("orders")
    x, y = F.col("o_custkey") * 37 % 3000 * 100.0, F.col("o_orderkey") * 61 % 3000 * 100.0
    return o.select(F.col("o_orderkey").alias("id"), x.alias("w"), y.alias("s"), (x + 90 + F.col("o_orderkey") % 9 * 10).alias("e"), (y + 80 + F.col("o_custkey") % 7 * 10).alias("n"), (F.col("o_orderkey") % 3).alias("bin"))


CHAINS = """pr AS (SELECT p.id AS u, q.id AS v FROM fb p JOIN fb q ON p.id <> q.id AND p.w - q.e <= 2000 AND q.w - p.e <= 2000 AND p.s - q.n <= 2000 AND q.s - p.n <= 2000
  AND pow(greatest(p.w - q.e, q.w - p.e, 0), 2) + pow(greatest(p.s - q.n, q.s - p.n, 0), 2) <= 4000000),
cl(id, root) USING KEY (id) AS (SELECT id, id FROM fb UNION (SELECT DISTINCT ON (now.id) now.id, seen.root FROM recurring.cl AS now, cl AS seen, pr WHERE pr.u = seen.id AND pr.v = now.id AND seen.root < now.root ORDER BY now.id, seen.root))"""


@query(f"WITH RECURSIVE {FRAMES}, {CHAINS} SELECT id, min(id) OVER (PARTITION BY root) AS first, count(*) OVER (PARTITION BY root) AS members FROM cl")
def g04_clusters(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("cluster")
    return planning.clusters(_frames(t), 2000.0).select("id", F.min("id").over(w).alias("first"), F.count("*").over(w).alias("members"))


PRIOR = "po AS (SELECT * FROM fb WHERE id % 29 = 0)"


@query(f"""WITH RECURSIVE {FRAMES}, {CHAINS}, {PRIOR}, bad AS (SELECT DISTINCT cl.root FROM fb JOIN cl USING (id) JOIN po ON fb.w < po.e + 500 AND po.w - 500 < fb.e AND fb.s < po.n + 500 AND po.s - 500 < fb.n) SELECT id FROM cl WHERE root NOT IN (SELECT root FROM bad)""")
def x17_purged(t: Tables) -> DataFrame:
    b = _frames(t)
    return planning.purged(planning.clusters(b, 2000.0), b.where("id % 29 = 0"), 500.0, 4000.0).select("id")


@query(f"WITH RECURSIVE {FRAMES}, {CHAINS}, {PRIOR}, bad AS (SELECT DISTINCT cl.root FROM fb JOIN cl USING (id) JOIN po ON fb.w < po.e + 500 AND po.w - 500 < fb.e AND fb.s < po.n + 500 AND po.s - 500 < fb.n), k AS (SELECT id, root FROM cl WHERE root NOT IN (SELECT root FROM bad)), g AS (SELECT root, least(count(*), 4) AS c FROM k GROUP BY root) SELECT CAST(least(sum(c), 40) AS BIGINT) AS chosen FROM g")
def x17_allocation(t: Tables) -> DataFrame:
    b = _frames(t)
    return planning.allocation(b, b.where("id % 29 = 0"), 2000.0, 500.0, 4000.0, "bin", 4, 40, "plan").agg(F.count("*").alias("chosen"))


ISOLATED = f"{B}, cd AS (SELECT * FROM b WHERE partition = 'train'), us AS (SELECT id // 40 AS event FROM cd WHERE id // 40 % 7 = 0), pf AS (SELECT * FROM b WHERE id % 97 = 0)"


@query(f"WITH {ISOLATED} SELECT id AS ordinal, CASE WHEN id // 40 IN (SELECT event FROM us) THEN 'used_event' ELSE 'prior_overlap' END AS reason FROM cd WHERE id // 40 IN (SELECT event FROM us) OR EXISTS (SELECT 1 FROM pf WHERE cd.w < pf.e AND pf.w < cd.e AND cd.s < pf.n AND pf.s < cd.n)")
def j12_isolate_prior(t: Tables) -> DataFrame:
    """What prior frames and used events alone decide; the order-dependent rest has a test of its own."""
    return _isolated(t).where("reason in ('used_event', 'prior_overlap')").select("ordinal", "reason")


def _isolated(t: Tables) -> DataFrame:
    b = t.boxes()
    event = F.floor(F.col("id") / 40).alias("event")
    cd = b.where("partition = 'train'").select(F.col("id").alias("ordinal"), event, "w", "s", "e", "n")
    return selection.isolate(cd, b.where("id % 97 = 0"), cd.where("event % 7 = 0").select("event"), 180, 2.0)


@query()
def j12_isolate(t: Tables) -> DataFrame:
    return _isolated(t)


COVERED = f"""{PX}, ps AS (SELECT tile AS sample, r AS y, c AS x FROM px WHERE severity > 1), bx AS (SELECT chip_id * 0 + t.i AS event, t.i % 8 * 8.0 AS w, t.i // 8 * 8.0 AS s, t.i % 8 * 8.0 + 8 + t.i % 3 AS e, t.i // 8 * 8.0 + 8 AS n FROM (SELECT DISTINCT 0 AS chip_id FROM px) z, range(64) t(i)),
sh AS (SELECT sample, event, count(*) / any_value(total) AS share FROM (SELECT ps.*, count(*) OVER (PARTITION BY sample) AS total FROM ps) ps JOIN bx ON x >= w AND x < e AND y >= s AND y < n GROUP BY sample, event)"""


def _shares(t: Tables) -> DataFrame:
    i = F.col("id")
    bx = t.spark.range(64).select(i.alias("event"), (i % 8 * 8.0).alias("w"), (F.floor(i / 8) * 8.0).alias("s"), (i % 8 * 8.0 + 8 + i % 3).alias("e"), (F.floor(i / 8) * 8.0 + 8).alias("n"))
    return planning.coverage_shares(t.pixels().where("severity > 1").select(F.col("tile").alias("sample"), F.col("col").alias("x"), F.col("row").alias("y")), bx, 8.0)


@query(f"WITH {COVERED} SELECT sample, event, round(share, 6) AS share FROM sh")
def j14_coverage_shares(t: Tables) -> DataFrame:
    return rounded(_shares(t), "share")


@query(f"WITH {COVERED}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY share DESC, event) AS k, lead(share) OVER (PARTITION BY sample ORDER BY share DESC, event) AS second FROM sh) SELECT sample, CASE WHEN share >= 0.95 AND coalesce(second, 0) <= 0.05 THEN event END AS event FROM k WHERE k = 1")
def j14_unique_event(t: Tables) -> DataFrame:
    return planning.unique_event(_shares(t), "sample", "event", "share")


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS event, CASE WHEN o_custkey % 5 = 0 THEN 'selection' ELSE 'development' END AS part FROM orders),
r AS (SELECT event, (row_number() OVER (ORDER BY sha256('cf:' || event), event) - 1) % 5 = 2 AS held FROM (SELECT DISTINCT event FROM c WHERE part = 'development')) SELECT id, CASE WHEN part = 'development' AND held THEN 'evaluation' ELSE 'fit' END AS partition FROM c LEFT JOIN r USING (event)""")
def w11_confirmation_folds(t: Tables) -> DataFrame:
    chips = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("event"), F.when(F.col("o_custkey") % 5 == 0, "selection").otherwise("development").alias("part"))
    return planning.confirmation_folds(chips, 2, 5, "cf").select("id", "partition")


@query("""WITH h AS (SELECT k, row_number() OVER (ORDER BY sha256('s1:' || k), k) AS rank FROM (SELECT DISTINCT o_custkey AS k FROM orders)), r AS (SELECT k FROM h WHERE (rank - 1) % 5 <> 1),
x AS (SELECT k, row_number() OVER (ORDER BY sha256('cal:1:' || k), k) AS rank, count(*) OVER () AS n FROM r) SELECT k, rank <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS calibration FROM x""")
def w10_calibration(t: Tables) -> DataFrame:
    ids = t.read("orders").select(F.col("o_custkey").alias("k")).distinct()
    return selection.calibration_part(selection.folds(ids, 5, "s1", "k"), 1, 0.2, "k", "cal").select("k", "calibration")


@query(f"WITH {N}, g AS (SELECT group_id, CAST(sum(fp) AS BIGINT) AS fp FROM n GROUP BY group_id) SELECT group_id FROM g QUALIFY row_number() OVER (ORDER BY fp DESC, group_id) <= ceil(count(*) OVER () * 0.25::DOUBLE)")
def w15_diagnostic(t: Tables) -> DataFrame:
    sums = t.counts().groupBy("group_id").agg(F.sum("fp").alias("fp"))
    return selection.hard_background(sums, "fp", "group_id").where("weight = 2").select("group_id")


@query(f"WITH {B} SELECT id, CAST(floor((w + 180) / 6) + 1 AS BIGINT) AS zone, floor((w * 1000 - 7680) / 30) * 30 AS west, ceil((s * 1000 + 7680) / 30) * 30 AS north FROM b")
def x16_frames(t: Tables) -> DataFrame:
    f = planning.snapped_frame(F.col("w") * 1000, F.col("s") * 1000)
    b = t.boxes().select("id", planning.utm_zone(F.col("w")).alias("zone"), f.alias("f"))
    return b.select("id", "zone", F.col("f.w").cast("double").alias("west"), F.col("f.n").cast("double").alias("north"))


@query("SELECT p_partkey AS k FROM part WHERE abs(p_size / 50.0::DOUBLE - p_partkey % 50 / 50.0::DOUBLE) <= 0.1::DOUBLE")
def x13_cloud_agrees(t: Tables) -> DataFrame:
    """Rules gated on metadata hold where the measured cloud agrees with it."""
    p = t.read("part").withColumns({"meta": F.col("p_size") / 50.0, "seen": F.col("p_partkey") % 50 / 50.0})
    return p.where(F.abs(F.col("meta") - F.col("seen")) <= 0.1).select(F.col("p_partkey").alias("k"))


BROKEN = {"pre_before_start": "o_orderkey % 4 = 0", "post_from_start": "o_orderkey % 6 = 0", "same_tile": "o_custkey % 5 = 0", "same_grid": "o_custkey % 4 = 1 OR o_orderkey % 11 = 0", "grid": "o_orderkey % 13 = 0",
          "affine": "o_orderkey % 11 = 0", "available": "o_orderkey % 7 = 0", "box": "o_custkey % 9 = 0"}


@query(f"SELECT o_orderkey AS k, list_filter({list(BROKEN)}, lambda x: {' OR '.join(f"(x = '{name}' AND ({rule}))" for name, rule in BROKEN.items())})::VARCHAR AS broken FROM orders")
def p26_violations(t: Tables) -> DataFrame:
    from cinderlake.operators import joins

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = lambda cond, a, b: F.when(cond, F.lit(a)).otherwise(F.lit(b)).cast("date")
    grid = lambda first, width: F.struct(F.lit("EPSG:32649").alias("crs"), F.array(first, *[F.lit(float(x)) for x in (0, 500000, 0, -20, 6800000)]).alias("transform"), width.alias("width"), F.lit(512).alias("height"))
    wide = F.when(k % 13 == 0, 0).otherwise(512)
    pairs = t.read("orders").select(
        k.alias("k"), F.lit("2024-05-01").cast("date").alias("start_at"), day(k % 4 == 0, "2024-05-02", "2024-04-01").alias("pre_at"), day(k % 6 == 0, "2024-04-30", "2024-05-01").alias("post_at"),
        F.lit("T1").alias("tile"), F.when(c % 5 == 0, "T2").otherwise("T1").alias("pre_tile"), F.lit("2024-06-01").cast("date").alias("pre_available_at"), day(k % 7 == 0, "2024-04-01", "2024-06-01").alias("post_available_at"),
        grid(F.when(k % 11 == 0, 0.0).otherwise(20.0), wide).alias("grid"), grid(F.when(c % 4 == 1, 10.0).otherwise(20.0), wide).alias("pre_grid"),
        F.lit(10.0).alias("w"), F.when(c % 9 == 0, 9.0).otherwise(11.0).alias("e"), F.lit(1.0).alias("s"), F.lit(2.0).alias("n"),
    )
    return joins.violations(pairs).select("k", F.concat(F.lit("["), F.array_join("violations", ", "), F.lit("]")).alias("broken"))


@query("SELECT c_custkey AS k, CAST(('0x' || substr(sha256('z:' || c_custkey), 1, 12))::BIGINT % 7 AS BIGINT) AS share, c_custkey IN (SELECT o_custkey FROM orders) AS ordered FROM customer")
def o03_common_ids(t: Tables) -> DataFrame:
    """O03: ids that two tables share; and a salted share of each."""
    c = t.read("customer").select(F.col("c_custkey").alias("k"))
    both = c.intersect(t.read("orders").select(F.col("o_custkey").alias("k"))).withColumn("ordered", F.lit(True))
    return c.join(both, "k", "left").select("k", planning.hash_share(F.col("k"), "z", 7).alias("share"), F.coalesce("ordered", F.lit(False)).alias("ordered"))


@query("SELECT p_partkey AS k, ('0x' || substr(sha256('f:' || p_partkey), 1, 15))::BIGINT >= 0 AS fine, sha256('f:' || p_partkey) AS h FROM part")
def w07_salted_hash(t: Tables) -> DataFrame:
    h = hashing.salted("f", F.col("p_partkey"))
    return t.read("part").select(F.col("p_partkey").alias("k"), (F.length(h) == 64).alias("fine"), h.alias("h"))


# --- polygons, projection and the gate -----------------------------------------------------------------------------

#: A box without its upper right quarter.
ELBOWS = "el AS (SELECT id, w, s, e, n, (w + e) / 2 AS mx, (s + n) / 2 AS my FROM b)"


def _elbows(boxes: DataFrame) -> DataFrame:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    w, s, e, n = (F.col(c).cast("double") for c in "wsen")
    mx, my = (w + e) / 2, (s + n) / 2
    return boxes.select("id", F.array(F.array(point(w, s), point(e, s), point(e, my), point(mx, my), point(mx, n), point(w, n))).alias("rings"))


@query(f"WITH {B}, {ELBOWS} SELECT id, round((e - w) * (n - s) * 0.75::DOUBLE, 6) AS area FROM el")
def j14_polygon_area(t: Tables) -> DataFrame:
    return rounded(_elbows(t.boxes()).select("id", polygons.area(F.col("rings")).alias("area")), "area")


@query(f"""WITH {B}, {ELBOWS}, sp AS (SELECT DISTINCT c_nationkey AS sample, (c_custkey * 7919 % 3000 + 0.37::DOUBLE) / 100 AS x, (c_custkey * 104729 % 3000 + 0.41::DOUBLE) / 100 AS y FROM customer),
h AS (SELECT DISTINCT sample, el.id // 1000 AS event, x, y FROM sp JOIN el ON x >= w AND x < e AND y >= s AND y < n AND NOT (x >= mx AND y >= my)), al AS (SELECT sample, count(*) AS total FROM sp GROUP BY sample)
SELECT sample, event, round(count(*) / any_value(total), 6) AS share FROM h JOIN al USING (sample) GROUP BY sample, event""")
def j14_polygon_shares(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    spots = t.read("customer").select(F.col("c_nationkey").alias("sample"), ((k * 7919 % 3000 + 0.37) / 100).alias("x"), ((k * 104729 % 3000 + 0.41) / 100).alias("y"))
    return rounded(polygons.covered_shares(spots, _elbows(t.boxes()).withColumn("event", F.floor(F.col("id") / 1000)).drop("id"), 2.0), "share")


@query()
def g04_polygon_clusters(t: Tables) -> DataFrame:
    """Chains of polygons within two kilometres of each other."""
    return polygons.polygon_clusters(_elbows(_frames(t)), 2000.0).select("id", "root")


def _series(head: str, terms: list[float], outer: str, inner: str, sign: str = "+") -> str:
    return head + "".join(f" {sign} ({c!r})::DOUBLE * {outer}({2 * j} * xi) * {inner}({2 * j} * eta)" for j, c in enumerate(terms, 1))


METRIC = f"""pl AS (SELECT id, w AS lon, s AS lat, CAST(floor((w + 180) / 6) + 1 AS BIGINT) AS zone FROM b),
p1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {projection._ECC!r}::DOUBLE * atanh({projection._ECC!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS d FROM pl),
p2 AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM p1),
me AS (SELECT id, lon, lat, zone, 500000 + {projection.RADIUS!r}::DOUBLE * ({_series("eta", projection.terms(projection.ALPHA), "cos", "sinh")}) AS x, {projection.RADIUS!r}::DOUBLE * ({_series("xi", projection.terms(projection.ALPHA), "sin", "cosh")}) AS y FROM p2)"""


@query(f"WITH {B}, {METRIC} SELECT id, zone, round(x, 3) AS x, round(y, 3) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM me")
def x16_projected(t: Tables) -> DataFrame:
    """Corners in metres of their zone, and back again in degrees."""
    b = t.boxes().select("id", F.col("w").alias("lon"), F.col("s").alias("lat"), planning.utm_zone(F.col("w")).alias("zone"))
    there = b.withColumn("m", projection.to_metres(F.col("lon"), F.col("lat"), F.col("zone")))
    back = there.withColumn("d", projection.to_degrees(F.col("m.x"), F.col("m.y"), F.col("zone")))
    return rounded(rounded(back.select("id", "zone", "m.x", "m.y", "d.lon", "d.lat"), "x", "y", digits=3), "lon", "lat", digits=9)


@query(f"WITH {B}, {METRIC} SELECT id, floor((x - 7680) / 30) * 30 AS west, ceil((y + 7680) / 30) * 30 AS north FROM me")
def x16_frames_in_metres(t: Tables) -> DataFrame:
    """Frames of 512 x 512 pixels of 30 m around corners, on their zone's grid."""
    b = t.boxes().select("id", F.col("w").alias("lon"), F.col("s").alias("lat"), planning.utm_zone(F.col("w")).alias("zone"))
    f = b.withColumn("m", projection.to_metres(F.col("lon"), F.col("lat"), F.col("zone"))).withColumn("f", planning.snapped_frame(F.col("m.x"), F.col("m.y")))
    return f.select("id", F.col("f.w").cast("double").alias("west"), F.col("f.n").cast("double").alias("north"))


H = "(-(least(greatest({0}, 1e-6), 1 - 1e-6) * ln(least(greatest({0}, 1e-6), 1 - 1e-6)) + (1 - least(greatest({0}, 1e-6), 1 - 1e-6)) * ln(1 - least(greatest({0}, 1e-6), 1 - 1e-6))))"


@query(f"""WITH {PX}, g AS (SELECT chip_id, valid, least(greatest(a - 0.5::DOUBLE, 0), 1) AS p, least(greatest(b - 0.5::DOUBLE, 0), 1) AS q, least(greatest(u - 0.5::DOUBLE, 0), 1) AS m FROM px),
k AS (SELECT *, abs(p - q) AS d, p > 0.5 OR q > 0.5 AS hit, {H.format("((p + q + m) / 3)")} - ({H.format("p")} + {H.format("q")} + {H.format("m")}) / 3 AS mi FROM g)
SELECT chip_id, round(coalesce(avg(d) FILTER (valid), 0), 6) AS mean_gap, round(coalesce(avg((d > 0.3::DOUBLE)::INT) FILTER (valid), 0), 6) AS high_share, round(coalesce(quantile_cont(d, 0.95) FILTER (valid), 0), 6) AS gap_95,
  round(count(*) FILTER (d > 0.3::DOUBLE AND hit) / greatest(count(*) FILTER (d > 0.3::DOUBLE), 1), 6) AS high_marked, round(coalesce(avg(mi) FILTER (valid), 0), 6) AS information, round(coalesce(avg(mi) FILTER (hit), 0), 6) AS information_marked FROM k GROUP BY chip_id""")
def x15_disagreement(t: Tables) -> DataFrame:
    share = lambda c: F.least(F.greatest(F.col(c) - 0.5, F.lit(0.0)), F.lit(1.0))
    px = t.pixels().withColumns({"p": share("a"), "q": share("b"), "m": share("u")}).withColumn("hit", (F.col("p") > 0.5) | (F.col("q") > 0.5))
    names = ("mean_gap", "high_share", "gap_95", "high_marked", "information", "information_marked")
    return rounded(gate.disagreement(px, "p", "q", ["p", "q", "m"], "hit"), *names)


@query()
def x15_novelty(t: Tables) -> DataFrame:
    """How far each tile's bands lie from those of all tiles, by their covariance."""
    v = staged(gate.summaries(t.pixels(), ["a", "b", "u", "v"], by="tile", least=20), "summaries")
    return rounded(gate.novelty(v, v), "novelty").select("tile", "novelty")


@query(f"WITH {PX}, tl AS (SELECT tile, count(*) FILTER (valid) >= 20 AS enough FROM px GROUP BY tile) SELECT tile, round(quantile_cont(a, 0.5), 6) AS median_a, round(quantile_cont(u, 0.9) - quantile_cont(u, 0.1), 6) AS span_u FROM px JOIN tl USING (tile) WHERE valid OR NOT enough GROUP BY tile")
def x15_summaries(t: Tables) -> DataFrame:
    v = gate.summaries(t.pixels(), ["a", "u"], by="tile", least=20)
    return rounded(v.select("tile", F.get("v", F.lit(0)).alias("median_a"), F.get("v", F.lit(3)).alias("span_u")), "median_a", "span_u")


# --- components ------------------------------------------------------------------------------------------------------


@query()
def x06_far_grid(t: Tables) -> DataFrame:
    """Scores of all choices of distances and probabilities beyond which components go."""
    px = t.pixels().withColumns({"cls": F.when(F.col("severity") > 2, F.col("severity") - 1).otherwise(0), "true_cls": F.least("truth", F.lit(3)), "p": _p("a")})
    found = morphology.far_grid(px, "cls", "true_cls", "p", [6.0, 12.0, 1e9], [2.0, 4.0, 8.0], [0.6, 0.7, 0.8])
    return rounded(found, "burn_iou", "severity_miou", "weighted")


@query()
def w23_object_rings(t: Tables) -> DataFrame:
    """Contrast and texture of each component in two bands, within five pixels."""
    found = morphology.object_rings(t.pixels().withColumn("m", F.col("severity") > 2), "m", ["a", "u"])
    return rounded(found, "a_contrast", "u_contrast", "a_texture", "u_texture")


# --- rasters in files ----------------------------------------------------------------------------------------------


def _rasters(t: Tables, **options: str) -> DataFrame:
    """The pixel table's chips written as files of two bands, and read again."""
    folder = f"{shared_folder(t.spark)}/chips-{uuid.uuid4().hex}"
    tiff.write(t.pixels(), ["a", "b"], folder, kind="<f8").agg(F.sum("bytes")).first()
    t.spark.dataSource.register(tiff.TiffSource)
    read = t.spark.read.format("tiff").options(**options).load(folder)
    return read.select(tiff.chip_of("path").cast("long").alias("chip_id"), "row", "col", F.round("b1", 6).alias("a"), F.round("b2", 6).alias("b")).where("a is not null")  # a chip may lack pixels


@query(f"WITH {PX} SELECT chip_id, r AS row, c AS col, round(a, 6) AS a, round(b, 6) AS b FROM px")
def s20_chip_files(t: Tables) -> DataFrame:
    return _rasters(t)


@query(f"WITH {PX} SELECT chip_id, r AS row, c AS col, round(a, 6) AS a, round(b, 6) AS b FROM px WHERE r BETWEEN 10 AND 41 AND c BETWEEN 20 AND 29")
def s23_raster_windows(t: Tables) -> DataFrame:
    """A window of each raster, from the strips that it touches."""
    return _rasters(t, window="10,20,32,10")
