"""Queries over the shared tables, one or more for each operator of the library's core, with the same in SQL.

Names begin with the inventory's numbers. Results that are sums of floating point numbers are rounded at the edge, as
the order of addition differs between engines; operators themselves don't round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions import confidence, dates, geo, hashing, indices, probability
from cinderlake.operators import evaluation, joins, points, raster, reports, rle, selection
from cinderlake.plans.derived import BOXES, COUNTS, DETECTIONS, PIXELS, SCENES, Tables, duck
from cinderlake.sources import detections as exports
from cinderlake.sources import store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NOW = "2024-02-05 00:00:00"
SEVERITY = "CAST((dnbr > 0.10::DOUBLE)::INT + (dnbr > 0.27::DOUBLE)::INT + (dnbr > 0.44::DOUBLE)::INT + (dnbr > 0.66::DOUBLE)::INT AS INT)"
GUESS = SEVERITY.replace("dnbr", "(dnbr * 1.25::DOUBLE - 0.05::DOUBLE)")
METRES = "sqrt(pow((p.longitude - q.longitude) * 111320.0::DOUBLE * cos(radians((p.latitude + q.latitude) / 2)), 2) + pow((p.latitude - q.latitude) * 111320.0::DOUBLE, 2))"
D = f"d AS ({duck(DETECTIONS)})"
TRUTH = SEVERITY.replace("dnbr", "tnbr")
PX = f"px AS (SELECT *, {SEVERITY} AS severity, {TRUTH} AS truth, {GUESS} AS pred FROM ({PIXELS}))"
N = f"n AS ({duck(COUNTS)})"
S = f"s AS ({duck(SCENES)})"
B = f"b AS ({duck(BOXES)})"
LEVEL = """CASE WHEN sensor LIKE 'MODIS%' THEN CASE WHEN CAST(confidence AS INT) < 30 THEN 0 WHEN CAST(confidence AS INT) >= 80 THEN 2 ELSE 1 END
  ELSE CASE lower(trim(confidence)) WHEN 'l' THEN 0 WHEN 'n' THEN 1 ELSE 2 END END"""


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- detections --------------------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT ordinal AS k, sensor, latitude, longitude, frp, epoch_us(date_trunc('minute', acquired_at)) - epoch_us(TIMESTAMP '2024-01-01') AS us, fire_type FROM d WHERE ordinal % 9 <> 0")
def s01_parse_export(t: Tables) -> DataFrame:
    """Detections written out as text columns, some without a position, and read again; the satellite column carries the number."""
    d = t.detections()
    latitude = F.when(F.col("ordinal") % 9 == 0, "?").otherwise(F.col("latitude").cast("string"))
    text = d.select(
        F.col("sensor").alias("_sensor"), latitude.alias("latitude"), F.col("longitude").cast("string").alias("longitude"), F.date_format("acquired_at", "yyyy-MM-dd").alias("acq_date"),
        F.date_format("acquired_at", "HHmm").alias("acq_time"), F.coalesce(F.col("frp").cast("string"), F.lit(" ")).alias("frp"), "confidence", F.col("fire_type").cast("string").alias("type"), F.col("ordinal").cast("string").alias("satellite"),
    )
    parsed = exports.parse(text, F.col("_sensor"))
    return parsed.select(F.col("satellite").cast("long").alias("k"), "sensor", "latitude", "longitude", "frp", _us("acquired_at").alias("us"), "fire_type")


def _us(name: str) -> Column:
    return F.unix_micros(F.col(name)) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))


@query(f"WITH {D} SELECT ordinal, {LEVEL} AS level FROM d")
def p02_confidence(t: Tables) -> DataFrame:
    return t.detections().select("ordinal", confidence.strict_level(F.col("sensor"), F.col("confidence")).alias("level"))


@query(f"WITH {D} SELECT sensor, CAST(sum(({LEVEL} >= 1)::INT) AS BIGINT) AS kept, CAST(sum(({LEVEL} < 1)::INT) AS BIGINT) AS rejected FROM d GROUP BY sensor")
def p03_partition(t: Tables) -> DataFrame:
    kept, rejected = confidence.partition(t.detections(), minimum=1)
    both = kept.select("sensor", F.lit(1).alias("k")).unionByName(rejected.select("sensor", F.lit(0).alias("k")))
    return both.groupBy("sensor").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("rejected"))


@query(f"WITH {D} SELECT ordinal, (length(version) > 0 AND NOT contains(upper(version), 'NRT')) AS archive FROM d")
def p05_archive_flag(t: Tables) -> DataFrame:
    return t.detections().select("ordinal", confidence.is_archive(F.col("version")).alias("archive"))


@query(f"WITH {D} SELECT ordinal FROM d WHERE longitude BETWEEN 87 AND 102 AND latitude BETWEEN 51 AND 57")
def p06_in_bbox(t: Tables) -> DataFrame:
    return t.detections().where(geo.in_bbox(F.col("latitude"), F.col("longitude"), (87.0, 51.0, 102.0, 57.0))).select("ordinal")


@query(f"""WITH {D}, m AS (SELECT ordinal, month(acquired_at) * 100 + day(acquired_at) AS md FROM d)
SELECT ordinal, (md >= 1220 OR md <= 108) OR md BETWEEN 115 AND 120 AS in_window FROM m""")
def p08_burn_windows(t: Tables) -> DataFrame:
    return t.detections().select("ordinal", dates.in_any_window(F.col("acquired_at"), [(1220, 108), (115, 120)]).alias("in_window"))


@query(f"""WITH {D} SELECT ordinal, CASE WHEN latitude <= 55 THEN 401 WHEN latitude <= 58 THEN 501 END AS season_start FROM d""")
def p09_season_band(t: Tables) -> DataFrame:
    band = dates.season_band(F.col("latitude"), [(58.0, 501, 930), (55.0, 401, 1031)])
    return t.detections().select("ordinal", band["start"].alias("season_start"))


@query(f"""WITH {D} SELECT ordinal, 'N' || lpad(CAST(CAST(floor(latitude / 3) * 3 AS INT) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(floor(longitude / 3) * 3 AS INT) AS VARCHAR), 3, '0') AS tile FROM d""")
def p13_tile_names(t: Tables) -> DataFrame:
    return t.detections().select("ordinal", geo.worldcover_tile(F.col("latitude"), F.col("longitude")).alias("tile"))


@query(f"""WITH {D}, k AS (SELECT *, row_number() OVER (PARTITION BY sensor, latitude, longitude, date_trunc('day', acquired_at) ORDER BY ordinal) AS n FROM d) SELECT ordinal FROM k WHERE n = 1""")
def s12_first_of_key(t: Tables) -> DataFrame:
    daily = t.detections().withColumn("day", F.date_trunc("day", "acquired_at"))
    return points.first_of_key(daily, ("sensor", "latitude", "longitude", "day")).select("ordinal")


@query(f"""WITH {D} SELECT sensor, latitude, longitude, max(ordinal) AS ordinal FROM d GROUP BY ALL""")
def o05_last_of_key(t: Tables) -> DataFrame:
    return points.last_of_key(t.detections(), ("sensor", "latitude", "longitude")).select("sensor", "latitude", "longitude", "ordinal")


@query(f"""WITH {D}, old AS (SELECT * FROM d WHERE ordinal % 3 = 0), k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.sensor = d.sensor AND o.latitude = d.latitude AND o.longitude = d.longitude AND o.acquired_at = d.acquired_at))
SELECT ordinal FROM k QUALIFY row_number() OVER (PARTITION BY sensor, latitude, longitude, acquired_at ORDER BY ordinal) = 1""")
def s12_append_unseen(t: Tables) -> DataFrame:
    d = t.detections()
    return store.unseen(d, d.where("ordinal % 3 = 0")).select("ordinal")


@query(f"""WITH {D}, src AS (SELECT unnest(['MODIS_NRT', 'VIIRS_SNPP_NRT', 'LANDSAT']) AS source)
SELECT source, CASE WHEN source = 'VIIRS_SNPP_NRT' THEN 'failed' ELSE 'ok' END AS status,
  CAST(CASE WHEN source = 'VIIRS_SNPP_NRT' THEN 0 ELSE (SELECT count(*) FROM d WHERE sensor = source) END AS INT) AS detection_count FROM src""")
def s14_journal(t: Tables) -> DataFrame:
    polls = t.spark.createDataFrame([("MODIS_NRT", None), ("VIIRS_SNPP_NRT", "timeout"), ("LANDSAT", None)], "source string, error string")
    return store.journal_rows(polls, t.detections()).select("source", "status", "detection_count")


@query(f"WITH {D} SELECT ordinal FROM d WHERE acquired_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00' AND sensor = 'MODIS_NRT'")
def s16_range_scan(t: Tables) -> DataFrame:
    return store.between(t.detections(), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-09 12:00:00").cast("timestamp"), "MODIS_NRT").select("ordinal")


EDGES = f"e AS (SELECT p.ordinal AS u, q.ordinal AS v FROM d p JOIN d q ON p.ordinal < q.ordinal AND abs(p.latitude - q.latitude) < 0.03 AND abs(epoch_us(p.acquired_at) - epoch_us(q.acquired_at)) <= 172800000000 AND {METRES} <= 3000)"
#: Labels by a recursion that keeps one row per key.
ROOTS = """both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
cc(id, root) USING KEY (id) AS (SELECT ordinal, ordinal FROM d UNION
  (SELECT DISTINCT ON (now.id) now.id, seen.root FROM recurring.cc AS now, cc AS seen, both_ways b WHERE b.u = seen.id AND b.v = now.id AND seen.root < now.root ORDER BY now.id, seen.root))"""


@query(f"WITH {D}, {EDGES} SELECT u, v FROM e")
def j01_near_pairs(t: Tables) -> DataFrame:
    return points.near_pairs(t.detections(), 3000.0, 48.0)


@query(f"WITH RECURSIVE {D}, {EDGES}, {ROOTS} SELECT id AS ordinal, root AS event_root FROM cc")
def g01_event_members(t: Tables) -> DataFrame:
    return points.event_members(t.detections()).select("ordinal", "event_root")


EVENTS = f"""{D}, {EDGES}, {ROOTS}, m AS (SELECT d.*, cc.root AS event_root FROM d JOIN cc ON cc.id = d.ordinal),
ev AS (SELECT event_root, count(*) AS n, min(acquired_at) AS first_seen, max(acquired_at) AS last_seen, min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north,
  avg(longitude) AS lon, avg(latitude) AS lat, coalesce(sum(frp), 0) AS total_frp, max(frp) AS max_frp, list_sort(list(DISTINCT sensor)) AS sensors, arg_min(m, (acquired_at, ordinal)) AS f FROM m GROUP BY event_root)"""


@query(f"""WITH RECURSIVE {EVENTS} SELECT 'FIRE-' || substr(sha256(printf('%.4f|%.4f|', f.latitude, f.longitude) || strftime(f.acquired_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(f.acquired_at) % 1000000 = 0 THEN '' ELSE strftime(f.acquired_at, '.%f') END || '+00:00'), 1, 12) AS event_id,
  n, west, south, east, north, round(lon, 6) AS lon, round(lat, 6) AS lat, round(total_frp, 6) AS total_frp, max_frp, array_to_string(sensors, ',') AS sensors, round((epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000, 6) AS duration_days FROM ev""")
def a01_events(t: Tables) -> DataFrame:
    ev = points.events(points.event_members(t.detections()))
    out = ev.select("event_id", "n", "west", "south", "east", "north", "lon", "lat", "total_frp", "max_frp", F.array_join("sensors", ",").alias("sensors"), "duration_days")
    return rounded(out, "lon", "lat", "total_frp", "duration_days")


def _covered(t: Tables) -> DataFrame:
    """Events with polls of every third day at noon, each of half a day, every other one failed."""
    ev = points.events(points.event_members(t.detections()))
    day = t.spark.range(0, 33, 3).select(F.date_add(F.lit("2024-01-03").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("window_start"), F.when(F.col("id") % 2 == 0, "ok").otherwise("failed").alias("status"))
    journal = day.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 12 HOURS"))
    return points.coverage(ev, journal, F.lit(NOW).cast("timestamp"))


JOURNAL = "jr AS (SELECT TIMESTAMP '2024-01-03' + to_days(CAST(i AS INT)) AS window_start, TIMESTAMP '2024-01-03 12:00:00' + to_days(CAST(i AS INT)) AS window_end, CASE WHEN i % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM range(0, 33, 3) x(i))"
COVERED = f"{EVENTS}, {JOURNAL}, cov AS (SELECT ev.*, (SELECT count(*) FROM jr WHERE status = 'ok' AND window_start <= TIMESTAMP '{NOW}' AND window_end >= last_seen) AS ok_polls, (SELECT count(*) FROM jr WHERE status = 'failed' AND window_start <= TIMESTAMP '{NOW}' AND window_end >= last_seen) AS failed_polls FROM ev)"
STATUS = f"CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen) < 604800000000 THEN 'active' WHEN ok_polls >= 1 THEN 'complete' ELSE 'unconfirmed' END"


@query(f"WITH RECURSIVE {COVERED} SELECT event_root, ok_polls, failed_polls, {STATUS} AS status FROM cov")
def a09_completion(t: Tables) -> DataFrame:
    return points.completion(_covered(t), F.lit(NOW).cast("timestamp")).select("event_root", "ok_polls", "failed_polls", "status")


@query(f"WITH RECURSIVE {COVERED} SELECT {STATUS} AS status, count(*) AS n FROM cov GROUP BY 1")
def a10_status_counts(t: Tables) -> DataFrame:
    return points.completion(_covered(t), F.lit(NOW).cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {EVENTS} SELECT event_root, round(total_frp, 6) AS total_frp FROM ev ORDER BY ev.total_frp DESC, event_root LIMIT 10")
def w02_top_events(t: Tables) -> DataFrame:
    ev = points.events(points.event_members(t.detections()))
    return rounded(ev.orderBy(F.desc("total_frp"), "event_root").limit(10).select("event_root", "total_frp"), "total_frp")


@query(f"""WITH RECURSIVE {EVENTS}, x AS (SELECT event_root, epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen) >= 864000000000 AND
  greatest((east - west) * 111320.0::DOUBLE * cos(radians((south + north) / 2)), (north - south) * 111320.0::DOUBLE) / 1000 <= 5 AS ok FROM ev)
SELECT event_root FROM x WHERE ok OR NOT (SELECT bool_or(ok) FROM x)""")
def p24_mappable(t: Tables) -> DataFrame:
    ev = points.events(points.event_members(t.detections()))
    return points.mappable(ev, F.lit(NOW).cast("timestamp"), quiet_days=10, most_km=5.0).select("event_root")


def _sites(t: Tables) -> DataFrame:
    """Detections of one place as one cluster."""
    from pyspark.sql import Window

    return t.detections().withColumn("cluster", F.min("ordinal").over(Window.partitionBy("latitude", "longitude")))


SITES = f"{D}, st AS (SELECT min(ordinal) AS cluster, latitude AS lat, longitude AS lon, count(*) AS n, count(DISTINCT CAST(acquired_at AS DATE)) AS nd, CASE WHEN count(frp) >= 2 AND avg(frp) <> 0 THEN stddev_samp(frp) / avg(frp) END AS cv FROM d GROUP BY latitude, longitude)"


@query(f"WITH {SITES} SELECT cluster, n, nd, round(cv, 6) AS cv FROM st")
def a05_cluster_stats(t: Tables) -> DataFrame:
    return rounded(points.cluster_stats(_sites(t)).select("cluster", "n", F.col("days").alias("nd"), "cv"), "cv")


@query(f"WITH {D} SELECT round((epoch_us(max(acquired_at)) - epoch_us(min(acquired_at))) / 86400000000, 6) AS depth_days, (epoch_us(max(acquired_at)) - epoch_us(min(acquired_at))) / 86400000000 >= 14 AS sufficient FROM d")
def a06_history_depth(t: Tables) -> DataFrame:
    return rounded(points.history_depth(t.detections(), 14), "depth_days")


@query(f"WITH {SITES} SELECT cluster FROM st WHERE nd >= 10 AND (cv IS NULL OR cv <= 0.6)")
def a07_persistent_rule(t: Tables) -> DataFrame:
    return points.cluster_stats(_sites(t)).where(points.is_persistent(points.PersistenceRules())).select("cluster")


@query()
def g02_source_clusters(t: Tables) -> DataFrame:
    return points.source_clusters(t.detections(), 500.0).select("ordinal", "cluster")


@query()
def a07_persistent_sources(t: Tables) -> DataFrame:
    return rounded(points.persistent_sources(t.detections()), "lat", "lon", "cv")


@query(f"WITH {SITES}, q AS (SELECT lat AS latitude, lon AS longitude FROM st WHERE nd >= 10 AND (cv IS NULL OR cv <= 0.6)) SELECT p.ordinal, NOT EXISTS (SELECT 1 FROM q WHERE abs(q.latitude - p.latitude) < 0.03 AND {METRES} <= 1500) AS kept FROM d p")
def j02_split_by_sources(t: Tables) -> DataFrame:
    sources = points.cluster_stats(_sites(t)).where(points.is_persistent(points.PersistenceRules()))
    kept, near = points.split_by_sources(t.detections(), sources, 1500.0)
    return kept.select("ordinal", F.lit(True).alias("kept")).unionByName(near.select("ordinal", F.lit(False).alias("kept")))


@query(f"""WITH {D}, x AS (SELECT 'year' AS kind, CAST(year(acquired_at) AS VARCHAR) AS name FROM d UNION ALL SELECT 'sensor', sensor FROM d UNION ALL SELECT 'fire_type', CAST(fire_type AS VARCHAR) FROM d
UNION ALL SELECT 'origin', CASE WHEN contains(upper(version), 'NRT') THEN 'nrt' ELSE 'archive' END FROM d) SELECT kind, name, count(*) AS n FROM x WHERE name IS NOT NULL GROUP BY ALL""")
def a17_archive_summary(t: Tables) -> DataFrame:
    return reports.archive_summary(t.detections())


@query(f"WITH {D}, src AS (SELECT unnest(['MODIS_NRT', 'VIIRS_SNPP_NRT', 'LANDSAT']) AS source) SELECT source, CASE WHEN source = 'MODIS_NRT' THEN 1 ELSE 0 END AS failures, (SELECT count(*) FROM d WHERE sensor = source) AS detections FROM src")
def a16_health(t: Tables) -> DataFrame:
    sources = t.spark.createDataFrame([("MODIS_NRT",), ("VIIRS_SNPP_NRT",), ("LANDSAT",)], "source string")
    polls = t.spark.createDataFrame([("MODIS_NRT", "failed", "2024-01-03"), ("MODIS_NRT", "ok", "2024-01-02")], "source string, status string, at string").withColumn("requested_at", F.col("at").cast("timestamp"))
    return reports.health(sources, polls, t.detections()).select("source", F.col("failures").cast("int").alias("failures"), "detections")


# --- pixels ------------------------------------------------------------------------------------------------------


@query(f"""WITH {PX} SELECT chip_id, pos, CASE WHEN a + b <> 0 THEN (a - b) / (a + b) END AS nbr, dnbr / ((a - b) / (a + b) + 1.001::DOUBLE) AS rbr, b * 10 - a * 9.8::DOUBLE + 2 AS mirbi FROM px""")
def f03_indices(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return t.pixels().select("chip_id", "pos", indices.nbr(a, b).alias("nbr"), indices.rbr(F.col("dnbr"), indices.nbr(a, b)).alias("rbr"), indices.mirbi(a, b).alias("mirbi"))


@query(f"WITH {PX} SELECT severity, count(*) AS n FROM px GROUP BY severity")
def p19_severity(t: Tables) -> DataFrame:
    return t.pixels().groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {PX} SELECT chip_id, pos, CASE WHEN valid THEN CAST((dnbr >= 0.10::DOUBLE)::INT + (dnbr >= 0.27::DOUBLE)::INT + (dnbr >= 0.66::DOUBLE)::INT AS INT) ELSE 0 END AS cls FROM px")
def p20_severity_chip(t: Tables) -> DataFrame:
    return t.pixels().select("chip_id", "pos", indices.severity_chip(F.col("dnbr"), F.col("valid")).alias("cls"))


AREA = " , ".join(f"count(*) FILTER (valid AND severity = {k}) * 0.04::DOUBLE AS {n}" for k, n in enumerate(indices.SEVERITY_NAMES))


@query(f"WITH {PX}, ar AS (SELECT chip_id, {AREA}, count(*) FILTER (valid) AS valid_pixels FROM px GROUP BY chip_id) SELECT *, round(low + moderate_low + moderate_high + high, 6) AS burned_ha, 1 - valid_pixels / 5000.0::DOUBLE AS masked FROM ar")
def a11_area_by_class(t: Tables) -> DataFrame:
    rows = raster.area_by_class(t.pixels(), geo.pixel_ha(20.0, -20.0)).drop("seen_pixels")
    return rows.withColumn("burned_ha", F.round(raster.burned_ha(), 6)).withColumn("masked", raster.masked_fraction(F.col("valid_pixels"), F.lit(5000)))


@query(f"""WITH {PX}, pt AS (SELECT * FROM px WHERE pos % 5 = 0), v AS (SELECT chip_id, count(*) AS nv, count(*) FILTER (severity > 0) AS nb, count(*) FILTER (pos % 5 = 0) AS ni, count(*) FILTER (severity > 0 AND pos % 5 = 0) AS nh FROM px WHERE valid GROUP BY chip_id)
SELECT chip_id, CASE WHEN ni > 0 AND nb > 0 THEN round((nh / ni) / (nb / nv), 6) END AS enrichment FROM v""")
def a14_enrichment(t: Tables) -> DataFrame:
    px = t.pixels()
    return rounded(raster.enrichment(px, px.where("pos % 5 = 0").select("chip_id", "row", "col")).select("chip_id", "enrichment"), "enrichment")


COMPARED = f"{PX}, own AS (SELECT tile, count(*) FILTER (severity > 0) * 100.0::DOUBLE AS own_ha, CASE WHEN tile % 9 <> 0 THEN count(*) FILTER (truth > 1) * 150.0::DOUBLE END AS product_ha FROM px GROUP BY tile), cmp AS (SELECT *, CASE WHEN product_ha IS NULL THEN 'no_data' WHEN own_ha < 1000 THEN 'not_comparable' ELSE 'ok' END AS status FROM own), rt AS (SELECT *, CASE WHEN status = 'ok' AND product_ha <> 0 THEN own_ha / product_ha END AS ratio FROM cmp)"


def _compared(t: Tables) -> DataFrame:
    own = t.pixels().groupBy("tile").agg((F.count_if(F.col("severity") > 0) * 100.0).alias("own_ha"), (F.count_if(F.col("truth") > 1) * 150.0).alias("p"))
    own = own.withColumn("product_ha", F.when(F.col("tile") % 9 != 0, F.col("p")))
    return own.select("tile", raster.compare_area(F.col("own_ha"), F.col("product_ha")).alias("x")).select("tile", "x.*")


@query(f"WITH {COMPARED} SELECT tile, status, round(ratio, 6) AS ratio FROM rt")
def a19_compare_area(t: Tables) -> DataFrame:
    return rounded(_compared(t), "ratio")


@query(f"WITH {COMPARED}, o AS (SELECT ratio FROM rt WHERE ratio IS NOT NULL AND ratio <> 0) SELECT * FROM (SELECT count(*) AS n, round(min(ratio), 6) AS smallest, round(list_sort(list(ratio))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS median, round(max(ratio), 6) AS largest, round(avg(ratio), 6) AS mean, count(*) FILTER (ratio > 1) AS above, count(*) FILTER (ratio < 1) AS below FROM o) WHERE n > 0")
def a20_ratio_summary(t: Tables) -> DataFrame:
    return rounded(raster.ratio_summary(_compared(t)), "smallest", "median", "largest", "mean")


def focal(k: int, value: str = "a", source: str = "px") -> str:
    """Means of a value and of its square over k x k pixels, columns mu and sq: rows first, then columns, with edges repeated."""
    h = k // 2
    return f"""ext AS (SELECT *, {value} AS val, max(c) OVER (PARTITION BY chip_id, r) AS mc, max(r) OVER (PARTITION BY chip_id, c) AS mr FROM {source}),
rp AS (SELECT p.chip_id, p.r, p.c, p.pos, p.mr, any_value(p.val) AS val, avg(q.val) AS ra, avg(q.val * q.val) AS rq FROM ext p, range({-h}, {h + 1}) x(dx), ext q
  WHERE q.chip_id = p.chip_id AND q.r = p.r AND q.c = least(greatest(p.c + dx, 0), p.mc) GROUP BY p.chip_id, p.r, p.c, p.pos, p.mr),
fm AS (SELECT p.chip_id, p.pos, any_value(p.val) AS val, avg(q.ra) AS mu, avg(q.rq) AS sq FROM rp p, range({-h}, {h + 1}) y(dy), rp q
  WHERE q.chip_id = p.chip_id AND q.c = p.c AND q.r = least(greatest(p.r + dy, 0), p.mr) GROUP BY p.chip_id, p.pos)"""


@query(f"WITH {PX}, {focal(15)} SELECT chip_id, pos, round(mu, 6) AS mean FROM fm")
def w03_focal_mean(t: Tables) -> DataFrame:
    return rounded(raster.focal_mean(t.pixels(), "a", 15, "mean").select("chip_id", "pos", "mean"), "mean")


@query(f"WITH {PX}, {focal(5)} SELECT chip_id, pos, round((val - mu) / (sqrt(greatest(sq - mu * mu, 0)) + 1e-3), 5) AS z FROM fm")
def w04_local_z(t: Tables) -> DataFrame:
    return rounded(raster.local_z(t.pixels(), "a", 5, "z").select("chip_id", "pos", "z"), "z", digits=5)


@query(f"WITH {PX} SELECT chip_id, round(coalesce(quantile_cont(dnbr, 0.5) FILTER (valid), 0), 6) AS med FROM px GROUP BY chip_id")
def w05_scene_median(t: Tables) -> DataFrame:
    return rounded(raster.scene_median(t.pixels(), "dnbr", "med").select("chip_id", "med").distinct(), "med")


@query(f"WITH {PX}, f AS (SELECT chip_id, count(*) AS n, regr_slope(a, b) AS k, regr_intercept(a, b) AS i FROM px WHERE abs(dnbr) < 0.3::DOUBLE GROUP BY chip_id) SELECT px.chip_id, pos, round(CASE WHEN n >= 12 AND k IS NOT NULL THEN least(greatest(b * k + i, 0), 65535) ELSE b END, 6) AS fitted FROM px LEFT JOIN f USING (chip_id)")
def w06_normalise_post(t: Tables) -> DataFrame:
    px = t.pixels()
    return rounded(raster.normalise_post(px, "a", "b", F.abs("dnbr") < 0.3, least=12).select("chip_id", "pos", F.col("post_fitted").alias("fitted")), "fitted")


@query(f"WITH {PX} SELECT p.chip_id, p.pos, max(q.a) AS top FROM px p JOIN px q ON q.chip_id = p.chip_id AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 GROUP BY ALL")
def x14_neighbour_max(t: Tables) -> DataFrame:
    return raster.neighbour_max(t.pixels(), "a", "top").select("chip_id", "pos", "top")


@query(f"""WITH {PX}, g AS (SELECT chip_id, pos, a, lag(a) OVER x AS l, lead(a) OVER x AS r1, lag(a) OVER y AS u, lead(a) OVER y AS d1 FROM px WINDOW x AS (PARTITION BY chip_id, r ORDER BY c), y AS (PARTITION BY chip_id, c ORDER BY r))
SELECT chip_id, pos, round(degrees(atan(sqrt(pow(coalesce((r1 - l) / 2, r1 - a, a - l, 0), 2) + pow(coalesce((d1 - u) / 2, d1 - a, a - u, 0), 2)))), 6) AS slope FROM g""")
def w26_slope(t: Tables) -> DataFrame:
    return rounded(raster.slope(t.pixels(), "a", 1.0).select("chip_id", "pos", "slope"), "slope")


def marked(mask: str, eight: bool = False) -> str:
    """Components of a mask: cm (id, root, chip_id, r, c, component, px_n), by a recursion that keeps one row per pixel."""
    steps = ["q.id = p.id + 1 AND p.c < 63", "q.id = p.id + 64"] + (["q.id = p.id + 65 AND p.c < 63", "q.id = p.id + 63 AND p.c > 0"] if eight else [])
    sides = " UNION ALL ".join(f"SELECT p.id AS u, q.id AS v FROM mk p JOIN mk q ON {x}" for x in steps)
    return f"""mk AS (SELECT chip_id * 10000 + pos AS id, chip_id, r, c FROM px WHERE {mask}), one_way AS ({sides}), sides AS (SELECT u, v FROM one_way UNION ALL SELECT v, u FROM one_way),
cc(id, root) USING KEY (id) AS (SELECT id, id FROM mk UNION (SELECT DISTINCT ON (now.id) now.id, seen.root FROM recurring.cc AS now, cc AS seen, sides s
  WHERE s.u = seen.id AND s.v = now.id AND seen.root < now.root ORDER BY now.id, seen.root)),
cm AS (SELECT mk.*, root, dense_rank() OVER (PARTITION BY chip_id ORDER BY root) AS component, count(*) OVER (PARTITION BY root) AS px_n FROM cc JOIN mk USING (id))"""


ON = "LEFT JOIN cm ON cm.id = px.chip_id * 10000 + pos"


@query(f"WITH RECURSIVE {PX}, {marked('severity > 0')} SELECT px.chip_id, pos, CAST(coalesce(component, 0) AS INT) AS component, coalesce(px_n, 0) AS component_px FROM px {ON}")
def w18_components(t: Tables) -> DataFrame:
    return raster.mask_components(t.pixels().withColumn("m", F.col("severity") > 0), "m").select("chip_id", "pos", "component", "component_px")


@query(f"WITH RECURSIVE {PX}, {marked('severity > 0')} SELECT px.chip_id, pos, CAST(CASE WHEN px_n >= 4 THEN severity ELSE 0 END AS INT) AS severity FROM px {ON}")
def w19_drop_small(t: Tables) -> DataFrame:
    return raster.drop_small(t.pixels(), "severity", 4).select("chip_id", "pos", "severity")


MAIN = "main AS (SELECT chip_id, arg_min(root, (-px_n, root)) AS root FROM cm GROUP BY chip_id)"


@query(f"""WITH RECURSIVE {PX}, {marked('severity > 1')}, {MAIN}, near AS (SELECT DISTINCT p.root FROM cm p JOIN main USING (chip_id) JOIN cm q ON q.chip_id = p.chip_id AND q.root = main.root
  AND (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c) <= 9) SELECT px.chip_id, pos, severity > 1 AND cm.root IN (SELECT root FROM near) AS m FROM px {ON}""")
def w20_drop_far(t: Tables) -> DataFrame:
    return raster.drop_far(t.pixels().withColumn("m", F.col("severity") > 1), "m", 3.0).select("chip_id", "pos", "m")


@query(f"""WITH RECURSIVE {PX}, {marked('severity > 0', eight=True)}, hit AS (SELECT cm.root, bool_or(pred > 2) AS hit FROM px JOIN cm ON cm.id = px.chip_id * 10000 + pos GROUP BY cm.root)
SELECT px.chip_id, pos, pred > 2 OR coalesce(px_n <= 6 AND NOT hit, false) AS m FROM px {ON} LEFT JOIN hit ON hit.root = cm.root""")
def w21_rescue(t: Tables) -> DataFrame:
    px = t.pixels().withColumns({"base": F.col("severity") > 0, "guess": F.col("pred") > 2})
    return raster.rescue(px, "base", "guess", "m", 6).select("chip_id", "pos", "m")


@query(f"""WITH RECURSIVE {PX}, {marked('severity > 1')}, x AS (SELECT chip_id, component, root, count(*) AS px, (max(r) - min(r) + 1) * (max(c) - min(c) + 1) AS box FROM cm GROUP BY ALL),
e AS (SELECT cm.root, count(*) AS n FROM one_way JOIN cm ON cm.id = one_way.u GROUP BY cm.root), y AS (SELECT x.*, 4 * px - 2 * coalesce(n, 0) AS perimeter FROM x LEFT JOIN e USING (root))
SELECT chip_id, CAST(component AS INT) AS component, px, perimeter, round(ln(px), 6) AS log_area, round(4 * pi() * px / (perimeter * perimeter), 6) AS compactness, round(px / box, 6) AS fill FROM y""")
def w23_component_features(t: Tables) -> DataFrame:
    return rounded(raster.component_features(t.pixels().withColumn("m", F.col("severity") > 1), "m"), "log_area", "compactness", "fill")


@query(f"""WITH RECURSIVE {PX}, {marked('severity > 1')}, core AS (SELECT cm.root, bool_or(severity > 3) AS core FROM px JOIN cm ON cm.id = px.chip_id * 10000 + pos GROUP BY cm.root)
SELECT px.chip_id, pos, coalesce(core, false) AS m FROM px {ON} LEFT JOIN core ON core.root = cm.root""")
def w24_region_grow(t: Tables) -> DataFrame:
    return raster.grow(t.pixels().withColumns({"core": F.col("severity") > 3, "near": F.col("severity") > 1}), "core", "near", "m").select("chip_id", "pos", "m")


RUNS = """runs AS (SELECT chip_id, min(pos) AS s, count(*) AS n FROM (SELECT chip_id, pos, pos - row_number() OVER (PARTITION BY chip_id ORDER BY pos) AS g FROM px WHERE severity > 0) GROUP BY chip_id, g)"""


@query(f"WITH {PX}, {RUNS} SELECT k.chip_id, coalesce((SELECT string_agg(s || ' ' || n, ' ' ORDER BY s) FROM runs WHERE runs.chip_id = k.chip_id), '') AS rle FROM (SELECT DISTINCT chip_id FROM px) k")
def g06_rle_encode(t: Tables) -> DataFrame:
    return rle.encode(t.pixels(), ["chip_id"], "severity > 0")


@query(f"WITH {PX} SELECT chip_id, pos FROM px WHERE severity > 0")
def g06_rle_decode(t: Tables) -> DataFrame:
    return rle.decode(rle.encode(t.pixels(), ["chip_id"], "severity > 0"), ["chip_id"])


@query(f"""WITH k AS (SELECT p_partkey AS chip_id FROM part) SELECT chip_id, class_id, 'missing' AS fault FROM k, range(1, 3) c(class_id) WHERE chip_id % 10 = 0 UNION ALL SELECT chip_id, 1, 'overlap' FROM k WHERE chip_id % 10 = 1
UNION ALL SELECT chip_id, 2, 'overlap' FROM k WHERE chip_id % 10 = 1 AND false UNION ALL SELECT chip_id, 2, 'bad_runs' FROM k WHERE chip_id % 10 = 2 UNION ALL SELECT chip_id, 2, 'out_of_chip' FROM k WHERE chip_id % 10 = 3 UNION ALL SELECT chip_id, 3, 'extra' FROM k WHERE chip_id % 10 = 4""")
def g07_faults(t: Tables) -> DataFrame:
    chips = t.read("part").select(F.col("p_partkey").alias("chip_id"))
    both = chips.withColumn("class_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    m = F.col("chip_id") % 10
    text = F.when((m == 1) & (F.col("class_id") == 2), "1 9").when((m == 2) & (F.col("class_id") == 2), "3").when((m == 3) & (F.col("class_id") == 2), "60 9").when(F.col("class_id") == 1, "5 3").otherwise("20 2")
    sent = both.where(m != 0).unionByName(chips.where(m == 4).withColumn("class_id", F.lit(3).cast("long"))).withColumn("rle", F.when((m == 4) & (F.col("class_id") == 3), "").otherwise(text))
    return rle.faults(sent, both, 64)


# --- evaluation --------------------------------------------------------------------------------------------------


@query(f"""WITH {PX}, s AS (SELECT label, count(*) FILTER (truth > 0 AND pred > 0) AS tp, count(*) FILTER (truth = 0 AND pred > 0) AS fp, count(*) FILTER (truth > 0 AND pred = 0) AS fn FROM px GROUP BY label)
SELECT label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s""")
def a21_pooled_f1(t: Tables) -> DataFrame:
    return evaluation.pooled_f1(t.pixels().withColumns({"truth": F.col("truth") > 0, "pred": F.col("pred") > 0}), ["label"])


@query(f"WITH {PX}, k AS (SELECT DISTINCT label FROM px) SELECT k.label, CAST(x.i AS INT) AS truth, CAST(y.j AS INT) AS pred, (SELECT count(*) FROM px WHERE px.label = k.label AND truth = x.i AND pred = y.j AND valid) AS n FROM k, range(5) x(i), range(5) y(j)")
def a24_confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(t.pixels(), ["label"], 5)


SCORE = f"""{PX}, v AS (SELECT * FROM px WHERE valid), k AS (SELECT label, count(*) FILTER (truth > 0 AND pred > 0) / nullif(count(*) FILTER (truth > 0 OR pred > 0), 0) AS burn_iou FROM v GROUP BY label),
c AS (SELECT label, i, count(*) FILTER (truth = i AND pred = i) / nullif(count(*) FILTER (truth = i OR pred = i), 0) AS iou FROM v, range(1, 5) x(i) GROUP BY label, i), m AS (SELECT label, avg(iou) AS miou FROM c GROUP BY label)"""


@query(f"WITH {SCORE} SELECT label, round(burn_iou, 6) AS burn_iou, round(miou, 6) AS severity_miou, round((burn_iou * 0.35::DOUBLE + miou * 0.30::DOUBLE) / 0.65::DOUBLE, 6) AS weighted FROM k JOIN m USING (label)")
def a23_burn_score(t: Tables) -> DataFrame:
    return rounded(evaluation.burn_score(evaluation.confusion(t.pixels(), ["label"], 5), ["label"]), "burn_iou", "severity_miou", "weighted")


@query(f"WITH {N} SELECT group_id, model, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM n GROUP BY ALL")
def a27_group_sums(t: Tables) -> DataFrame:
    return evaluation.group_sums(t.counts(), "group_id")


def drawn(kind: str, groups: str, draws: int = 2000) -> str:
    """Rows (draw, place): as many places with replacement as `groups` has rows, by the remainder of a hash."""
    return f"""cn AS (SELECT count(*) AS cn FROM {groups}),
dr AS (SELECT draw, ('0x' || substr(md5('{kind}:' || draw || ':' || pick), 1, 12))::BIGINT % (SELECT cn FROM cn) + 1 AS place FROM range(1, {draws + 1}) x(draw), (SELECT unnest(range(1, cn + 1)) AS pick FROM cn))"""


INTERVAL = "quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high"
VERDICT = "CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'inconclusive' END AS verdict"


@query(f"""WITH {N}, o AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS place, {", ".join(f"coalesce(sum({c}) FILTER (model = '{m}'), 0) AS {c}_{m}" for m in ("first", "second") for c in ("tp", "fp", "fn"))} FROM n GROUP BY group_id),
{drawn("pairs", "o")}, s AS (SELECT {", ".join(f"sum({c}_{m}) AS {c}_{m}" for m in ("first", "second") for c in ("tp", "fp", "fn"))}, draw FROM dr JOIN o USING (place) GROUP BY draw),
d AS (SELECT coalesce(tp_second / nullif(tp_second + fp_second + fn_second, 0), 0) - coalesce(tp_first / nullif(tp_first + fp_first + fn_first, 0), 0) AS d FROM s), i AS (SELECT {INTERVAL} FROM d),
w AS (SELECT count(*) AS groups, sum(tp_second) / sum(tp_second + fp_second + fn_second) - sum(tp_first) / sum(tp_first + fp_first + fn_first) AS delta FROM o)
SELECT groups, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, {VERDICT} FROM w, i""")
def a28_paired_bootstrap(t: Tables) -> DataFrame:
    return rounded(evaluation.paired_bootstrap(t.counts(), "first", "second", draws=2000), "delta", "low", "high")


@query(f"""WITH {N}, s AS (SELECT model, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (tp = 0 AND fn > 0) AS missed_samples FROM n GROUP BY model),
g AS (SELECT model, count(*) FILTER (tp = 0 AND fn > 0) AS missed_groups FROM (SELECT model, group_id, sum(tp) AS tp, sum(fn) AS fn FROM n GROUP BY ALL) GROUP BY model),
q AS (SELECT bool_and(same) AS shared_truth FROM (SELECT min(tp + fn) = max(tp + fn) AS same FROM n GROUP BY sample_id))
SELECT s.model, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, missed_samples, missed_groups, shared_truth, round(tp / (tp + fp + fn), 6) AS iou FROM s JOIN g USING (model), q""")
def a32_error_report(t: Tables) -> DataFrame:
    return rounded(evaluation.error_report(t.counts()), "iou")


@query(f"""WITH {N}, o AS (SELECT model, group_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM n GROUP BY ALL), a AS (SELECT *, sum(tp) OVER w AS atp, sum(tp + fp + fn) OVER w AS al FROM o WINDOW w AS (PARTITION BY model))
SELECT model, group_id, round(atp / al, 6) AS iou, round((atp - tp) / nullif(al - tp - fp - fn, 0), 6) AS iou_without, round(atp / al - (atp - tp) / nullif(al - tp - fp - fn, 0), 6) AS influence FROM a""")
def a33_group_influence(t: Tables) -> DataFrame:
    return rounded(evaluation.group_influence(t.counts()), "iou", "iou_without", "influence")


@query(f"WITH {PX} SELECT label, round(quantile_cont(a, 0.1), 6) AS q10, round(quantile_cont(a, 0.5), 6) AS median, round(quantile_cont(a, 0.9), 6) AS q90, 0 AS undefined FROM px GROUP BY label")
def a34_spectral_summary(t: Tables) -> DataFrame:
    return rounded(evaluation.spectral_summary(t.pixels(), ["label"], "a"), "q10", "median", "q90")


@query(f"WITH {PX}, c AS (SELECT label AS raw, truth, pred, count(*) AS n FROM px GROUP BY ALL), e AS (SELECT *, CAST(sum(CASE WHEN truth <> pred THEN n ELSE 0 END) OVER (PARTITION BY raw) AS BIGINT) AS raw_errors FROM c) SELECT *, round(raw_errors / (SELECT sum(n) FROM c WHERE truth <> pred), 6) AS share FROM e")
def a35_attribute(t: Tables) -> DataFrame:
    return rounded(evaluation.attribute(t.pixels().withColumnRenamed("label", "raw"), classes=5), "share")


@query("SELECT count(DISTINCT o_custkey) AS events, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS kept, round(count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') / count(DISTINCT o_custkey), 6) AS bound, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') / count(DISTINCT o_custkey) >= 0.7 AS accepted FROM orders")
def a36_retention(t: Tables) -> DataFrame:
    o = t.read("orders").withColumnRenamed("o_custkey", "event_key")
    return rounded(evaluation.retention(o, o.where("o_orderstatus = 'F'")), "bound")


@query(f"WITH {PX}, w AS (SELECT severity AS class, 1 / sqrt(count(*)) AS r FROM px GROUP BY severity) SELECT class, round(least(r / (SELECT avg(r) FROM w), 4), 6) AS weight FROM w")
def a40_class_weights(t: Tables) -> DataFrame:
    return rounded(evaluation.class_weights(t.pixels().groupBy(F.col("severity").alias("class")).agg(F.count("*").alias("n"))), "weight")


PROB = "least(greatest(a - 0.5::DOUBLE, 0), 1)"


@query(f"WITH {PX}, p AS (SELECT {PROB} AS p, (truth > 0)::INT AS y FROM px), b AS (SELECT least(floor(p * 15), 14) AS k, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum(p * (1 - p)) AS v FROM p GROUP BY 1) SELECT round(sum(abs(mp - my) * n) / sum(n), 6) AS ece, round(sum(v) / sum(n), 6) AS sharpness FROM b")
def a42_calibration_error(t: Tables) -> DataFrame:
    p = F.least(F.greatest(F.col("a") - 0.5, F.lit(0.0)), F.lit(1.0))
    return rounded(evaluation.calibration_error(t.pixels().withColumns({"p": p, "y": F.col("truth") > 0}), "p", "y"), "ece", "sharpness")


@query(f"WITH {PX}, x AS (SELECT (truth = pred) AS p, (a > 1) = (truth > 0) AS q FROM px), c AS (SELECT count(*) FILTER (p AND q) AS n11, count(*) FILTER (p AND NOT q) AS n10, count(*) FILTER (NOT p AND q) AS n01, count(*) FILTER (NOT p AND NOT q) AS n00 FROM x) SELECT round(n00 / (n11 + n10 + n01 + n00), 6) AS double_fault, round((n11 * n00 - n10 * n01) / nullif(n11 * n00 + n10 * n01, 0), 6) AS q FROM c")
def a42_q_statistic(t: Tables) -> DataFrame:
    px = t.pixels().withColumns({"x": F.col("truth") == F.col("pred"), "y": (F.col("a") > 1) == (F.col("truth") > 0)})
    return rounded(evaluation.q_statistic(px, "x", "y"), "double_fault", "q")


CUTS = [0.3, 0.4, 0.5, 0.6, 0.7]


@query(f"WITH {PX}, s AS (SELECT k, count(*) FILTER ({PROB} >= k AND truth > 0) AS tp, count(*) FILTER ({PROB} >= k AND truth = 0) AS fp, count(*) FILTER ({PROB} < k AND truth > 0) AS fn FROM px, (SELECT unnest({CUTS}::DOUBLE[]) AS k) GROUP BY k) SELECT k AS cutoff, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, k DESC LIMIT 1")
def m05_best_cutoff(t: Tables) -> DataFrame:
    px = t.pixels().withColumns({"p": F.least(F.greatest(F.col("a") - 0.5, F.lit(0.0)), F.lit(1.0)), "hit": F.col("truth") > 0})
    return rounded(evaluation.best_cutoff(px, "p", "hit", CUTS).select("cutoff", "f1"), "f1")


@query(f"WITH {N}, m AS (SELECT model, 3 * sum(tp) >= sum(tp + fp + fn) AS ok FROM n GROUP BY model) SELECT count(*) FILTER (ok) = 3 AS passed, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(['first', 'second', 'third']) AS x) WHERE x NOT IN (SELECT model FROM m)) AS missing FROM m")
def a43_decision(t: Tables) -> DataFrame:
    """Each model has to reach an IoU of one third; a third model is asked for, and none is there."""
    metrics = t.counts().groupBy(F.col("model").alias("name")).agg((3 * F.sum("tp") >= F.sum(F.col("tp") + F.col("fp") + F.col("fn"))).alias("ok"))
    return evaluation.decision(metrics, ["first", "second", "third"]).select("passed", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {PX}, p AS (SELECT chip_id, pos, {PROB} AS p, least(greatest(b - 0.5::DOUBLE, 0), 1) AS q FROM px) SELECT chip_id, pos, p + (1 - p) * q AS either, round(CASE WHEN sqrt(p * q) + sqrt((1 - p) * (1 - q)) > 0 THEN sqrt(p * q) / (sqrt(p * q) + sqrt((1 - p) * (1 - q))) END, 6) AS even FROM p")
def f11_fusion(t: Tables) -> DataFrame:
    p, q = (F.least(F.greatest(F.col(c) - 0.5, F.lit(0.0)), F.lit(1.0)) for c in ("a", "b"))
    return rounded(t.pixels().select("chip_id", "pos", probability.noisy_or(p, q).alias("either"), probability.equal_odds(p, q).alias("even")), "even")


@query("""WITH v AS (SELECT vec_id, [abs(x) + 0.01::DOUBLE for x in embedding[1:32]::DOUBLE[]] AS x, [abs(x) + 0.01::DOUBLE for x in embedding[33:64]::DOUBLE[]] AS y FROM embeddings),
g AS (SELECT vec_id, x, [exp((ln(greatest(x[i], 1e-4)) + ln(greatest(y[i], 1e-4))) / 2) for i in range(1, 33)] AS g FROM v)
SELECT vec_id, round(g[2] / list_sum(g), 6) AS second, CAST(list_position(g, list_max(g)) - 1 AS INT) AS best, round(list_sum(list_sort(x)[2:31]) / 30, 6) AS trimmed FROM g""")
def x02_geometric_mean(t: Tables) -> DataFrame:
    part = lambda at: F.transform(F.slice("embedding", at, 32), lambda v: F.abs(v.cast("double")) + 0.01)
    v = t.read("embeddings").select("vec_id", part(1).alias("x"), part(33).alias("y"))
    g = v.withColumn("g", probability.geometric_mean([F.col("x"), F.col("y")]))
    return rounded(g.select("vec_id", F.get("g", F.lit(1)).alias("second"), probability.argmax(F.col("g")).alias("best"), probability.trimmed_mean(F.col("x")).alias("trimmed")), "second", "trimmed")


# --- splits and selection ----------------------------------------------------------------------------------------

HASHED = "h AS (SELECT k, row_number() OVER (ORDER BY sha256('s1:' || k), k) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders))"


def _ids(t: Tables) -> DataFrame:
    return t.read("orders").select(F.col("o_custkey").alias("k")).distinct()


@query(f"WITH {HASHED} SELECT k, CASE WHEN rank <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS partition FROM h")
def w08_split_by_fire(t: Tables) -> DataFrame:
    return selection.split_by_fire(_ids(t), 0.2, "s1", "k").select("k", "partition")


@query(f"WITH {HASHED} SELECT k, CASE WHEN rank <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'holdout' WHEN rank <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) + greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS partition FROM h")
def w09_three_way(t: Tables) -> DataFrame:
    return selection.three_way(_ids(t), 0.15, 0.1, "s1", "k").select("k", "partition")


@query(f"WITH {HASHED} SELECT k, CAST((rank - 1) % 5 AS INT) AS fold FROM h")
def w10_folds(t: Tables) -> DataFrame:
    return selection.folds(_ids(t), 5, "s1", "k").select("k", "fold")


HEX = "list_reduce(list_prepend(0::BIGINT, [('0x' || x)::BIGINT for x in string_split(sha256(k::VARCHAR), '')]), lambda a, x: (a * 16 + x) % 10)"


@query(f"WITH i AS (SELECT DISTINCT o_custkey AS k FROM orders), m AS (SELECT k, {HEX} AS m FROM i) SELECT k, CASE WHEN m < 6 THEN 'train' WHEN m < 8 THEN 'val' ELSE 'test' END AS partition FROM m")
def w12_hash_partition(t: Tables) -> DataFrame:
    return _ids(t).select("k", selection.hash_partition(F.col("k")).alias("partition"))


@query("""WITH r AS (SELECT p_partkey AS k, p_brand AS g, p_size % 3 AS bin, sha256('s2:' || p_partkey) AS h FROM part), a AS (SELECT *, row_number() OVER (PARTITION BY g, bin ORDER BY h, k) AS r FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r, bin, h, k) AS turn FROM a) SELECT k, CAST(turn AS INT) AS turn FROM b WHERE turn <= 4 ORDER BY b.turn, sha256('s2:' || g), h, k LIMIT 60""")
def w13_balanced(t: Tables) -> DataFrame:
    rows = t.read("part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), (F.col("p_size") % 3).alias("bin"))
    return selection.balanced(rows, "g", "bin", "k", 4, 60, "s2").select("k", "turn")


@query("SELECT p_partkey AS k, CASE WHEN row_number() OVER (ORDER BY p_size DESC, p_partkey) <= ceil(count(*) OVER () * 0.25::DOUBLE) THEN 2 ELSE 1 END AS weight FROM part")
def w14_hard_background(t: Tables) -> DataFrame:
    return selection.hard_background(t.read("part").select(F.col("p_partkey").alias("k"), "p_size"), "p_size", "k").select("k", "weight")


@query("SELECT p_partkey AS k FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY sha256('s3:' || p_partkey), p_partkey) <= 2")
def w16_per_class(t: Tables) -> DataFrame:
    rows = t.read("part").select(F.col("p_partkey").alias("k"), "p_brand", (F.col("p_size") % 3).alias("c"))
    return selection.per_class(rows, "p_brand", "c", "k", 2, "s3").select("k")


@query("SELECT p_partkey AS k, CAST(i AS INT) AS copy FROM part, range(1, 4) x(i) WHERE i <= p_size % 4")
def w17_replicated(t: Tables) -> DataFrame:
    rows = t.read("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4).alias("w"))
    return selection.replicated(rows, "w").select("k", "copy")


@query()
def x01_greedy_members(t: Tables) -> DataFrame:
    px = t.pixels().withColumn("key", F.col("chip_id") * 10000 + F.col("pos"))
    members = F.explode(F.array(*[F.struct(F.lit(n).alias("member"), v.alias("p")) for n, v in (("m1", F.col("a") - 0.5), ("m2", 1.5 - F.col("b")), ("m3", F.col("dnbr") + 0.5))])).alias("x")
    chosen = selection.greedy_members(px.select("key", members).select("key", "x.*"), "member", "key", "p", px.select("key", (F.col("truth") > 0).alias("truth")))
    return t.spark.createDataFrame([(k, m) for k, m in enumerate(chosen)], "step int, member string")


# --- joins -------------------------------------------------------------------------------------------------------

PAIRS = f"""{S}, af AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud, ordinal) AS rk FROM s WHERE day_no > 200), a2 AS (SELECT * FROM af WHERE rk <= 8 AND valid >= 0.4),
bf AS (SELECT a2.tile, a2.ordinal AS after_id, a2.valid AS av, a2.rk AS arank, s.ordinal AS before_id, s.valid AS bv, row_number() OVER (PARTITION BY a2.tile, a2.ordinal ORDER BY s.cloud, s.ordinal) AS rk
  FROM a2 JOIN s ON s.tile = a2.tile AND s.day_no < 190 AND least(abs(s.day_no - a2.day_no), 365 - abs(s.day_no - a2.day_no)) <= 60),
b2 AS (SELECT * FROM bf WHERE rk <= 8 AND bv >= 0.4 QUALIFY row_number() OVER (PARTITION BY tile, after_id ORDER BY rk) = 1)
SELECT tile, before_id, after_id, round(bv + av, 6) AS score FROM b2 QUALIFY row_number() OVER (PARTITION BY tile ORDER BY bv + av DESC, arank) = 1"""


@query(f"WITH {PAIRS}")
def w01_select_pairs(t: Tables) -> DataFrame:
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k)
    found = joins.select_pairs(t.scenes(), day(190), day(200), gap_days=60, least_valid=0.4)
    return rounded(found.select("tile", "before_id", "after_id", "score"), "score")


@query(f"WITH {B} SELECT p.id AS a_id, q.id AS b_id FROM b p JOIN b q ON p.partition = 'train' AND q.partition = 'test' AND p.w < q.e AND q.w < p.e AND p.s < q.n AND q.s < p.n")
def j10_overlapping(t: Tables) -> DataFrame:
    b = t.boxes()
    return joins.overlapping(b.where("partition = 'train'"), b.where("partition = 'test'"), 2.0)


@query(f"WITH {B} SELECT p.id AS a_id, q.id AS b_id, p.partition AS a_part, q.partition AS b_part FROM b p JOIN b q ON p.id < q.id AND p.partition <> q.partition AND p.w < q.e AND q.w < p.e AND p.s < q.n AND q.s < p.n")
def j11_leaks(t: Tables) -> DataFrame:
    return joins.leaks(t.boxes(), 2.0)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey % 7 = 0)")
def j15_without_bad_groups(t: Tables) -> DataFrame:
    o = t.read("orders")
    return joins.without_bad_groups(o, o.where("o_orderpriority LIKE '1%' AND o_orderkey % 7 = 0"), "o_custkey").select("o_orderkey")


@query("SELECT e.event_id, epoch_us((SELECT min(f.ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND f.ts >= e.ts)) - epoch_us(e.ts) AS wait_us FROM events e WHERE event_type = 'click'")
def j19_first_after(t: Tables) -> DataFrame:
    e = t.read("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    got = joins.first_after(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought")), ["user_id"], "ts", "bought")
    return got.select("event_id", (F.unix_micros("next") - F.unix_micros("ts")).alias("wait_us"))


@query("""SELECT e.event_id, f.event_id AS other, abs(epoch_us(e.ts) - epoch_us(f.ts)) AS gap_us FROM events e JOIN events f ON e.user_id = f.user_id AND e.event_type = 'click' AND f.event_type = 'error'
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(f.ts)), f.event_id) = 1""")
def j20_nearest_in_time(t: Tables) -> DataFrame:
    e = t.read("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return joins.nearest_in_time(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("at")), ["user_id"], "event_id", "ts", "other", "at")


@query("""SELECT p_partkey AS k, 'extra' AS side FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'missing' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0""")
def j09_template_diff(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_partkey").alias("k"))
    return joins.template_diff(p.where("k % 3 = 0"), p.where("k % 5 = 0"), ["k"])


@query("SELECT count(*) FILTER (p_partkey % 3 = 0 AND p_partkey % 2 <> 0) AS extra, count(*) FILTER (p_partkey % 2 = 0 AND p_partkey % 3 <> 0) AS missing FROM part")
def j16_same_population(t: Tables) -> DataFrame:
    p = t.read("part").select("p_partkey")
    return joins.same_population(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 2 = 0"))


@query(f"WITH {S} SELECT f.ordinal AS frame_id, arg_min(x.ordinal, (x.cloud, x.ordinal)) AS scene_id, min(x.cloud) AS cloud FROM s f JOIN s x ON f.tile = x.tile AND f.day_no % 3 = x.day_no % 3 WHERE f.ordinal % 3 = 0 AND x.ordinal % 3 = 1 GROUP BY f.ordinal")
def j18_clearest_twin(t: Tables) -> DataFrame:
    s = t.scenes().withColumn("day", F.col("day_no") % 3)
    return joins.clearest_twin(s.where("ordinal % 3 = 0").select(F.col("ordinal").alias("frame_id"), "tile", "day"), s.where("ordinal % 3 = 1").select(F.col("ordinal").alias("scene_id"), "tile", "day", "cloud"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of nominal confidence or better, grouped to fire events, those in a box and a span of days."""
    kept, _ = confidence.partition(Tables(spark, sf_dir).detections(), minimum=1)
    ev = points.events(points.event_members(kept))
    inside = geo.in_bbox(F.col("lat"), F.col("lon"), (82.0, 51.0, 110.0, 61.0))
    return ev.where(inside & (F.col("last_seen") >= F.lit("2024-01-05").cast("timestamp"))).select("event_id", "n", "first_seen", "last_seen", "lat", "lon", "total_frp", "sensors")


def queries() -> dict[str, Query]:
    from cinderlake import further_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from cinderlake import further_queries  # noqa: F401  registers its own

    return dict(_SQL)
