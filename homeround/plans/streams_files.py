"""Queries of files, encryption and streams over the domain views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from homeround.functions import crypt
from homeround.operators import geocoding as G
from homeround.sources import files
from homeround.storage import shared_dir
from homeround.streaming import routes, streams

KEYS = {"k1": b"0123456789abcdef0123456789abcdef", "k2": b"fedcba9876543210fedcba9876543210"}


def reports(v):
    return v("reports").select(
        "event_id", "stop_id", "reported_at", "status", (1 + F.get_json_object("props", "$.k").cast("int") % 4).alias("expected_version"),
        F.when(F.col("status") != "pending", F.col("reported_at")).alias("completed_at"), F.when(F.col("event_id") % 3 != 0, "absent").alias("failure_reason"),
    )


def _round_trip(v):
    a = v("addresses").withColumn("stored", F.when(F.col("address_id") % 2 == 0, crypt.encrypt_field(F.col("address"), "k1", KEYS["k1"])).otherwise(crypt.encrypt_field(F.col("address"), "k9", KEYS["k2"])))
    return a.select("address_id", crypt.decrypt_field(F.col("stored"), KEYS).alias("address"))


def _replies(v):
    part = F.to_json(F.array(F.struct(F.lit("43.2").alias("lat"), F.lit("-2.9").alias("lon"), F.col("p_name").alias("display_name"), F.when(F.col("p_size") % 2 == 0, "house").otherwise("residential").alias("type"), F.lit("highway").alias("class"),
        F.struct(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("town"), F.col("p_type").alias("municipality")).alias("address"))))
    return v("part").select(F.col("p_partkey").alias("address_id"), part.alias("reply"))


def _files(v):
    rows = v("import_rows")
    batches = rows.groupBy("organization_id", "period", "batch_id").agg(F.sha2((F.count("*") % 3).cast("string"), 256).alias("content_hash"))
    loaded = rows.where("organization_id % 2 = 0 and row_number = 1").select("organization_id", "period", F.sha2(F.lit("1"), 256).alias("content_hash"), "cancelled")
    return files.dedupe_files(batches, loaded).select("batch_id", "duplicate")


def route_rows(v):
    """A route is published on its date; one in eleven is cancelled forty days later; each reported stop has one report. Times do not depend on the session's zone."""
    day = lambda c, minutes=0: F.timestamp_seconds(F.unix_date(F.col(c).cast("date")).cast("long") * 86_400 + F.lit(minutes) * 60)
    stops = v("stops").withColumn("stop_id", F.col("route_id") * 100 + F.col("sequence"))
    each = stops.groupBy("route_id").agg(F.min("service_date").alias("service_date"))
    published = each.select("route_id", day("service_date").alias("at"), F.col("route_id").alias("event_id"), F.lit("published").alias("status"), (3_600 + F.col("route_id") % 100).alias("plan_seconds"), F.lit(9.0).alias("plan_cost"))
    cancelled = each.where("route_id % 11 = 0").select("route_id", day("service_date", 40 * 1440).alias("at"), (-F.col("route_id")).alias("event_id"), F.lit("cancelled").alias("status"), F.lit(None).cast("long").alias("plan_seconds"), F.lit(None).cast("double").alias("plan_cost"))
    order = stops.select("route_id", day("service_date").alias("at"), "stop_id", "sequence", "service_minutes")
    reports = stops.where("status <> 'pending'").select(
        "route_id", "stop_id", day("shipped", F.col("sequence")).alias("at"), F.col("stop_id").alias("event_id"), "status", (1 + (F.col("patient_id") % 7 == 0).cast("int")).alias("expected_version"),
        day("shipped", F.col("sequence")).alias("completed_at"), F.when(F.col("patient_id") % 5 != 0, "absent").alias("failure_reason"),
    )
    return routes.inputs(published.unionByName(cancelled), order, reports)


def _replayed(v):
    return routes.replay_routes(route_rows(v), 10_000 * routes.DAY_US)  # stops of the given tables ship years apart


#: Reports as ``route_rows`` makes them, with what becomes of each.
ROUTE_REPORTS = """
r AS (
  SELECT route_id, route_id * 100 + sequence AS event_id, sequence, patient_id, service_minutes, status,
    (CAST(shipped AS DATE) - DATE '1970-01-01') * 86400 + sequence * 60 AS at_s, (CAST(service_date AS DATE) - DATE '1970-01-01') * 86400 AS from_s
  FROM stops
), o AS (
  SELECT *, CASE WHEN status = 'pending' THEN NULL WHEN status = 'failed' AND patient_id % 5 = 0 THEN 'reason_required' WHEN at_s < from_s THEN 'route_not_found'
    WHEN route_id % 11 = 0 AND at_s >= from_s + 40 * 86400 THEN 'route_not_executable' WHEN patient_id % 7 = 0 THEN 'conflict' ELSE 'applied' END AS outcome
  FROM r
)"""


def _through(v, name, write, read):
    """Rows of a view written as files in the shared folder and read back."""
    rows = v(name)
    path = f"{shared_dir(rows.sparkSession)}/homeround/{name}-{uuid.uuid4().hex}"
    write(rows, path)
    return read(rows.sparkSession, path)


def _gazetteer_rows(rows):
    return rows.select("street", "house_number", "municipality", "postal_code", "latitude", "longitude", F.lit("registry").alias("source"), F.col("point_no").cast("string").alias("source_ref"), "aliases")


def _gazetteer_csv(v):
    back = _through(v, "gazetteer", lambda rows, path: _gazetteer_rows(rows).write.csv(path, header=True), files.read_gazetteer_csv)
    return back.select("source_ref", "street", "house_number", "latitude", "longitude", F.array_join("aliases", "|").alias("aliases"))


def _gazetteer_geojson(v):
    def write(rows, path):
        """A collection for each 500 points."""
        feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct("street", "house_number", "municipality", "postal_code", "source", "source_ref", "aliases").alias("properties"))
        per = _gazetteer_rows(rows).groupBy(F.floor(F.col("source_ref").cast("long") / 500).alias("part")).agg(F.collect_list(feature).alias("features"))
        per.select("part", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.partitionBy("part").text(path)

    back = _through(v, "gazetteer", write, files.read_gazetteer_geojson)
    return back.select("source_ref", "street", "municipality", "latitude", "longitude")


def _refreshed(v):
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    registry = v("gazetteer").select(
        F.concat(F.lit(" "), "street").alias("Izena/Nombre"), F.when(F.col("point_no") % 9 == 0, "0").otherwise(F.col("house_number")).alias("Zenbakia/Número"), F.col("municipality").alias("Udalerria/Municipio"),
        F.col("postal_code").alias("Posta-kodea/Código Postal"), F.col("point_no").cast("string").alias("Posta-helbidea/Dirección postal"),
        F.when(F.col("point_no") % 10 == 0, "x").otherwise(comma("latitude")).alias("LAT_ETRS89"), comma("longitude").alias("LON_ETRS89"),
    )
    return files.refresh_gazetteer(registry, [f"Muni {i}" for i in range(0, 40, 2)]).select("source_ref", "street", "house_number", "municipality")


def _saved(v):
    """Two writes to one table: the second replaces the organizations that it holds."""

    def write(rows, path):
        files.save_table(rows, path)
        files.save_table(rows.where("organization_id % 4 = 1").withColumn("max_visits", F.col("max_visits") + 100), path)

    return _through(v, "zones", write, lambda spark, path: spark.read.parquet(path)).select("organization_id", "zone_id", "max_visits")


def _sheets(v):
    """Import rows as CSV files by organization, half of them in another order of columns, and read by their headers."""

    def write(rows, path):
        rows = rows.select("organization_id", "external_ref", "address", "postal_code", "batch_id", F.col("row_number").alias("n")).where("address IS NOT NULL")
        rows.where("organization_id % 2 = 0").write.partitionBy("organization_id").csv(f"{path}/even", header=True)
        rows.where("organization_id % 2 = 1").select("organization_id", "n", "batch_id", "address", "external_ref").write.partitionBy("organization_id").csv(f"{path}/odd", header=True, sep=";")

    back = _through(v, "import_rows", write, lambda spark, path: files.read_import_csv(spark, [f"{path}/*/*/"], ["batch_id", "n", "address", "postal_code"]))
    return back.select("batch_id", F.col("n").cast("int").alias("n"), "address", "postal_code")


QUERIES = {
    "route_outcomes": (
        lambda v: routes.outcomes(_replayed(v)).select("route_id", "event_id", "outcome", "version"),
        f"WITH {ROUTE_REPORTS} SELECT route_id, event_id, outcome, CASE WHEN at_s < from_s THEN NULL WHEN outcome = 'applied' THEN 2 ELSE 1 END AS version FROM o WHERE outcome IS NOT NULL",
    ),
    "route_metrics": (
        lambda v: routes.metrics(_replayed(v)).select("route_id", "route_status", "completed", "failed", "pending", "service_seconds", "travel_seconds", "estimated_cost", "visited_order"),
        f"""WITH {ROUTE_REPORTS}, m AS (
  SELECT route_id, count(*) FILTER (outcome = 'applied' AND status = 'completed') AS completed, count(*) FILTER (outcome = 'applied' AND status = 'failed') AS failed,
    count(*) FILTER (outcome IS NULL OR outcome <> 'applied') AS pending, coalesce(sum(service_minutes * 60) FILTER (outcome = 'applied' AND status = 'completed'), 0) AS service_seconds,
    max(at_s) FILTER (outcome = 'applied') - min(at_s) FILTER (outcome = 'applied') AS elapsed, string_agg(sequence, ',' ORDER BY at_s, sequence) FILTER (outcome = 'applied') AS visited_order
  FROM o GROUP BY route_id
), t AS (SELECT *, CASE WHEN completed + failed >= 2 THEN greatest(elapsed - service_seconds, 0) ELSE 0 END AS travel_seconds FROM m)
SELECT route_id, CASE WHEN route_id % 11 = 0 THEN 'cancelled' WHEN pending = 0 THEN 'completed' ELSE 'in_progress' END AS route_status, completed, failed, pending,
  CAST(service_seconds AS BIGINT) AS service_seconds, CAST(travel_seconds AS BIGINT) AS travel_seconds, round_even(9.0e0 * travel_seconds / (3600 + route_id % 100), 4) AS estimated_cost, visited_order
FROM t WHERE completed + failed > 0""",
    ),
    "gazetteer_csv": (_gazetteer_csv, "SELECT CAST(point_no AS VARCHAR) AS source_ref, street, house_number, latitude, longitude, aliases FROM gazetteer"),
    "gazetteer_geojson": (_gazetteer_geojson, "SELECT CAST(point_no AS VARCHAR) AS source_ref, street, municipality, latitude, longitude FROM gazetteer"),
    "refresh_gazetteer": (_refreshed, "SELECT CAST(point_no AS VARCHAR) AS source_ref, trim(street) AS street, trim(house_number) AS house_number, municipality FROM gazetteer WHERE CAST(substr(municipality, 6) AS INT) % 2 = 0 AND point_no % 9 <> 0 AND point_no % 10 <> 0 AND trim(house_number) NOT IN ('', '0')"),
    "saved_zones": (_saved, "SELECT organization_id, zone_id, max_visits + CASE WHEN organization_id % 4 = 1 THEN 100 ELSE 0 END AS max_visits FROM zones"),
    "import_sheets": (_sheets, "SELECT batch_id, row_number AS n, address, CASE WHEN organization_id % 2 = 0 THEN postal_code END AS postal_code FROM import_rows WHERE address IS NOT NULL"),
    "encrypt_round_trip": (_round_trip, "SELECT address_id, CASE WHEN address_id % 2 = 0 THEN address END AS address FROM addresses"),
    "flatten_candidates": (lambda v: G.flatten_candidates(_replies(v)).select("address_id", "ordinal", "latitude", "place_class", "municipality"), "SELECT p_partkey AS address_id, 1 AS ordinal, 43.2e0 AS latitude, CASE WHEN p_size % 2 = 0 THEN 'house' ELSE 'highway' END AS place_class, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS municipality FROM part"),
    "row_cap": (lambda v: files.enforce_row_cap(v("import_rows").withColumn("file", F.col("batch_id")), 3)[1], "SELECT batch_id AS file, count(*) AS n FROM import_rows GROUP BY 1 HAVING count(*) > 3"),
    "dedupe_files": (_files, "WITH b AS (SELECT organization_id, period, batch_id, count(*) % 3 AS h FROM import_rows GROUP BY ALL), l AS (SELECT DISTINCT organization_id, period, 1 AS h, true AS known FROM import_rows WHERE organization_id % 2 = 0 AND row_number = 1 AND NOT cancelled) SELECT batch_id, coalesce(known, false) OR row_number() OVER (PARTITION BY organization_id, period, h ORDER BY batch_id) > 1 AS duplicate FROM b LEFT JOIN l USING (organization_id, period, h)"),
    "stop_execution": (lambda v: streams.replay_reports(reports(v)), """
WITH RECURSIVE rep AS (
  SELECT event_id, stop_id, status, 1 + CAST(json_extract_string(props, '$.k') AS INT) % 4 AS expected, CASE WHEN status <> 'pending' THEN reported_at END AS done,
    CASE WHEN status = 'failed' AND event_id % 3 <> 0 THEN 'absent' END AS given, row_number() OVER (PARTITION BY stop_id ORDER BY reported_at, event_id) AS n
  FROM reports
), run AS (
  SELECT stop_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(1 AS INT) AS version, CAST(NULL AS TIMESTAMP) AS done, CAST(NULL AS VARCHAR) AS given, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome
  FROM (SELECT DISTINCT stop_id FROM rep)
  UNION ALL
  SELECT stop_id, n, CASE WHEN o = 'applied' THEN st ELSE status END, version + CASE WHEN o = 'applied' THEN 1 ELSE 0 END, CASE WHEN o = 'applied' THEN new_done ELSE done END, CASE WHEN o = 'applied' THEN why ELSE given END, event_id, o
  FROM (
    SELECT r.stop_id, q.n, r.status, r.version, r.done, r.given, q.event_id, q.status AS st, q.done AS new_done, q.given AS why,
      CASE WHEN q.expected IS DISTINCT FROM r.version THEN 'conflict' WHEN q.status = 'failed' AND q.given IS NULL THEN 'reason_required'
        WHEN q.status = r.status AND q.done IS NOT DISTINCT FROM r.done AND q.given IS NOT DISTINCT FROM r.given THEN 'replay' ELSE 'applied' END AS o
    FROM run r JOIN rep q ON q.stop_id = r.stop_id AND q.n = r.n + 1))
SELECT stop_id, event_id, outcome, status, version FROM run WHERE n > 0"""),
    "last_report_per_stop": (lambda v: streams.last_report_per_stop(reports(v)).select("stop_id", "event_id"), "SELECT stop_id, event_id FROM reports QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY reported_at DESC, event_id DESC) = 1"),
}
