"""Streams against their replays: batches, restarts and late rows change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from homeround.operators import routing
from homeround.streaming import routes

START = datetime(2026, 3, 1, 8)
CHANGE = "route_id long, at timestamp, event_id long, status string, plan_seconds long, plan_cost double"
STOP = "route_id long, at timestamp, stop_id long, sequence int, service_minutes int"
REPORT = "route_id long, stop_id long, at timestamp, event_id long, status string, expected_version int, completed_at timestamp, failure_reason string"


def minute(m):
    return START + timedelta(minutes=m)


def tables(spark, changes, stops, reports):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    return routes.inputs(make(changes, CHANGE), make(stops, STOP), make(reports, REPORT))


def streamed(spark, tmp_path, batches, name, delay="10 minutes", stop_after=()):
    """Rows of batches, one file each; the query is stopped and started again after some of them."""
    source, check = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-check")
    out = str(tmp_path / f"{name}-out")

    def run():
        stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = routes.execute_routes(stream, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        if k in stop_after or k == len(batches) - 1:
            run()
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def busy(spark):
    """Three routes, one paused in the middle, with reports of every outcome."""
    rng = random.Random(4)
    changes, stops, reports = [], [], []
    for r in (1, 2, 3, 5):
        changes.append((r, minute(0), r, "published", 3_600, 9.0))
        stops += [(r, minute(0), 10 * r + k, k, 10 + k) for k in range(1, 6)]
    changes += [(2, minute(30), 8, "cancelled", None, None), (2, minute(60), 9, "in_progress", None, None)]
    for event in range(100, 220):
        r = rng.choice((1, 2, 3, 3, 4))
        at = minute(1 + (event - 100) * 0.9)
        status = rng.choice(("completed", "failed", "skipped", "completed", "lost"))
        reports.append((r, 10 * r + rng.randint(1, 6), at, event, status, rng.choice((1, 1, 2, 3)), rng.choice((None, at, minute(5))), rng.choice((None, " ", "absent", "absent"))))
    reports += [(5, 51, minute(2 + k), 300 + k, "skipped", v, None, " closed ") for k, v in enumerate((1, 2, 1))]
    heart = [(99, minute(10_000), 1, "draft", None, None)]  # moves the watermark past all
    return changes, stops, reports, heart


def test_reports_in_event_time_equal_their_replay_however_they_arrive(spark, tmp_path, busy):
    changes, stops, reports, heart = busy
    every = tables(spark, changes, stops, reports)
    expected = routes.replay_routes(every).cache()
    seen = {r.outcome for r in routes.outcomes(expected).collect()}
    assert seen == {"applied", "replay", "conflict", "reason_required", "invalid_status", "route_not_found", "route_not_executable", "stop_not_found"}
    key = lambda rows: sorted(map(str, routes.outcomes(rows).collect()))
    # the change that cancels route 2, and its stops, come minutes after reports that it forbids
    late = [c for c in changes if c[0] == 2]
    first = tables(spark, [c for c in changes if c[0] != 2], [s for s in stops if s[0] != 2], reports[120:])
    mixed = tables(spark, late[:1], [s for s in stops if s[0] == 2], reports[:8])
    rest = [tables(spark, [], [], reports[i : i + 16]) for i in range(8, 120, 16)]
    batches = [first, mixed, rest[0], rest[1], rest[2].union(tables(spark, late[1:2], [], [])), rest[3], rest[4].union(tables(spark, late[2:], [], [])), *rest[5:], tables(spark, heart, [], [])]
    got = streamed(spark, tmp_path, batches, "mixed", "25 minutes", stop_after=(2, 5))
    assert key(got) == key(expected)
    last = {r.route_id: r for r in routes.metrics(got).orderBy("at").collect()}
    assert {k: tuple(v) for k, v in last.items()} == {r.route_id: tuple(r) for r in routes.metrics(expected).collect()} and set(last) == {1, 2, 3, 5}


def test_metrics_are_those_of_the_batch_operator(spark, busy):
    changes, stops, reports, _ = busy
    replay = routes.replay_routes(tables(spark, changes, stops, reports))
    done = {r.stop_id: r for r in routes.outcomes(replay).orderBy("at", "event_id").where("outcome = 'applied'").collect()}
    given = {e: (t or a) for _, _, a, e, _, _, t, _ in reports}
    rows = [(r, s, k, done[s].status if s in done else "pending", given[done[s].event_id] if s in done else None, m) for r, _, s, k, m in stops]
    frame = spark.createDataFrame(rows, "route_id long, stop_id long, sequence int, status string, completed_at timestamp, service_minutes int")
    planned = spark.createDataFrame([(r, 3_600, 9.0) for r in (1, 2, 3, 5)], "route_id long, travel_seconds long, cost double")
    names = ("route_id", "completed", "failed", "pending", "service_seconds", "travel_seconds", "estimated_cost", "visited_order")
    assert sorted(map(tuple, routing.actual_metrics(frame, planned).select(*names).collect())) == sorted(map(tuple, routes.metrics(replay).select(*names).collect()))


def test_a_route_with_no_pending_stop_is_completed_and_takes_no_more(spark):
    rows = tables(
        spark, [(1, minute(0), 1, "published", 600, 5.0)], [(1, minute(0), 1, 1, 10), (1, minute(0), 2, 2, 10)],
        [(1, 1, minute(5), 1, "completed", 1, minute(5), None), (1, 2, minute(35), 2, "failed", 1, None, "absent"), (1, 1, minute(36), 3, "skipped", 2, None, None)],
    )
    got = routes.replay_routes(rows)
    assert [(r.event_id, r.outcome, r.version, r.route_status) for r in routes.outcomes(got).orderBy("event_id").collect()] == [
        (1, "applied", 2, "in_progress"), (2, "applied", 2, "completed"), (3, "route_not_executable", 2, "completed"),
    ]
    (m,) = routes.metrics(got).collect()
    assert (m.completed, m.failed, m.pending, m.service_seconds, m.travel_seconds, m.estimated_cost, m.visited_order) == (1, 1, 0, 600, 1_200, 10.0, "1,2")


def test_a_silent_route_is_forgotten(spark):
    late = (1, 1, minute(3_000), 2, "completed", 1, None, None)
    rows = tables(spark, [(1, minute(0), 1, "published", 600, 5.0)], [(1, minute(0), 1, 1, 10)], [late])
    assert [r.outcome for r in routes.outcomes(routes.replay_routes(rows)).collect()] == ["route_not_found"]
    assert [r.outcome for r in routes.outcomes(routes.replay_routes(rows, 10 * routes.DAY_US)).collect()] == ["applied"]


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    """State holds one entry a stop, however many reports there were."""
    changes, stops = [(1, minute(0), 1, "published", 600, 5.0)], [(1, minute(0), 1, 1, 10), (1, minute(0), 2, 2, 10)]
    reports = [(1, 1, minute(1 + k), k, ("failed", "skipped")[k % 2], 1 + k, None, "x") for k in range(60)]
    batches = [tables(spark, changes, stops, reports[:20]), tables(spark, [], [], reports[20:40]), tables(spark, [], [], reports[40:]), tables(spark, [(9, minute(500), 1, "draft", None, None)], [], [])]
    got = streamed(spark, tmp_path, batches, "long", "1 minute")
    assert routes.outcomes(got).where("outcome = 'applied'").count() == 60
    state = spark.read.format("statestore").option("path", str(tmp_path / "long-check")).option("stateVarName", "stops").load()
    assert state.where(F.col("key.route_id") == 1).count() == 2


MAPPING = {"id": "external_ref", "calle": "address", "cp": "postal_code", "municipio": "municipality", "provincia": "province"}


def sheet(folder, name, refs, sep=",", headers=("id", "calle", "cp", "municipio", "provincia"), codec="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    rows = [sep.join(headers)] + [sep.join({"id": r, "calle": '"Calle 1, 2ª"', "cp": "48001", "municipio": "Bilbao", "provincia": "Bizkaia"}.get(h, "x") for h in headers) for r in refs]
    (folder / name).write_bytes("\r\n".join(rows).encode(codec))


def test_arriving_files_are_each_loaded_once(spark, tmp_path):
    source = tmp_path / "in"
    one, two, other = source / "7" / "2026-01", source / "7" / "2026-02", source / "8" / "2026-01"
    arrivals = [
        lambda: [sheet(one, "a.csv", ["P1", "P2", " p1", ""]), sheet(other, "a.csv", ["P1"]), sheet(source / "x" / "2026-01", "a.csv", ["P1"])],
        lambda: [sheet(one, "again.csv", ["P1", "P2", " p1", ""]), sheet(one, "b.csv", ["P2", "=3", "P4"], ";", ("extra", "provincia", "municipio", "cp", "calle", "id"))],
        lambda: [sheet(two, "a.csv", ["P1", "P2", " p1", ""]), sheet(one, "big.csv", [f"B{i}" for i in range(7)]), sheet(one, "c.csv", ["=3", "P4"], codec="utf-8-sig"), sheet(one, "d.csv", ["ñ"], codec="latin-1")],
        lambda: [sheet(one, "late.csv", ["P1", "P2", " p1", ""]), (one / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0" + "xx_VBA_PROJECT".encode("utf-16-le")), (one / "e.csv").write_bytes(b"")],
    ]
    from homeround.streaming import imports

    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for arrive in arrivals:  # each time the stream is started anew
        arrive()
        query = imports.import_stream(imports.arriving_files(spark, str(source)), MAPPING, 6).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    names = ["organization_id", "period", "batch_id", "row_number", "external_ref", "address", "validation_status", "error", F.transform("errors", lambda e: e["code"]).alias("codes")]
    got = sorted((tuple(r) for r in spark.read.parquet(out).select(*names).collect()), key=str)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(source))
    assert got == sorted((tuple(r) for r in imports.replay_imports(found, MAPPING, 6).select(*names).collect()), key=str)
    codes = {(r[0], r[1], r[3], r[4]): r[8] for r in got if r[7] is None}
    assert codes[7, "2026-01", 3, " p1"] == ["DUPLICATE_IN_BATCH"] and codes[7, "2026-01", 4, ""] == ["REQUIRED_FIELD_MISSING"]
    assert codes[7, "2026-01", 1, "P2"] == ["DUPLICATE_IN_PERIOD"] and codes[7, "2026-01", 2, "P4"] == ["DUPLICATE_IN_PERIOD"]
    assert codes[7, "2026-02", 1, "P1"] == [] and codes[8, "2026-01", 1, "P1"] == [] and codes[7, "2026-01", 1, "=3"] == ["FORMULA_INJECTION_REJECTED"]
    assert sorted(r[7] for r in got if r[7]) == ["MACROS_REJECTED", "NOT_UTF8", "TOO_MANY_ROWS", "UNKNOWN_FOLDER"]
    assert sum(r[0] == 7 and r[1] == "2026-01" and r[4] == "P1" for r in got) == 1 and all(r[5] == "Calle 1, 2ª" for r in got if r[7] is None)


def test_one_plan_reads_files_of_many_headers(spark, tmp_path):
    from homeround.sources import files

    for i in range(120):
        sheet(tmp_path / "many", f"{i}.csv", [f"R{i}", f"S{i}"], ",;"[i % 2], (*[f"h{k}" for k in range(i % 40)], "id", "calle"))
    folder = str(tmp_path / "many")
    rows = files.read_import_csv(spark, [folder], ["id", "calle", "h3", "none"])
    got = {(r.id, r.row_number): (r.calle, r.h3, r.none, r.error) for r in rows.collect()}
    assert len(got) == 240 and got["R5", 1] == ("Calle 1, 2ª", "x", None, None) and got["S2", 2] == ("Calle 1, 2ª", None, None, None)
    plan = rows._jdf.queryExecution().toString()
    assert plan.count("Scan binaryFile") == 1 or plan.count("FileScan binaryFile") == 1
    every = files.read_import_csv(spark, [folder])
    assert set(every.columns) == {"file", "row_number", "id", "calle", "error", *(f"h{k}" for k in range(39))} and every.count() == 240


def test_notifications_are_written_once(spark, tmp_path):
    from homeround.operators import routing
    from homeround.streaming import streams

    kind = "event_id int, event_type string, ts timestamp, recipients array<int>"
    arrivals = [[(1, "a", minute(0), [5, 5, 6]), (2, "b", minute(1), [5])], [(1, "a", minute(0), [5, 6, 7]), (3, "a", minute(2), None)], [(1, "a", minute(0), [5]), (4, "a", minute(3), [5])]]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in arrivals:  # started anew each time
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = streams.notification_stream(spark.readStream.schema(kind).parquet(source), {"a": "x"})
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "recipient_id", "type").collect())
    every = spark.createDataFrame([r for rows in arrivals for r in rows], kind)
    assert got == sorted(tuple(r) for r in routing.notifications(every, {"a": "x"}).select("event_id", "recipient_id", "type").collect()) == [(1, 5, "x"), (1, 6, "x"), (1, 7, "x"), (4, 5, "x")]
