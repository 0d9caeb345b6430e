"""Routes on the road: status changes, stops and reports of a route fold into one keyed state, in event time.

``inputs`` (:func:`inputs` builds them) hold all three kinds of rows. A row waits in the route's state until the watermark has passed
its time, so a status change that arrives late, within the delay, still takes effect before the reports after it, and the outcome does
not depend on how rows were dealt to batches. The state of a route is its status, plan and one entry a stop: what a batch costs depends
on the rows it brings and the length of their routes, never on earlier reports.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EXECUTABLE = ("published", "in_progress")
REPORTED = ("completed", "failed", "skipped")
DAY_US = 86_400_000_000

ROW = (
    "route_id long, at timestamp, at_us long, rank int, event_id long, stop_id long, status string, expected_version int, completed_us long, "
    "failure_reason string, sequence int, service_minutes int, plan_seconds long, plan_cost double"
)
RESULT = (
    "route_id long, kind string, at_us long, event_id long, stop_id long, outcome string, status string, version int, route_status string, completed int, "
    "failed int, skipped int, pending int, service_seconds long, travel_seconds long, estimated_cost double, visited_order string"
)
WAITING = ROW.replace("route_id long, at timestamp, ", "")


class Row(NamedTuple):
    at_us: int
    rank: int  # 0 status change, 1 stop, 2 report
    event_id: int
    stop_id: int | None
    status: str | None
    expected_version: int | None
    completed_us: int | None
    failure_reason: str | None
    sequence: int | None
    service_minutes: int | None
    plan_seconds: int | None
    plan_cost: float | None


class Stop(NamedTuple):
    status: str
    version: int
    completed_us: int | None
    reason: str | None
    sequence: int
    minutes: int


def inputs(changes: DataFrame, stops: DataFrame, reports: DataFrame) -> DataFrame:
    """The three kinds of rows as one table or stream.

    ``changes``: route_id, at, event_id, status, plan_seconds, plan_cost (of the optimized order; null: unchanged). A change to
    ``published`` starts the route anew. ``stops`` of the published order: route_id, at (that of the change), stop_id, sequence,
    service_minutes. ``reports``: route_id, stop_id, at, event_id, status, expected_version, completed_at, failure_reason.
    """
    fields = [tuple(x.split()) for x in ROW.split(", ")]

    def shaped(rows: DataFrame, rank: int) -> DataFrame:
        given = {"at_us": F.unix_micros(F.col("at").cast("timestamp")), "rank": F.lit(rank)}
        if "completed_at" in rows.columns:
            given["completed_us"] = F.unix_micros(F.col("completed_at").cast("timestamp"))
        if "event_id" not in rows.columns:
            given["event_id"] = F.col("stop_id")
        return rows.select(*[given.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])

    return shaped(changes, 0).unionByName(shaped(stops, 1)).unionByName(shaped(reports, 2))


class Route:
    """Status, plan and stops of one route, and how rows change them."""

    def __init__(self, status: str | None = None, plan_seconds: int | None = None, plan_cost: float | None = None, last_us: int | None = None):
        self.status, self.plan_seconds, self.plan_cost, self.last_us = status, plan_seconds, plan_cost, last_us
        self.stops: dict[int, Stop] = {}

    def apply(self, row: Row, keep_us: int) -> tuple[str, Stop | None] | None:
        """(outcome, stop after it) of a report. A route without rows for ``keep_us`` is forgotten."""
        if self.last_us is not None and row.at_us > self.last_us + keep_us:
            self.__init__()
        self.last_us = row.at_us if self.last_us is None else max(self.last_us, row.at_us)
        if row.rank == 0:
            if row.status == "published":
                self.stops = {}
            self.status = row.status
            if row.plan_seconds is not None:
                self.plan_seconds, self.plan_cost = row.plan_seconds, row.plan_cost
            return None
        if row.rank == 1:
            self.stops[row.stop_id] = Stop("pending", 1, None, None, row.sequence, row.service_minutes or 0)
            return None
        outcome, stop = self.report(row)
        if outcome == "applied":
            self.stops[row.stop_id] = stop
            if all(s.status != "pending" for s in self.stops.values()):
                self.status = "completed"
            elif self.status == "published":
                self.status = "in_progress"
        return outcome, stop

    def report(self, row: Row) -> tuple[str, Stop | None]:
        """Route first, then stop, version, replay; the first thing that speaks against a report is its outcome."""
        stop = self.stops.get(row.stop_id)
        reason = ((row.failure_reason or "").strip() or None) if row.status != "completed" else None
        if row.status not in REPORTED:
            return "invalid_status", stop
        if row.status == "failed" and reason is None:
            return "reason_required", stop
        if self.status is None:
            return "route_not_found", None
        if self.status not in EXECUTABLE:
            return "route_not_executable", stop
        if stop is None:
            return "stop_not_found", None
        if row.expected_version != stop.version:
            return "conflict", stop
        if (row.status, reason) == (stop.status, stop.reason) and row.completed_us in (None, stop.completed_us):
            return "replay", stop
        at = row.at_us if row.completed_us is None else row.completed_us
        return "applied", stop._replace(status=row.status, version=stop.version + 1, completed_us=at, reason=reason)

    def metrics(self) -> tuple:
        """Counts, service, travel and cost from the reports so far, and the stops visited in order."""
        stops = self.stops.values()
        count = lambda s: sum(x.status == s for x in stops)
        visited = sorted((x.completed_us, x.sequence) for x in stops if x.status in ("completed", "failed") and x.completed_us is not None)
        service = sum(x.minutes * 60 for x in stops if x.status == "completed")
        travel = max(0, visited[-1][0] // 1_000_000 - visited[0][0] // 1_000_000 - service) if len(visited) >= 2 else 0
        cost = round(self.plan_cost * travel / self.plan_seconds, 4) if self.plan_seconds else 0.0
        return count("completed"), count("failed"), count("skipped"), count("pending"), service, travel, cost, ",".join(str(s) for _, s in visited)


COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def _results(route_id: int, route: Route, rows: Iterable[Row], keep_us: int) -> list[tuple]:
    """An outcome row for each report, then the route's metrics if any report was applied."""
    out, touched = [], None
    for row in sorted(rows):
        found = route.apply(row, keep_us)
        if found is not None:
            outcome, stop = found
            state = (stop.status, stop.version) if stop else (None, None)
            out.append((route_id, "outcome", row.at_us, row.event_id, row.stop_id, outcome, *state, route.status, *[None] * 8))
            touched = row.at_us if outcome == "applied" else touched
    if touched is not None:
        out.append((route_id, "metrics", touched, None, None, None, None, None, route.status, *route.metrics()))
    return out


def _frame(results: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(results, columns=COLUMNS)
    whole = ("at_us", "event_id", "stop_id", "version", "completed", "failed", "skipped", "pending", "service_seconds", "travel_seconds")
    return frame.astype({c: "Int64" for c in whole} | {"estimated_cost": "Float64"})


def _rows(frame: pd.DataFrame) -> list[Row]:
    whole = {"at_us", "rank", "event_id", "stop_id", "expected_version", "completed_us", "sequence", "service_minutes", "plan_seconds"}

    def plain(c: str) -> list:
        """A column's values, null as None; nulls are found for the whole column at once."""
        values, lost = frame[c].tolist(), frame[c].isna().tolist()
        if c in whole:
            return [None if gone else int(v) for v, gone in zip(values, lost)]
        return [None if gone else v for v, gone in zip(values, lost)]

    columns = [plain(c) for c in Row._fields]
    return [Row(*values) for values in zip(*columns)]


class RouteProcessor(StatefulProcessor):
    """Rows wait until the watermark passes them; a route of which nothing was heard for ``keep_us`` is dropped."""

    def __init__(self, keep_us: int = DAY_US):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.route = handle.getValueState("route", "status string, plan_seconds long, plan_cost double, last_us long")
        self.stops = handle.getMapState("stops", "stop_id long", "status string, version int, completed_us long, reason string, sequence int, minutes int")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            arrived = _rows(frame)
            self.waiting.appendList([tuple(r) for r in arrived])
            times |= {-(-r.at_us // 1000) for r in arrived}
        for at in times:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [Row(*r) for r in self.waiting.get()]
        due = [r for r in waiting if r.at_us <= passed]
        known = self.route.get() if self.route.exists() else None
        if not due:
            if known and passed > known[3] + self.keep_us and not waiting:
                for state in (self.route, self.stops, self.waiting):
                    state.clear()
            return iter([])
        route = Route(*(known or ()))
        before = {k[0]: Stop(*v) for k, v in self.stops.iterator()} if known else {}
        route.stops = dict(before)
        out = _frame(_results(key[0], route, due, self.keep_us))
        self.waiting.clear()
        if left := [tuple(r) for r in waiting if r.at_us > passed]:
            self.waiting.appendList(left)
        for stop in before.keys() - route.stops.keys():
            self.stops.removeKey((stop,))
        for stop, state in route.stops.items():
            if before.get(stop) != state:
                self.stops.updateValue((stop,), tuple(state))
        self.route.update((route.status, route.plan_seconds, route.plan_cost, route.last_us))
        self.handle.registerTimer((route.last_us + self.keep_us) // 1000 + 1)
        return iter([out] if len(out) else [])

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Streams with maps and timers in their state need the RocksDB store; a running stream keeps the one it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def execute_routes(rows: DataFrame, delay: str = "10 minutes", keep_us: int = DAY_US) -> DataFrame:
    """Stream of outcomes of reports and of metrics of the routes they touch (``kind``), from :func:`inputs`.

    Reports on a route that is not published or in progress at their time, or on a stop it does not have, are refused. Rows later than
    ``delay`` behind the latest are dropped, as are rows without a time. Equal to :func:`replay_routes` over the rows that came in time,
    but that metrics come once for each step of the watermark, of which the last is the replay's.
    """
    use_keyed_state(rows.sparkSession)
    keyed = rows.withWatermark("at", delay).groupBy("route_id")
    return keyed.transformWithStateInPandas(RouteProcessor(keep_us), RESULT, "append", "eventTime")


def replay_routes(rows: DataFrame, keep_us: int = DAY_US) -> DataFrame:
    """The same in batch: all outcomes, and each route's metrics after its last report that was applied. A task streams through sorted rows and holds one route."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            out = []
            for route_id, row in zip(batch["route_id"].tolist(), _rows(batch)):
                if route_id != now:
                    out += _results(now, Route(), held, keep_us)
                    now, held = route_id, []
                held.append(row)
            if out:
                yield _frame(out)
        if held:
            yield _frame(_results(now, Route(), held, keep_us))

    ordered = rows.where("at IS NOT NULL AND route_id IS NOT NULL").drop("at").repartition("route_id")
    return ordered.sortWithinPartitions("route_id", "at_us", "rank", "event_id").mapInPandas(run, RESULT)


def outcomes(results: DataFrame) -> DataFrame:
    return results.where("kind = 'outcome'").select("route_id", "event_id", "stop_id", F.timestamp_micros("at_us").alias("at"), "outcome", "status", "version", "route_status")


def metrics(results: DataFrame) -> DataFrame:
    names = COLUMNS[COLUMNS.index("route_status") :]
    return results.where("kind = 'metrics'").select("route_id", F.timestamp_micros("at_us").alias("at"), *names)
