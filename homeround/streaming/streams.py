"""Structured Streaming: reports of single stops, notifications, report compaction. Whole routes: ``routes``; arriving files: ``imports``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


OUTCOME = "stop_id long, event_id long, outcome string, status string, version int"
STATE = "status string, version int, completed_at string, reason string"


def apply_report(state: tuple, report) -> tuple[tuple, str]:
    """(new state, outcome) of one report: version first, then replay, then the reason that ``failed`` needs."""
    status, version, at, reason = state
    if report.expected_version != version:
        return state, "conflict"
    given = report.failure_reason if report.status == "failed" else None
    if report.status == "failed" and not given:
        return state, "reason_required"
    new = (report.status, None if pd.isna(report.completed_at) else str(report.completed_at), given)
    if new == (status, at, reason):
        return state, "replay"
    return (new[0], version + 1, new[1], given), "applied"


def _fold(stop_id: int, rows: pd.DataFrame, state: tuple) -> tuple[list, tuple]:
    out = []
    for r in rows.sort_values(["reported_at", "event_id"]).itertuples():
        state, outcome = apply_report(state, r)
        out.append((stop_id, r.event_id, outcome, state[0], state[1]))
    return out, state


START = ("pending", 1, None, None)


def execute_reports(reports: DataFrame, delay: str = "1 day") -> DataFrame:
    """Outcome per report with the stop's state after it. State is per stop and ends a delay after the watermark passes its last report."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        out, new = _fold(key[0], rows, tuple(state.get) if state.exists else START)
        state.update(new)
        last = int(pd.Timestamp(rows["reported_at"].max()).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + 86_400_000)
        yield pd.DataFrame(out, columns=["stop_id", "event_id", "outcome", "status", "version"])

    keyed = reports.withWatermark("reported_at", delay).groupBy("stop_id")
    return keyed.applyInPandasWithState(run, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay_reports(reports: DataFrame) -> DataFrame:
    """The same outcomes in batch."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(key[0], rows, START)[0], columns=["stop_id", "event_id", "outcome", "status", "version"])

    return reports.groupBy("stop_id").applyInPandas(run, OUTCOME)


def notification_stream(events: DataFrame, types: dict[str, str], at: str = "ts", delay: str = "7 days") -> DataFrame:
    """One row an event and recipient, each once: an event that comes again within ``delay`` of its time changes nothing.

    What was sent is keyed state, dropped when the watermark has passed it, so nothing stored is read again; a file sink writes each batch once.
    """
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    rows = events.withWatermark(at, delay).withColumn("type", kind[F.col("event_type")]).where("type IS NOT NULL")
    each = rows.select("event_id", "type", at, F.explode(F.array_distinct("recipients")).alias("recipient_id"))
    return each.dropDuplicatesWithinWatermark(["event_id", "recipient_id"])


def last_report_per_stop(reports: DataFrame) -> DataFrame:
    """Compaction of queued reports: the last one of each stop."""
    w = Window.partitionBy("stop_id").orderBy(F.desc("reported_at"), F.desc("event_id"))
    return reports.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
