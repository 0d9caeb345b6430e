"""Calendar, capacity, placement and validation of monthly plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeround.operators.ranges import numbered

RURAL_BUFFER, DEFAULT_SERVICE, DAY_START = 15, 45, 480


def working_days(plans: DataFrame) -> DataFrame:
    """One row per working day of each plan's month: ISO weekday in the mask, no holiday, not off."""
    first = F.to_date(F.concat("period", F.lit("-01")))
    days = plans.select("*", F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    off = F.array_contains("holidays", F.col("date")) | F.array_contains("extra_off_days", F.col("date"))
    return days.where(F.array_contains("weekday_mask", F.weekday("date") + 1) & ~off)


def day_minutes() -> Column:
    window = F.greatest(F.col("window_end") - F.col("window_start"), F.lit(0))
    return F.when(F.col("window_start").isNull() | F.col("window_end").isNull(), F.col("workday_minutes")).otherwise(F.least("workday_minutes", window))


def with_capacity(days: DataFrame) -> DataFrame:
    """Minutes of the day, and visits that fit: at most ``max_visits``; a rural visit takes 15 minutes more."""
    service = F.col("service_minutes") + F.when(F.col("zone_kind") == "rural", RURAL_BUFFER).otherwise(0)
    days = days.withColumn("capacity_minutes", day_minutes())
    fits = F.when(service > 0, F.floor(F.col("capacity_minutes") / service)).otherwise(0).cast("int")
    return days.withColumn("capacity_visits", F.greatest(F.least(F.coalesce("max_visits", fits), fits), F.lit(0)))


def constraints_from_json(plans: DataFrame, payload: str = "payload") -> DataFrame:
    """Constraints with defaults for missing keys, and the first reason why they are invalid."""
    kind = "weekday_mask array<int>, holidays array<date>, extra_off_days array<date>, workday_minutes int, service_minutes int, max_visits int, zone_kind string"
    c = F.from_json(payload, kind)
    out = plans.select(
        "plan_id",
        F.coalesce(c["weekday_mask"], F.array(*[F.lit(i) for i in range(1, 6)])).alias("weekday_mask"),
        F.coalesce(c["holidays"], F.array().cast("array<date>")).alias("holidays"),
        F.coalesce(c["extra_off_days"], F.array().cast("array<date>")).alias("extra_off_days"),
        F.coalesce(c["workday_minutes"], F.lit(480)).alias("workday_minutes"),
        F.coalesce(c["service_minutes"], F.lit(DEFAULT_SERVICE)).alias("service_minutes"),
        c["max_visits"].alias("max_visits"),
        F.coalesce(c["zone_kind"], F.lit("urban")).alias("zone_kind"),
    )
    reason = (
        F.when((F.size("weekday_mask") == 0) | F.exists("weekday_mask", lambda d: (d < 1) | (d > 7)), "WEEKDAY_MASK")
        .when(F.col("workday_minutes") <= 0, "WORKDAY_MINUTES").when(F.col("service_minutes") <= 0, "SERVICE_MINUTES")
        .when(F.col("max_visits") < 1, "MAX_VISITS").when(~F.col("zone_kind").isin("urban", "rural", "mixed"), "ZONE_KIND")
    )
    return out.withColumn("invalid", reason)


def visit_requests(patients: DataFrame, addresses: DataFrame, history: DataFrame) -> DataFrame:
    """Active patients as visits, or the reason why not."""
    active = addresses.where("is_active").select("patient_id", "geocode_status")
    zone = history.where("valid_to is null").select("patient_id", "zone_id")
    rows = patients.where("status = 'active'").join(active, "patient_id", "left").join(zone, "patient_id", "left")
    confirmed = F.coalesce(F.col("geocode_status").isin("matched", "manual"), F.lit(False))
    return rows.withColumn("conflict", F.when(~confirmed, "ADDRESS_NOT_CONFIRMED").when(F.col("zone_id").isNull(), "UNSCHEDULABLE"))


def visit_service(visits_kind: Column, minutes: Column) -> Column:
    return F.coalesce(minutes, F.lit(DEFAULT_SERVICE)) + F.when(visits_kind == "rural", RURAL_BUFFER).otherwise(0)


#: Placement order of the visits of a plan.
ORDER = ("__late", "__length", "__rural", "zone_id", "patient_id")


def _marked(visits: DataFrame) -> DataFrame:
    """Visits with the conflict that keeps one out, unconfirmed first, then a repeated patient, and the columns of their order."""
    length = F.coalesce((F.col("window_end") - F.col("window_start")).cast("double"), F.lit(1e9))
    once = Window.partitionBy("plan_id", "patient_id").orderBy("zone_id")
    marked = visits.withColumn("__nth", F.when(F.col("geocode_confirmed"), F.count_if(F.col("geocode_confirmed")).over(once)))
    marked = marked.withColumn("conflict", F.when(~F.col("geocode_confirmed"), "ADDRESS_NOT_CONFIRMED").when(F.col("__nth") > 1, "DUPLICATE_PATIENT"))
    return marked.drop("__nth").withColumns({"__late": F.col("conflict").isNotNull(), "__length": length, "__rural": F.when(F.col("kind") == "rural", 0).otherwise(1)})


def visit_priority(visits: DataFrame) -> DataFrame:
    """Visits numbered in placement order per plan, with the conflict that keeps one out.

    A large plan is numbered by many tasks, see :func:`ranges.numbered`.
    """
    return numbered(_marked(visits), ["plan_id"], list(ORDER), "priority").drop(*ORDER[:3])


PLACED = "plan_id {plan}, patient_id {patient}, zone_id string, date date, code string"


class PlanDays:
    """The working days of one plan with what is left of each: one record a day, however many visits are placed."""

    def __init__(self) -> None:
        self.state: list[dict] = []

    def add(self, d) -> None:
        self.state.append(
            {
                "date": d.date, "visits": int(d.capacity_visits), "minutes": int(d.capacity_minutes), "cap": (int(d.capacity_visits), int(d.capacity_minutes)), "zones": set(), "placed": 0,
                "from": DAY_START if pd.isna(d.window_start) else int(d.window_start),
                "to": DAY_START + int(d.capacity_minutes) if pd.isna(d.window_end) else int(d.window_end),
                "off": getattr(d, "off", False) in (True, 1),
            }
        )

    def place(self, v) -> tuple:
        """(date, code): the open day of least (zone affinity, visits left or placed, date), or why there is none."""
        need = (DEFAULT_SERVICE if pd.isna(v.service_minutes) else int(v.service_minutes)) + (RURAL_BUFFER if v.kind == "rural" else 0)
        free = pd.isna(v.window_start) or pd.isna(v.window_end)
        fit = [s for s in self.state if free or (v.window_start < s["to"] and s["from"] < v.window_end)]
        there = [s for s in fit if not s["off"]]
        open_ = [s for s in there if s["visits"] >= 1 and s["minutes"] >= need]
        code = (
            "UNSCHEDULABLE" if not self.state else "WINDOW_OUTSIDE_WORKDAY" if not fit else "VISITOR_UNAVAILABLE" if not there
            else "CAPACITY_EXCEEDED" if all(need > s["cap"][1] or s["cap"][0] < 1 for s in there) else None if open_ else "UNSCHEDULABLE"
        )
        if code is not None:
            return None, code
        rank = lambda s: (0, s["visits"]) if v.zone_id in s["zones"] else (2 if s["placed"] else 1, s["placed"])
        best = min(open_, key=lambda s: (*rank(s), s["date"]))
        best["visits"] -= 1
        best["minutes"] -= need
        best["placed"] += 1
        best["zones"].add(v.zone_id)
        return best["date"], None


def place_plan(visits: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
    """One plan's visits in priority order."""
    plan = PlanDays()
    for d in days.sort_values("date").itertuples():
        plan.add(d)
    out = [(v.plan_id, v.patient_id, v.zone_id, *plan.place(v)) for v in visits.sort_values("priority").itertuples()]
    return pd.DataFrame(out, columns=["plan_id", "patient_id", "zone_id", "date", "code"])


def place_visits(visits: DataFrame, days: DataFrame) -> DataFrame:
    """Placement per plan. Conflicts found before placement are carried along.

    Days and visits of a plan meet by one shuffle and are sorted, days first; a task streams through its plans and holds one batch of rows and the
    days of one plan, so a plan of any size takes bounded memory. Plans run in parallel; inside one the order decides.
    """
    marked = _marked(visits)
    schema = PLACED.format(plan=visits.schema["plan_id"].dataType.simpleString(), patient=visits.schema["patient_id"].dataType.simpleString())
    day = [c for c in ("date", "capacity_visits", "capacity_minutes", "window_start", "window_end", "off") if c in days.columns]
    good = marked.where("conflict IS NULL").select("plan_id", F.lit(1).alias("__what"), *ORDER, "kind", "service_minutes", "window_start", "window_end")
    rows = days.select("plan_id", F.lit(0).alias("__what"), *day).unionByName(good, allowMissingColumns=True)
    rows = rows.repartition("plan_id").sortWithinPartitions("plan_id", "__what", "date", *ORDER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, plan = None, PlanDays()
        for batch in batches:
            out = []
            for r in batch.rename(columns={"__what": "what"}).itertuples(index=False):
                if r.plan_id != now:
                    now, plan = r.plan_id, PlanDays()
                if r.what == 0:
                    plan.add(r)
                else:
                    out.append((r.plan_id, r.patient_id, r.zone_id, *plan.place(r)))
            if out:
                made = pd.DataFrame(out, columns=["plan_id", "patient_id", "zone_id", "date", "code"])
                yield made.astype({"patient_id": batch["patient_id"].dropna().infer_objects().dtype if batch["patient_id"].dtype == object else "int64"})

    placed = rows.mapInPandas(run, schema)
    before = marked.where("conflict IS NOT NULL").select("plan_id", "patient_id", "zone_id", F.lit(None).cast("date").alias("date"), F.col("conflict").alias("code"))
    return placed.unionByName(before)


def plan_metrics(placed: DataFrame) -> DataFrame:
    return placed.groupBy("plan_id").agg(F.count_if(F.col("code").isNull()).alias("n_assigned"), F.count_if(F.col("code").isNotNull()).alias("n_conflicts"))


def conflict_counts(placed: DataFrame) -> DataFrame:
    return placed.where("code is not null").groupBy("plan_id", "code").agg(F.count("*").alias("n"))


def validate_assignments(assigned: DataFrame, visits: DataFrame, days: DataFrame) -> DataFrame:
    """Conflict code per assignment, null if it stands: repeated patient, day, unknown or unconfirmed visit, window, running capacity.

    Capacity is a fold over a day's visits by (zone, patient): one that does not fit uses nothing, so a later one may.
    """
    info = visits.select("plan_id", "patient_id", "kind", "geocode_confirmed", "service_minutes", F.col("window_start").alias("vs"), F.col("window_end").alias("ve"))
    rows = assigned.join(info, ["plan_id", "patient_id"], "left").join(days.select("plan_id", "date", "capacity_visits", "capacity_minutes", "window_start", "window_end"), ["plan_id", "date"], "left")
    nth = F.row_number().over(Window.partitionBy("plan_id", "patient_id").orderBy("date", "zone_id"))
    lo = F.coalesce("window_start", F.lit(DAY_START))
    hi = F.coalesce("window_end", F.lit(DAY_START) + F.col("capacity_minutes"))
    overlap = F.col("vs").isNull() | F.col("ve").isNull() | ((F.col("vs") < hi) & (lo < F.col("ve")))
    rows = rows.withColumn("__nth", nth).withColumn(
        "code",
        F.when(F.col("__nth") > 1, "DUPLICATE_PATIENT").when(F.col("capacity_minutes").isNull(), "NOT_A_WORKING_DAY").when(F.col("kind").isNull(), "UNKNOWN_VISIT")
        .when(~F.col("geocode_confirmed"), "ADDRESS_NOT_CONFIRMED").when(~overlap, "WINDOW_OUTSIDE_WORKDAY"),
    )
    need = visit_service(F.col("kind"), F.col("service_minutes"))
    good = rows.where("code is null").groupBy("plan_id", "date", "capacity_visits", "capacity_minutes").agg(F.array_sort(F.collect_list(F.struct("zone_id", "patient_id", need.alias("need")))).alias("v"))
    start = F.struct(F.col("capacity_visits").alias("visits"), F.col("capacity_minutes").alias("minutes"), F.slice(F.transform("v", lambda x: x["patient_id"]), 1, 0).alias("out"))

    def step(s, x):
        ok = (s["visits"] >= 1) & (s["minutes"] >= x["need"])
        return F.struct(
            (s["visits"] - ok.cast("int")).alias("visits"), (s["minutes"] - F.when(ok, x["need"]).otherwise(0)).alias("minutes"),
            F.when(ok, s["out"]).otherwise(F.concat(s["out"], F.array(x["patient_id"]))).alias("out"),
        )

    full = good.select("plan_id", "date", F.explode(F.aggregate("v", start, step, lambda s: s["out"])).alias("patient_id"), F.lit("CAPACITY_EXCEEDED").alias("__full"))
    done = rows.join(full, ["plan_id", "date", "patient_id"], "left")
    return done.select("plan_id", "patient_id", "date", "zone_id", F.coalesce("code", "__full").alias("code"))


def route_groups(placed: DataFrame) -> DataFrame:
    return placed.where("code is null").select("plan_id", "date", "zone_id").distinct()


def resolve_assignees(groups: DataFrame, chosen: DataFrame, members: DataFrame, creators: DataFrame) -> DataFrame:
    """Per (plan, zone): the explicit assignee if a member, else the plan's creator if a member, else a reason.

    A zone chosen twice, or one that the plan does not visit, gets its row with the reason and no assignee.
    """
    m = members.select("plan_id", F.col("user_id").alias("assignee"), F.lit(True).alias("__member")).distinct()
    asked = chosen.groupBy("plan_id", "zone_id").agg(F.count("*").alias("__times"), F.min("chosen").alias("chosen"))
    there = groups.select("plan_id", "zone_id", F.lit(True).alias("__there")).distinct()
    rows = there.join(asked, ["plan_id", "zone_id"], "full_outer").join(creators, "plan_id", "left")
    rows = rows.withColumn("assignee", F.coalesce("chosen", "creator")).join(m, ["plan_id", "assignee"], "left")
    reason = (
        F.when(F.col("__times") > 1, "DUPLICATE_ZONE_ASSIGNEE").when(F.col("__there").isNull(), "UNKNOWN_ZONE").when(F.col("__member").isNotNull(), F.lit(None))
        .when(F.col("chosen").isNotNull(), "ASSIGNEE_NOT_FOUND").otherwise("ASSIGNEE_REQUIRED")
    )
    return rows.withColumn("reason", reason).select("plan_id", "zone_id", F.when(F.col("reason").isNull(), F.col("assignee")).alias("assignee"), "reason")


def publish_payload(groups: DataFrame, assignees: DataFrame) -> DataFrame:
    rows = groups.join(assignees.select("plan_id", "zone_id", "assignee"), ["plan_id", "zone_id"], "left")
    return rows.groupBy("plan_id").agg(
        F.count("*").alias("routes"), F.array_join(F.sort_array(F.collect_set("assignee")), ",").alias("assignees"),
        F.count_distinct("date").alias("dates"), F.count_distinct("zone_id").alias("zones"),
    )


#: Why a plan's moves cannot be made, in the order in which it is asked.
MOVE_REASONS = ("PLAN_NOT_FOUND", "PLAN_PUBLISHED", "PLAN_NOT_DRAFT", "PLAN_VERSION_CONFLICT", "ZONE_NOT_FOUND", "PATIENT_NOT_IN_PLAN")


def move_visits(plans: DataFrame, placed: DataFrame, moves: DataFrame, zones: DataFrame, visits: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome per plan with moves, assignments after them).

    ``plans``: plan_id, status, version. ``moves``: plan_id, patient_id, date, zone_id, expected_version, confirm. ``zones``: plan_id,
    zone_id and kind, which a moved visit takes. A plan's moves are validated together with its other assignments. Without confirm they are
    tried only; with it they are made, and the version rises, if nothing speaks against them: ``reason`` is null and ``applied`` true.
    """
    keys = ["plan_id", "patient_id"]
    now = placed.where("code is null").select(*keys, "date", "zone_id")
    asked = moves.join(plans.select("plan_id", "status", "version"), "plan_id", "left")
    asked = asked.join(zones.select("plan_id", "zone_id", F.col("kind").alias("__kind"), F.lit(True).alias("__zone")), ["plan_id", "zone_id"], "left")
    asked = asked.join(now.select(*keys, F.col("zone_id").alias("__there")), keys, "left")
    against = (
        F.col("status").isNull(), F.col("status") == "published", F.col("status") != "draft", ~F.col("version").eqNullSafe(F.col("expected_version")), F.col("__zone").isNull(), F.col("__there").isNull()
    )
    code = F.coalesce(*[F.when(c, F.lit(name)) for c, name in zip(against, MOVE_REASONS)])
    asked = asked.withColumn("__code", code).withColumn("__rank", F.when(F.col("__code").isNotNull(), F.array_position(F.array(*map(F.lit, MOVE_REASONS)), F.col("__code"))))
    per = asked.groupBy("plan_id").agg(F.min_by("__code", "__rank").alias("reason"), F.bool_and("confirm").alias("confirm"), F.max("version").alias("version"), F.count("*").alias("moves"))
    sound = per.where("reason is null").select("plan_id")
    m = asked.join(sound, "plan_id", "left_semi").select(*keys, F.col("date").alias("__date"), F.col("zone_id").alias("__to"), "__kind")
    moved = now.join(sound, "plan_id", "left_semi").join(m, keys, "left")
    moved = moved.select(*keys, F.coalesce("__date", "date").alias("date"), F.coalesce("__to", "zone_id").alias("zone_id"))
    kinds = visits.join(m.select(*keys, "__kind"), keys, "left").withColumn("kind", F.coalesce("__kind", "kind")).drop("__kind")
    bad = validate_assignments(moved, kinds, days).groupBy("plan_id").agg(F.count("code").alias("conflicts"))
    out = per.join(bad, "plan_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("confirm") & (F.col("conflicts") > 0), "PLAN_MOVE_CONFLICT")))
    out = out.withColumn("applied", F.col("confirm") & F.col("reason").isNull())
    out = out.select("plan_id", "moves", "conflicts", "reason", "applied", (F.col("version") + F.col("applied").cast("int")).alias("version"))
    made = out.where("applied").select("plan_id")
    return out, now.join(made, "plan_id", "left_anti").unionByName(moved.join(made, "plan_id", "left_semi"))
