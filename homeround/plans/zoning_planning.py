"""Queries of zoning and planning over the domain views, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from homeround.functions import geo
from homeround.operators import planning as P
from homeround.operators import routing as R
from homeround.operators import zoning as Z

_E2 = "(2e0 / 298.257222101e0 - 1e0 / (298.257222101e0 * 298.257222101e0))"
PROJ_SQL = f"""k AS (SELECT *, {_E2} AS e2, {_E2} / (1 - {_E2}) AS ep, radians(latitude) AS phi, radians(longitude + 3) * cos(radians(latitude)) AS a FROM points), k2 AS (
  SELECT *, 6378137e0 / sqrt(1 - e2 * pow(sin(phi), 2)) AS nu, pow(tan(phi), 2) AS t, ep * pow(cos(phi), 2) AS c,
    6378137e0 * ((1 - e2/4 - 3*pow(e2,2)/64 - 5*pow(e2,3)/256) * phi - (3*e2/8 + 3*pow(e2,2)/32 + 45*pow(e2,3)/1024) * sin(2*phi) + (15*pow(e2,2)/256 + 45*pow(e2,3)/1024) * sin(4*phi) - 35*pow(e2,3)/3072 * sin(6*phi)) AS mm FROM k), proj AS (
  SELECT *, 500000 + 0.9996e0 * nu * (a + (1-t+c)*pow(a,3)/6 + (5-18*t+t*t+72*c-58*ep)*pow(a,5)/120) AS x,
    0.9996e0 * (mm + nu * tan(phi) * (pow(a,2)/2 + (5-t+9*c+4*c*c)*pow(a,4)/24 + (61-58*t+t*t+600*c-330*ep)*pow(a,6)/720)) AS y FROM k2)"""
DENSE_SQL = PROJ_SQL + """, dense AS (SELECT p.organization_id, p.point_id, p.x, p.y, p.municipality_kind, p.longitude, p.latitude, count(*) AS density FROM proj p JOIN proj q ON p.organization_id = q.organization_id AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) <= 250000 GROUP BY ALL), feats AS (
  SELECT *, CASE WHEN municipality_kind IS NOT NULL THEN municipality_kind WHEN density >= 4 THEN 'urban' ELSE 'rural' END AS kind,
    2 * 6371000e0 * asin(least(1, sqrt(pow(sin(radians(43.263e0 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(43.263e0)) * pow(sin(radians(-2.9348e0 - longitude) / 2), 2)))) AS far FROM dense)"""
DAYS_SQL = """d AS (SELECT c.*, CAST(unnest(generate_series(CAST(period || '-01' AS DATE), last_day(CAST(period || '-01' AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date FROM constraints c), days AS (
  SELECT plan_id, date, CASE WHEN window_start IS NULL THEN workday_minutes ELSE least(workday_minutes, window_end - window_start) END AS capacity_minutes, service_minutes, max_visits, zone_kind FROM d
  WHERE isodow(date) <= 5 AND isodow(date) <> off_weekday AND day(date) <> 6 AND (plan_id >= 18 OR day(date) <> 10 + plan_id))"""
ASSIGNED_SQL = "assigned AS (SELECT plan_id, patient_id, zone_id, make_date(2026, 1 + plan_id % 12, CAST(1 + patient_id % 28 AS INT)) AS date FROM visits)"


#: Placement visit by visit: the state is a list of days. ``@DAYS@`` says which days there are.
PLACE_SQL = DAYS_SQL + """, st AS (
  SELECT plan_id, list({'date': date, 'v': least(max_visits, capacity_minutes // (d.service_minutes + CASE zone_kind WHEN 'rural' THEN 15 ELSE 0 END)), 'm': capacity_minutes,
    'cv': least(max_visits, capacity_minutes // (d.service_minutes + CASE zone_kind WHEN 'rural' THEN 15 ELSE 0 END)), 'cm': capacity_minutes, 'z': CAST([] AS VARCHAR[]), 'p': 0,
    'lo': coalesce(window_start, 480), 'hi': coalesce(window_end, 480 + capacity_minutes)} ORDER BY date) AS s
  FROM days d JOIN (SELECT plan_id, window_start, window_end FROM constraints) USING (plan_id) WHERE @DAYS@ GROUP BY plan_id
), v AS (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY coalesce(window_end - window_start, 1000000000), CASE kind WHEN 'rural' THEN 0 ELSE 1 END, zone_id, patient_id) AS n,
    coalesce(service_minutes, 45) + CASE kind WHEN 'rural' THEN 15 ELSE 0 END AS need
  FROM visits WHERE geocode_confirmed
), run AS (
  SELECT plan_id, CAST(0 AS BIGINT) AS n, s, CAST(NULL AS BIGINT) AS patient_id, CAST(NULL AS VARCHAR) AS zone_id, CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS code
  FROM (SELECT DISTINCT plan_id FROM v) LEFT JOIN st USING (plan_id)
  UNION ALL
  SELECT plan_id, n, list_transform(s, lambda x: CASE WHEN code IS NULL AND x.date = best.date
      THEN {'date': x.date, 'v': x.v - 1, 'm': x.m - need, 'cv': x.cv, 'cm': x.cm, 'z': list_append(x.z, zone_id), 'p': x.p + 1, 'lo': x.lo, 'hi': x.hi} ELSE x END) AS s,
    patient_id, zone_id, CASE WHEN code IS NULL THEN best.date END AS date, code
  FROM (
    SELECT *, CASE WHEN s IS NULL THEN 'UNSCHEDULABLE' WHEN len(fit) = 0 THEN 'WINDOW_OUTSIDE_WORKDAY' WHEN len(list_filter(fit, lambda x: NOT (need > x.cm OR x.cv < 1))) = 0 THEN 'CAPACITY_EXCEEDED' WHEN len(ways) = 0 THEN 'UNSCHEDULABLE' END AS code,
      list_sort(ways)[1] AS best
    FROM (
      SELECT *, list_transform(list_filter(fit, lambda x: x.v >= 1 AND x.m >= need),
        lambda x: {'a': CASE WHEN list_contains(x.z, zone_id) THEN 0 WHEN x.p > 0 THEN 2 ELSE 1 END, 'b': CASE WHEN list_contains(x.z, zone_id) THEN x.v ELSE x.p END, 'date': x.date}) AS ways
      FROM (
        SELECT r.plan_id, v.n, r.s, v.patient_id, v.zone_id, v.need,
          list_filter(r.s, lambda x: v.window_start IS NULL OR v.window_end IS NULL OR (v.window_start < x.hi AND x.lo < v.window_end)) AS fit
        FROM run r JOIN v ON v.plan_id = r.plan_id AND v.n = r.n + 1))))
, placed AS (
  SELECT plan_id, patient_id, zone_id, CAST(date AS VARCHAR) AS date, code FROM run WHERE n > 0
  UNION ALL SELECT plan_id, patient_id, zone_id, NULL, 'ADDRESS_NOT_CONFIRMED' FROM visits WHERE NOT geocode_confirmed
)"""


#: Few working days, and none at all in some plans, so that visits are left over.
FEW = "day(date) <= 5 + plan_id % 4 AND plan_id % 9 <> 0"


def _plans(v):
    day = lambda n: F.to_date(F.concat("period", F.lit("-"), F.lpad(n.cast("string"), 2, "0")))
    return v("constraints").withColumns(
        {
            "weekday_mask": F.filter(F.array(*[F.lit(i) for i in range(1, 6)]), lambda d: d != F.col("off_weekday")),
            "holidays": F.array(day(F.lit(6))),
            "extra_off_days": F.when(F.col("plan_id") < 18, F.array(day(10 + F.col("plan_id")))).otherwise(F.array().cast("array<date>")),
        }
    )


def _days(v):
    return P.with_capacity(P.working_days(_plans(v)))


def _assigned(v):
    return v("visits").select("plan_id", "patient_id", "zone_id", F.make_date(F.lit(2026), 1 + F.col("plan_id") % 12, (1 + F.col("patient_id") % 28).cast("int")).alias("date"))


def _features(v):
    return Z.features(v("points"))


def _placed(v):
    return P.place_visits(v("visits"), _days(v))


def _proposal(v):
    return v("patients").where("patient_id % 13 <> 0").select("organization_id", "patient_id", F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))), (1 + F.col("patient_id") % 4).cast("int")).alias("zone_id"))


def _assignees(v):
    chosen = v("visits").where("patient_id % 3 = 0").groupBy("plan_id", "zone_id").agg(F.max("patient_id").alias("chosen"))
    plans = v("nation").select(F.col("n_nationkey").alias("plan_id"))
    twice = plans.where("plan_id % 5 = 0").select("plan_id", F.lit("2-HIGH").alias("zone_id"), F.explode(F.array(F.lit(2).cast("long"), F.lit(4).cast("long"))).alias("chosen"))
    chosen = chosen.where("plan_id % 5 <> 0 or zone_id <> '2-HIGH'").union(twice).union(plans.select("plan_id", F.lit("9-NONE").alias("zone_id"), F.lit(2).cast("long").alias("chosen")))
    members = v("customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("plan_id"), F.col("c_custkey").alias("user_id"))
    creators = v("customer").groupBy(F.col("c_nationkey").alias("plan_id")).agg(F.min("c_custkey").alias("creator"))
    return P.resolve_assignees(v("visits"), chosen, members, creators)


ASSIGNEES_SQL = """g AS (SELECT DISTINCT plan_id, zone_id, true AS there FROM visits), ch AS (SELECT plan_id, zone_id, max(patient_id) AS chosen, 1 AS times FROM visits WHERE patient_id % 3 = 0 AND (plan_id % 5 <> 0 OR zone_id <> '2-HIGH') GROUP BY 1, 2
 UNION ALL SELECT n_nationkey, '2-HIGH', 2, 2 FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, '9-NONE', 2, 1 FROM nation), cr AS (SELECT c_nationkey AS plan_id, min(c_custkey) AS creator FROM customer GROUP BY ALL),
 asg0 AS (SELECT plan_id, zone_id, coalesce(chosen, creator) AS a, CASE WHEN times > 1 THEN 'DUPLICATE_ZONE_ASSIGNEE' WHEN there IS NULL THEN 'UNKNOWN_ZONE' WHEN coalesce(chosen, creator) IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey = plan_id) THEN NULL WHEN chosen IS NOT NULL THEN 'ASSIGNEE_NOT_FOUND' ELSE 'ASSIGNEE_REQUIRED' END AS reason
  FROM g FULL JOIN ch USING (plan_id, zone_id) LEFT JOIN cr USING (plan_id)), asg AS (SELECT plan_id, zone_id, CASE WHEN reason IS NULL THEN a END AS assignee, reason FROM asg0)"""


def _json_plans(v):
    return v("nation").select(
        F.col("n_nationkey").alias("plan_id"),
        F.concat(F.lit('{"workday_minutes": '), 60 * (F.col("n_nationkey") % 9), F.when(F.col("n_nationkey") % 2 == 0, F.lit(', "zone_kind": "rural"')).otherwise(F.lit(', "weekday_mask": [1, 8]')), F.lit("}")).alias("payload"),
    )


def _zone_rows(members):
    named = Z.label_clusters(members.where("cluster is not null")).select("organization_id", "cluster", F.col("label").alias("zone"))
    return members.join(named, ["organization_id", "cluster"], "left").select("organization_id", "point_id", "kind", "zone")


def _cohesion(v):
    members = Z.border_areas(Z.cluster_points(_features(v), 12))
    where = v("points").select("organization_id", "point_id", "longitude", "latitude")
    nodes = members.join(where, ["organization_id", "point_id"]).select(F.struct("organization_id", "area").alias("route_id"), F.col("point_id").alias("node"), "longitude", "latitude")
    pairs = R.geodesic_matrix(nodes).where("i <> j").select("route_id.*", "i", "j", "duration_s")
    return Z.apply_cohesion(members, pairs, 12)


def _gaps(v):
    """Points, some without municipality, postal code or place."""
    lost = lambda k, c: F.when(F.col("point_id") % k != 0, F.col(c))
    return v("points").withColumns({"municipality": lost(17, "municipality"), "postal_code": lost(34, "postal_code"), "longitude": lost(19, "longitude")})


def _moves(v):
    """What-if and confirmed moves of one visit a plan, of plans in several states."""
    plans = v("constraints").select("plan_id", F.when(F.col("plan_id") % 9 == 4, "published").otherwise("draft").alias("status"), (1 + F.col("plan_id") % 3).alias("version"))
    moves = v("visits").groupBy("plan_id").agg(F.min("patient_id").alias("patient_id")).select(
        "plan_id", "patient_id", F.make_date(F.lit(2026), (1 + F.col("plan_id") % 12).cast("int"), F.lit(15)).alias("date"), F.when(F.col("plan_id") % 7 == 5, "9-NONE").otherwise("2-HIGH").alias("zone_id"),
        F.when(F.col("plan_id") % 5 == 3, 0).otherwise(1 + F.col("plan_id") % 3).alias("expected_version"), (F.col("plan_id") % 2 == 0).alias("confirm"),
    )
    zones = plans.select("plan_id", F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))).alias("zone_id"), F.lit("urban").alias("kind"))
    return P.move_visits(plans, _placed(v), moves, zones, v("visits"), _days(v))[0]


def _catalogue(v):
    """Kinds of two in three towns; half of the names in lower case."""
    towns = v("points").groupBy("municipality").agg(F.substring_index(F.max("municipality"), " ", -1).cast("int").alias("no")).where("no % 3 <> 2")
    return towns.select(F.when(F.col("no") % 2 == 0, F.col("municipality")).otherwise(F.lower("municipality")).alias("municipality"), F.when(F.col("no") % 3 == 0, "urban").otherwise("rural").alias("kind"))


def _by_town(v):
    """Points that have a neighbour belong to their town's cluster; lone ones are outliers."""
    return _features(v).withColumn("cluster", F.when(F.col("density") > 1, F.col("municipality")))


def _overrides(v):
    zones = Z.occupancy(v("zones"), v("zone_history"))
    current = v("zone_history").where("valid_to is null").withColumn("row_version", F.lit(1))
    asked = v("patients").where("patient_id % 4 = 1").select(F.col("patient_id").alias("request_no"), "organization_id", "patient_id",
        F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "9-NONE"))), (1 + F.col("patient_id") % 3).cast("int")).alias("zone_id"), F.when(F.col("patient_id") % 5 != 0, "moved").alias("reason"), F.when(F.col("patient_id") % 7 == 0, 0).otherwise(1).alias("expected_version"))
    return Z.override_batch(asked, current, zones)


QUERIES = {
    "confirmed_points": (lambda v: Z.confirmed_points(v("addresses")).select("address_id"), "WITH k AS (SELECT * FROM addresses WHERE is_active AND geocode_status IN ('matched', 'manual') AND longitude IS NOT NULL) SELECT address_id FROM k WHERE organization_id IN (SELECT organization_id FROM k GROUP BY 1 HAVING count(*) >= 2)"),
    "project_points": (lambda v: Z.projected(v("points")).select("point_id", F.bround("x", 3).alias("x"), F.bround("y", 3).alias("y")), f"WITH {PROJ_SQL} SELECT point_id, round_even(x, 3) AS x, round_even(y, 3) AS y FROM proj"),
    "point_features": (lambda v: _features(v).select("point_id", "density", "kind", F.bround("depot_distance_m", 3).alias("depot_m"), F.bround("depot_time_minutes", 4).alias("depot_minutes")),
        f"WITH {DENSE_SQL} SELECT point_id, density, kind, round_even(far, 3) AS depot_m, round_even(far / 1000 / CASE kind WHEN 'urban' THEN 20 ELSE 35 END * 60, 4) AS depot_minutes FROM feats"),
    "admin_seeds": (lambda v: Z.admin_seeds(Z.projected(v("points")), 2), f"""WITH {PROJ_SQL}, m AS (SELECT organization_id, municipality, count(*) AS n FROM proj GROUP BY ALL), md AS (SELECT p.organization_id, p.municipality, max(sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2))) AS dia FROM proj p JOIN proj q USING (organization_id, municipality) GROUP BY ALL),
 c AS (SELECT organization_id, municipality, postal_code, count(*) AS n FROM proj GROUP BY ALL), cd AS (SELECT p.organization_id, p.municipality, p.postal_code, max(sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2))) AS dia FROM proj p JOIN proj q USING (organization_id, municipality, postal_code) GROUP BY ALL)
 SELECT organization_id, point_id, CASE WHEN m.n <= 2 AND md.dia <= 12000 THEN municipality WHEN m.n > 2 AND c.n <= 2 AND cd.dia <= 12000 THEN municipality || '/' || postal_code END AS seed FROM proj JOIN m USING (organization_id, municipality) JOIN md USING (organization_id, municipality) JOIN c USING (organization_id, municipality, postal_code) JOIN cd USING (organization_id, municipality, postal_code)"""),
    "rural_groups": (lambda v: Z.rural_groups(_features(v).where("kind = 'rural'")), f"""WITH RECURSIVE {DENSE_SQL}, r AS (SELECT organization_id, point_id, x, y FROM feats WHERE kind = 'rural'), e AS (SELECT p.organization_id, p.point_id AS a, q.point_id AS b FROM r p JOIN r q ON p.organization_id = q.organization_id AND p.point_id <> q.point_id AND pow(p.x-q.x,2)+pow(p.y-q.y,2) <= 6250000), w AS (SELECT DISTINCT a, a AS l FROM e UNION SELECT e.a, w.l FROM w JOIN e ON e.b = w.a), g AS (SELECT a, min(l) AS l FROM w GROUP BY a) SELECT organization_id, point_id, g.l AS "group" FROM r LEFT JOIN g ON g.a = r.point_id"""),
    "cluster_points": (lambda v: Z.label_clusters(Z.cluster_points(_features(v), 6)), None),
    "zone_hulls": (lambda v: Z.zone_hulls(Z.cluster_points(_features(v), 12)), None),
    "propose_zones": (lambda v: _zone_rows(Z.propose_zones(_features(v), 6)), None),
    "fit_target_zones": (lambda v: _zone_rows(Z.propose_zones(_features(v), 12, 20)), None),
    "border_cohesion": (_cohesion, None),
    "catalogue_hints": (lambda v: Z.catalogue_hint(v("points"), _catalogue(v)).select("point_id", "municipality_kind"),
        """SELECT point_id, coalesce(municipality_kind, CASE c % 3 WHEN 0 THEN 'urban' WHEN 1 THEN 'rural' END) AS municipality_kind FROM (SELECT *, CAST(substr(municipality, 6) AS INT) AS c FROM points)"""),
    "cluster_summary": (lambda v: Z.cluster_summary(_by_town(v)), f"WITH {DENSE_SQL}, mem AS (SELECT f.*, p.municipality AS cluster FROM feats f JOIN points p USING (organization_id, point_id) WHERE density > 1) SELECT organization_id, cluster, count(*) AS n, round_even(avg(longitude), 6) AS longitude, round_even(avg(latitude), 6) AS latitude, round_even(avg(x), 3) AS x, round_even(avg(y), 3) AS y, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind FROM mem GROUP BY 1, 2"),
    "proposal_summary": (lambda v: Z.proposal_summary(_by_town(v)), f"WITH {DENSE_SQL}, sz AS (SELECT organization_id, CASE WHEN density > 1 THEN p.municipality END AS cluster, count(*) AS n FROM feats f JOIN points p USING (organization_id, point_id) GROUP BY 1, 2) SELECT organization_id, CAST(sum(n) AS BIGINT) AS n_points, count(cluster) AS n_clusters, CAST(coalesce(sum(n) FILTER (cluster IS NULL), 0) AS BIGINT) AS n_outliers, coalesce(max(n) FILTER (cluster IS NOT NULL), 0) AS max_size FROM sz GROUP BY 1"),
    "mean_pair_minutes": (lambda v: Z.mean_pair_minutes(v("arcs"), v("stops").select("route_id", F.col("sequence").alias("node"), (F.col("patient_id") % 2).alias("cluster"))),
        "WITH mem AS (SELECT route_id, sequence, patient_id % 2 AS c FROM stops), ins AS (SELECT e.route_id, sum(duration_s) / count(*) / 60 AS m FROM arcs e JOIN mem x ON x.route_id = e.route_id AND x.sequence = e.i JOIN mem y ON y.route_id = e.route_id AND y.sequence = e.j WHERE x.c = y.c GROUP BY 1) SELECT DISTINCT s.route_id, round_even(coalesce(m, 0), 6) AS minutes FROM stops s LEFT JOIN ins ON ins.route_id = s.route_id"),
    "zone_occupancy": (lambda v: Z.occupancy(v("zones"), v("zone_history")).select("organization_id", "zone_id", "occupied", "over_capacity"),
        "SELECT organization_id, zone_id, count(h.patient_id) AS occupied, count(h.patient_id) > max_visits AS over_capacity FROM zones z LEFT JOIN (SELECT * FROM zone_history WHERE valid_to IS NULL) h USING (organization_id, zone_id) GROUP BY organization_id, zone_id, max_visits"),
    "accept_proposal": (lambda v: Z.accept_proposal(v("zone_history").where("valid_to is null"), _proposal(v)).select("organization_id", "patient_id", "old_zone", "new_zone", "action"),
        """WITH n AS (SELECT organization_id, patient_id, zone_id, source FROM zone_history WHERE valid_to IS NULL), p AS (SELECT organization_id, patient_id, CASE patient_id % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE '5-LOW' END AS zone_id FROM patients WHERE patient_id % 13 <> 0)
 SELECT organization_id, patient_id, n.zone_id AS old_zone, p.zone_id AS new_zone, CASE WHEN n.zone_id IS NULL THEN 'open' WHEN source = 'manual' THEN 'preserve_manual' WHEN p.zone_id IS NULL THEN 'close' WHEN n.zone_id = p.zone_id THEN 'keep' ELSE 'move' END AS action FROM n FULL JOIN p USING (organization_id, patient_id)"""),
    "apply_proposal": (lambda v: Z.apply_proposal(v("zone_history"), _proposal(v), F.to_timestamp_ntz(F.lit("2024-01-01"))).select("organization_id", "patient_id", "zone_id", "source", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to")),
        """WITH p AS (SELECT organization_id, patient_id, CASE patient_id % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE '5-LOW' END AS new_zone FROM patients WHERE patient_id % 13 <> 0), j AS (SELECT h.*, p.new_zone, h.valid_to IS NULL AND source <> 'manual' AND (new_zone IS NULL OR new_zone <> zone_id) AS ends FROM zone_history h LEFT JOIN p USING (organization_id, patient_id))
 SELECT organization_id, patient_id, zone_id, source, strftime(valid_from, '%Y-%m-%d') AS valid_from, CASE WHEN ends THEN '2024-01-01' ELSE strftime(valid_to, '%Y-%m-%d') END AS valid_to FROM j UNION ALL
 SELECT organization_id, patient_id, new_zone, 'cluster', '2024-01-01', NULL FROM j WHERE ends AND new_zone IS NOT NULL UNION ALL
 SELECT organization_id, patient_id, new_zone, 'cluster', '2024-01-01', NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM zone_history h WHERE h.patient_id = p.patient_id AND h.organization_id = p.organization_id AND valid_to IS NULL)"""),
    "upsert_zones": (lambda v: Z.upsert_zones(*[v("zones").withColumns({"kind": kind, "longitude": F.lit(0.0) + F.col("organization_id") + x, "latitude": F.lit(43.0)}).where(f"organization_id % {k} = 0") for k, x, kind in ((2, 0, F.col("kind")), (3, 1, F.lit("odd")))]),
        "SELECT organization_id, name, CASE WHEN organization_id % 3 = 0 THEN 'mixed' ELSE kind END AS kind, max_visits, CAST(organization_id + CASE WHEN organization_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS longitude, 43e0 AS latitude, CAST((CASE WHEN organization_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN organization_id % 3 = 0 THEN 1 ELSE 0 END) AS INT) AS version FROM zones WHERE organization_id % 2 = 0 OR organization_id % 3 = 0"),
    "override_batch": (lambda v: _overrides(v).select("patient_id", "zone_id", "rejected"),
        """WITH cur AS (SELECT organization_id, patient_id, zone_id AS from_zone FROM zone_history WHERE valid_to IS NULL), occ AS (SELECT organization_id, zone_id, count(*) AS n FROM zone_history WHERE valid_to IS NULL GROUP BY ALL), q AS (SELECT p.organization_id, p.patient_id, CASE p.patient_id % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '9-NONE' END AS zone_id FROM patients p WHERE p.patient_id % 4 = 1), r AS (
 SELECT q.*, from_zone, z.max_visits, coalesce(occ.n, 0) AS n, CASE WHEN q.patient_id % 5 = 0 THEN 'REASON_REQUIRED' WHEN from_zone IS NULL OR q.patient_id % 7 = 0 THEN 'STALE_VERSION' WHEN z.max_visits IS NULL THEN 'ZONE_UNKNOWN' END AS bad FROM q LEFT JOIN cur USING (organization_id, patient_id) LEFT JOIN zones z ON z.organization_id = q.organization_id AND z.zone_id = q.zone_id LEFT JOIN occ ON occ.organization_id = q.organization_id AND occ.zone_id = q.zone_id), s AS (
 SELECT *, CASE WHEN bad IS NULL AND zone_id <> from_zone THEN 1 ELSE 0 END AS ent, sum(CASE WHEN bad IS NULL AND zone_id <> from_zone THEN 1 ELSE 0 END) OVER (PARTITION BY organization_id, zone_id ORDER BY patient_id) AS run FROM r) SELECT patient_id, zone_id, coalesce(bad, CASE WHEN ent = 1 AND n + run > max_visits THEN 'CAPACITY_EXCEEDED' END) AS rejected FROM s"""),
    "admin_fallback": (lambda v: Z.geodesic_split(_gaps(v), 12).withColumn("zone", F.regexp_replace("zone", "/[0-9:-]*:[0-9]+$", "/part")), """WITH q AS (SELECT organization_id, point_id, CASE WHEN point_id % 17 = 0 THEN '' ELSE municipality END AS town, CASE WHEN point_id % 34 = 0 THEN '' ELSE postal_code END AS code FROM points WHERE point_id % 19 <> 0), t AS (
 SELECT *, CASE WHEN town <> '' THEN count(*) OVER (PARTITION BY organization_id, town) END AS tn, count(*) OVER (PARTITION BY organization_id, town, code) AS cn FROM q)
 SELECT organization_id, point_id, CASE WHEN town = '' AND code = '' THEN NULL WHEN tn <= 12 THEN town WHEN cn <= 12 THEN town || '/' || code ELSE town || '/' || code || '/part' END AS zone FROM t"""),
    "polygon_wkt": (lambda v: v("points").select("point_id", geo.polygon_wkt(F.array(F.expr("transform(sequence(1, cast(2 + point_id % 3 as int)), i -> struct(cast(i * point_id as int) as lon, cast(i * i as int) as lat))"))).alias("wkt")),
        "SELECT point_id, CASE point_id % 3 WHEN 1 THEN format('MULTIPOLYGON ((({0} 1, {1} 4, {2} 9, {0} 1)))', point_id, 2 * point_id, 3 * point_id) WHEN 2 THEN format('MULTIPOLYGON ((({0} 1, {1} 4, {2} 9, {3} 16, {0} 1)))', point_id, 2 * point_id, 3 * point_id, 4 * point_id) END AS wkt FROM points"),
    "working_days": (lambda v: _days(v).select("plan_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "capacity_minutes", "capacity_visits"),
        f"WITH {DAYS_SQL} SELECT plan_id, CAST(date AS STRING) AS date, capacity_minutes, CAST(least(max_visits, capacity_minutes // (service_minutes + CASE zone_kind WHEN 'rural' THEN 15 ELSE 0 END)) AS INT) AS capacity_visits FROM days"),
    "constraints_from_json": (lambda v: P.constraints_from_json(_json_plans(v)).select("plan_id", F.array_join("weekday_mask", ",").alias("mask"), "workday_minutes", "service_minutes", "zone_kind", "invalid"),
        "SELECT n_nationkey AS plan_id, CASE WHEN n_nationkey % 2 = 0 THEN '1,2,3,4,5' ELSE '1,8' END AS mask, 60 * (n_nationkey % 9) AS workday_minutes, 45 AS service_minutes, CASE WHEN n_nationkey % 2 = 0 THEN 'rural' ELSE 'urban' END AS zone_kind, CASE WHEN n_nationkey % 2 = 1 THEN 'WEEKDAY_MASK' WHEN n_nationkey % 9 = 0 THEN 'WORKDAY_MINUTES' END AS invalid FROM nation"),
    "visit_requests": (lambda v: P.visit_requests(v("patients"), v("addresses"), v("zone_history")).select("patient_id", "zone_id", "conflict"),
        "SELECT p.patient_id, h.zone_id, CASE WHEN NOT coalesce(a.geocode_status IN ('matched', 'manual'), false) THEN 'ADDRESS_NOT_CONFIRMED' WHEN h.zone_id IS NULL THEN 'UNSCHEDULABLE' END AS conflict FROM patients p LEFT JOIN addresses a ON a.patient_id = p.patient_id AND a.is_active LEFT JOIN zone_history h ON h.patient_id = p.patient_id AND h.valid_to IS NULL WHERE p.status = 'active'"),
    "visit_priority": (lambda v: P.visit_priority(v("visits")).select("patient_id", "conflict", "priority"),
        "SELECT patient_id, CASE WHEN NOT geocode_confirmed THEN 'ADDRESS_NOT_CONFIRMED' END AS conflict, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY NOT geocode_confirmed, coalesce(window_end - window_start, 1000000000), CASE kind WHEN 'rural' THEN 0 ELSE 1 END, zone_id, patient_id) AS INT) AS priority FROM visits"),
    "place_visits": (lambda v: _placed(v).withColumn("date", F.date_format("date", "yyyy-MM-dd")), "WITH RECURSIVE " + PLACE_SQL.replace("@DAYS@", "true") + " SELECT * FROM placed"),
    "place_visits_in_few_days": (lambda v: P.place_visits(v("visits"), _days(v).where(FEW)).withColumn("date", F.date_format("date", "yyyy-MM-dd")), f"WITH RECURSIVE {PLACE_SQL.replace('@DAYS@', FEW)} SELECT * FROM placed"),
    "plan_metrics": (lambda v: P.plan_metrics(P.place_visits(v("visits"), _days(v).where(FEW))), f"WITH RECURSIVE {PLACE_SQL.replace('@DAYS@', FEW)} SELECT plan_id, count(*) FILTER (code IS NULL) AS n_assigned, count(*) FILTER (code IS NOT NULL) AS n_conflicts FROM placed GROUP BY 1"),
    "plan_conflicts": (lambda v: P.conflict_counts(P.place_visits(v("visits"), _days(v).where(FEW))), f"WITH RECURSIVE {PLACE_SQL.replace('@DAYS@', FEW)} SELECT plan_id, code, count(*) AS n FROM placed WHERE code IS NOT NULL GROUP BY 1, 2"),
    "validate_assignments": (lambda v: P.validate_assignments(_assigned(v), v("visits"), _days(v)).withColumn("date", F.date_format("date", "yyyy-MM-dd")),
        f"""WITH RECURSIVE {DAYS_SQL}, {ASSIGNED_SQL}, capd AS (SELECT plan_id, date, capacity_minutes, least(max_visits, capacity_minutes // (service_minutes + CASE zone_kind WHEN 'rural' THEN 15 ELSE 0 END)) AS capacity_visits FROM days), r AS (
 SELECT a.plan_id, a.patient_id, a.date, a.zone_id, c.capacity_minutes, c.capacity_visits, v.service_minutes + CASE v.kind WHEN 'rural' THEN 15 ELSE 0 END AS need, CASE WHEN c.capacity_minutes IS NULL THEN 'NOT_A_WORKING_DAY' WHEN NOT v.geocode_confirmed THEN 'ADDRESS_NOT_CONFIRMED' WHEN NOT (v.window_start IS NULL OR v.window_start < coalesce(k.window_end, 480 + c.capacity_minutes) AND coalesce(k.window_start, 480) < v.window_end) THEN 'WINDOW_OUTSIDE_WORKDAY' END AS code
 FROM assigned a JOIN visits v USING (plan_id, patient_id) LEFT JOIN capd c USING (plan_id, date) JOIN constraints k USING (plan_id)), o AS (SELECT *, row_number() OVER (PARTITION BY plan_id, date ORDER BY zone_id, patient_id) AS n FROM r WHERE code IS NULL), f AS (
 SELECT plan_id, date, patient_id, n, capacity_visits >= 1 AND capacity_minutes >= need AS fit, capacity_visits - CASE WHEN capacity_visits >= 1 AND capacity_minutes >= need THEN 1 ELSE 0 END AS vis, capacity_minutes - CASE WHEN capacity_visits >= 1 AND capacity_minutes >= need THEN need ELSE 0 END AS mins FROM o WHERE n = 1
 UNION ALL SELECT o.plan_id, o.date, o.patient_id, o.n, f.vis >= 1 AND f.mins >= o.need, f.vis - CASE WHEN f.vis >= 1 AND f.mins >= o.need THEN 1 ELSE 0 END, f.mins - CASE WHEN f.vis >= 1 AND f.mins >= o.need THEN o.need ELSE 0 END FROM f JOIN o ON o.plan_id = f.plan_id AND o.date = f.date AND o.n = f.n + 1)
 SELECT r.plan_id, r.patient_id, CAST(r.date AS STRING) AS date, r.zone_id, coalesce(r.code, CASE WHEN NOT f.fit THEN 'CAPACITY_EXCEEDED' END) AS code FROM r LEFT JOIN f ON f.plan_id = r.plan_id AND f.date = r.date AND f.patient_id = r.patient_id"""),
    "daily_route_groups": (lambda v: P.route_groups(_assigned(v).withColumn("code", F.lit(None).cast("string"))).withColumn("date", F.date_format("date", "yyyy-MM-dd")), f"WITH {ASSIGNED_SQL} SELECT DISTINCT plan_id, CAST(date AS STRING) AS date, zone_id FROM assigned"),
    "resolve_assignees": (_assignees, f"WITH {ASSIGNEES_SQL} SELECT * FROM asg"),
    "publish_payload": (lambda v: P.publish_payload(P.route_groups(_assigned(v).withColumn("code", F.lit(None).cast("string"))), _assignees(v)),
        f"WITH {ASSIGNED_SQL}, {ASSIGNEES_SQL}, gr AS (SELECT DISTINCT plan_id, date, zone_id FROM assigned) SELECT plan_id, count(*) AS routes, coalesce(array_to_string(list_sort(list(DISTINCT assignee) FILTER (assignee IS NOT NULL)), ','), '') AS assignees, count(DISTINCT date) AS dates, count(DISTINCT zone_id) AS zones FROM gr LEFT JOIN asg USING (plan_id, zone_id) GROUP BY plan_id"),
    "move_visits": (_moves, f"""WITH RECURSIVE {PLACE_SQL.replace("@DAYS@", "true")}, now AS (SELECT plan_id, patient_id, CAST(date AS DATE) AS date, zone_id FROM placed WHERE code IS NULL),
 asked AS (SELECT plan_id, min(patient_id) AS patient_id, make_date(2026, CAST(1 + plan_id % 12 AS INT), 15) AS date, CASE WHEN plan_id % 7 = 5 THEN '9-NONE' ELSE '2-HIGH' END AS zone_id, plan_id % 2 = 0 AS confirm, CAST(1 + plan_id % 3 AS INT) AS version FROM visits GROUP BY plan_id),
 j AS (SELECT a.*, CASE WHEN plan_id % 9 = 4 THEN 'PLAN_PUBLISHED' WHEN plan_id % 5 = 3 THEN 'PLAN_VERSION_CONFLICT' WHEN plan_id % 7 = 5 THEN 'ZONE_NOT_FOUND' WHEN n.patient_id IS NULL THEN 'PATIENT_NOT_IN_PLAN' END AS why FROM asked a LEFT JOIN now n USING (plan_id, patient_id)),
 moved AS (SELECT n.plan_id, n.patient_id, CASE WHEN n.patient_id = j.patient_id THEN j.date ELSE n.date END AS date, CASE WHEN n.patient_id = j.patient_id THEN j.zone_id ELSE n.zone_id END AS zone_id, n.patient_id = j.patient_id AS urban FROM now n JOIN j USING (plan_id) WHERE why IS NULL),
 capd AS (SELECT plan_id, date, capacity_minutes, least(max_visits, capacity_minutes // (service_minutes + CASE zone_kind WHEN 'rural' THEN 15 ELSE 0 END)) AS capacity_visits FROM days), r AS (
 SELECT a.plan_id, a.patient_id, a.date, a.zone_id, c.capacity_minutes, c.capacity_visits, v.service_minutes + CASE WHEN NOT a.urban AND v.kind = 'rural' THEN 15 ELSE 0 END AS need, CASE WHEN c.capacity_minutes IS NULL THEN 'NOT_A_WORKING_DAY' WHEN NOT (v.window_start IS NULL OR v.window_start < coalesce(k.window_end, 480 + c.capacity_minutes) AND coalesce(k.window_start, 480) < v.window_end) THEN 'WINDOW_OUTSIDE_WORKDAY' END AS code
 FROM moved a JOIN visits v USING (plan_id, patient_id) LEFT JOIN capd c USING (plan_id, date) JOIN constraints k USING (plan_id)), o AS (SELECT *, row_number() OVER (PARTITION BY plan_id, date ORDER BY zone_id, patient_id) AS n FROM r WHERE code IS NULL), f AS (
 SELECT plan_id, date, patient_id, n, capacity_visits >= 1 AND capacity_minutes >= need AS fit, capacity_visits - CASE WHEN capacity_visits >= 1 AND capacity_minutes >= need THEN 1 ELSE 0 END AS vis, capacity_minutes - CASE WHEN capacity_visits >= 1 AND capacity_minutes >= need THEN need ELSE 0 END AS mins FROM o WHERE n = 1
 UNION ALL SELECT o.plan_id, o.date, o.patient_id, o.n, f.vis >= 1 AND f.mins >= o.need, f.vis - CASE WHEN f.vis >= 1 AND f.mins >= o.need THEN 1 ELSE 0 END, f.mins - CASE WHEN f.vis >= 1 AND f.mins >= o.need THEN o.need ELSE 0 END FROM f JOIN o ON o.plan_id = f.plan_id AND o.date = f.date AND o.n = f.n + 1),
 bad AS (SELECT r.plan_id, count(*) FILTER (r.code IS NOT NULL OR NOT f.fit) AS conflicts FROM r LEFT JOIN f ON f.plan_id = r.plan_id AND f.date = r.date AND f.patient_id = r.patient_id GROUP BY 1),
 done AS (SELECT j.plan_id, CAST(1 AS BIGINT) AS moves, conflicts, coalesce(why, CASE WHEN confirm AND conflicts > 0 THEN 'PLAN_MOVE_CONFLICT' END) AS reason, confirm, version FROM j LEFT JOIN bad USING (plan_id))
 SELECT plan_id, moves, conflicts, reason, confirm AND reason IS NULL AS applied, CAST(version + CASE WHEN confirm AND reason IS NULL THEN 1 ELSE 0 END AS INT) AS version FROM done"""),
}
