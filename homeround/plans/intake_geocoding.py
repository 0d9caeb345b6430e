"""Queries of intake and geocoding over the domain views, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from homeround.functions import text
from homeround.operators import geocoding as G
from homeround.operators import intake as I
from homeround.storage import written

ERRORS_SQL = """checked AS (
  SELECT *, CASE WHEN trim(coalesce(external_ref, '')) = '' THEN NULL ELSE sha256(lower(trim(external_ref))) END AS h,
    (CASE WHEN trim(coalesce(external_ref, '')) = '' THEN 'external_ref:REQUIRED_FIELD_MISSING;' ELSE '' END) || (CASE WHEN trim(coalesce(address, '')) = '' THEN 'address:REQUIRED_FIELD_MISSING;' ELSE '' END)
    || (CASE WHEN address = '=1+2' THEN 'address:FORMULA_INJECTION_REJECTED;' ELSE '' END) || (CASE WHEN length(address) > 300 THEN 'address:FIELD_TOO_LONG;' ELSE '' END)
    || (CASE WHEN ascii(province) = 9 THEN 'province:FORMULA_INJECTION_REJECTED;province:INVALID_CHARACTERS;' ELSE '' END)
    || (CASE WHEN length(postal_code) <> 5 THEN 'postal_code:INVALID_POSTAL_CODE_FORMAT;' ELSE '' END) AS own
  FROM import_rows), marked AS (
  SELECT *, row_number() OVER (PARTITION BY organization_id, period, h, batch_id ORDER BY row_number) AS nth,
    min(CASE WHEN own = '' AND NOT cancelled THEN batch_id END) OVER (PARTITION BY organization_id, period, h) AS lo,
    max(CASE WHEN own = '' AND NOT cancelled THEN batch_id END) OVER (PARTITION BY organization_id, period, h) AS hi
  FROM checked), rows_ AS (
  SELECT *, own || CASE WHEN h IS NULL THEN '' WHEN nth > 1 THEN 'external_ref:DUPLICATE_IN_BATCH;' WHEN lo <> batch_id OR hi <> batch_id THEN 'external_ref:DUPLICATE_IN_PERIOD;' ELSE '' END AS errors
  FROM marked)"""


def _flat(df):
    return df.select("batch_id", "row_number", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["code"], F.lit(";"))), "").alias("errors"))


def import_summary(v):
    return I.batch_summary(I.checked_rows(v("import_rows"))).select("batch_id", "total_rows", "valid_rows", "invalid_rows", "status")


def _checked(v):
    """Checked import rows with what commits read of them. They are read several times, and numbering and marking them is not cheap: each is written once."""
    kept = ["organization_id", "period", "batch_id", "row_number", "external_ref", "display_ref"]
    checked = written(I.validate_rows(v("import_rows")).select(*kept, "cancelled", "errors", "reference_hash"), "validated")
    return written(I.with_status(I.mark_duplicates(checked)).select(*kept, "validation_status"), "checked")


def _accepted(v):
    rows = _checked(v)
    picked = rows.where("row_number % 3 <> 0").select("batch_id", "row_number")
    return I.accept_rows(rows, I.batch_summary(rows), picked)


def _commits(v):
    rows = _checked(v)
    return I.commit_counts(rows, I.batch_summary(rows), rows.where("row_number % 3 <> 0").select("batch_id", "row_number"))


def _fixes(v):
    rows = v("import_rows").where("length(postal_code) <> 5")
    return rows.select("batch_id", "row_number", F.lit("48001").alias("postal_code"), *[F.lit(None).cast("string").alias(f) for f in I.FIELDS if f != "postal_code"])


def _ranked(v):
    return G.rank_candidates(v("candidates"), v("addresses").where("is_active").withColumn("address_id", F.col("patient_id")))


def _outcomes(v):
    asked = v("addresses").where("is_active").withColumn("address_id", F.col("patient_id"))
    return G.classify(G.rank_candidates(v("candidates"), asked), asked)


SCORED_SQL = """asked AS (SELECT patient_id AS address_id, organization_id, postal_code AS cp, municipality AS town, patient_id % 9 AS batch FROM addresses WHERE is_active), scored AS (
  SELECT c.*, round_even((CASE WHEN candidate_postal_code = cp THEN 0.4e0 ELSE 0e0 END) + (CASE WHEN lower(candidate_municipality) = lower(town) OR contains(lower(display_label), lower(town)) THEN 0.3e0 ELSE 0e0 END)
    + (CASE WHEN house_number IS NOT NULL THEN 0.15e0 ELSE 0e0 END) + (CASE WHEN place_class IN ('building', 'house', 'place') THEN 0.1e0 ELSE 0e0 END) + least(greatest(importance, 0e0), 1e0) * 0.05e0, 4) AS score
  FROM candidates c JOIN asked USING (address_id)), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY score DESC, ordinal) AS rank FROM scored), tops AS (SELECT * FROM ranked WHERE rank = 1), per AS (
  SELECT r.address_id, max(CASE WHEN r.rank = 1 THEN r.score END) AS top_score, max(CASE WHEN r.rank > 1 AND NOT coalesce(
      (r.house_number = t.house_number AND r.candidate_postal_code IS NOT DISTINCT FROM t.candidate_postal_code)
      OR 2 * 6371000e0 * asin(sqrt(pow(sin(radians(t.latitude - r.latitude) / 2), 2) + cos(radians(r.latitude)) * cos(radians(t.latitude)) * pow(sin(radians(t.longitude - r.longitude) / 2), 2))) <= 50, false) THEN r.score END) AS runner_up
  FROM ranked r JOIN tops t USING (address_id) GROUP BY r.address_id), outcomes AS (
  SELECT a.address_id, a.organization_id, a.batch, top_score, runner_up, CASE WHEN top_score IS NULL OR top_score < 0.3 THEN 'not_found' WHEN top_score < 0.55 THEN 'ambiguous' WHEN round(top_score - runner_up, 9) < 0.15 THEN 'ambiguous' ELSE 'matched' END AS outcome
  FROM asked a LEFT JOIN per USING (address_id))"""

KEY_SQL = "trim(regexp_replace(regexp_replace(' ' || regexp_replace(strip_accents(lower({0})), '[^a-z0-9 -]', ' ', 'g') || ' ', '[ -]+', '  ', 'g'), ' (calle|c|avenida|avda|pl|plaza|de) ', ' ', 'g'))"


def _lookup(v):
    asked = v("part").select("p_partkey", F.concat(F.lit("Calle de "), F.initcap("p_name")).alias("street"), F.col("p_size").cast("string").alias("house_number"),
        F.concat(F.lit("muni "), F.col("p_partkey") % 40).alias("municipality"), (48000 + F.col("p_partkey") % 77).cast("string").alias("postal_code"))
    return G.gazetteer_lookup(asked, v("gazetteer"))


def _retry(v):
    asked = v("addresses").where("is_active").select(F.col("patient_id").alias("address_id"), "municipality")
    municipal = v("gazetteer").groupBy("municipality").agg(F.min("point_no").alias("point_no")).withColumn("ordinal", F.lit(1))
    return G.municipality_retry(asked, v("candidates"), municipal).select("address_id", "ordinal", "point_no", "retried")


QUERIES = {
    "import_summary": (import_summary, f"WITH {ERRORS_SQL} SELECT batch_id, count(*) AS total_rows, count(*) FILTER (errors = '') AS valid_rows, count(*) FILTER (errors <> '') AS invalid_rows, CASE WHEN count(*) FILTER (errors <> '') > 0 THEN 'requires_correction' ELSE 'validated' END AS status FROM rows_ GROUP BY batch_id"),
    "validate_rows": (lambda v: _flat(I.validate_rows(v("import_rows"))), f"WITH {ERRORS_SQL} SELECT batch_id, row_number, own AS errors FROM checked"),
    "mark_duplicates": (lambda v: _flat(I.mark_duplicates(I.validate_rows(v("import_rows")))), f"WITH {ERRORS_SQL} SELECT batch_id, row_number, errors FROM rows_"),
    "apply_corrections": (lambda v: I.apply_corrections(I.checked_rows(v("import_rows")), _fixes(v)).groupBy("batch_id", "validation_status").agg(F.count("*").alias("n")),
        f"WITH {ERRORS_SQL} SELECT batch_id, CASE WHEN length(postal_code) <> 5 THEN CASE WHEN replace(own, 'postal_code:INVALID_POSTAL_CODE_FORMAT;', '') = '' THEN 'corrected' ELSE 'invalid' END WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS validation_status, count(*) AS n FROM rows_ GROUP BY ALL"),
    "accept_rows": (lambda v: _accepted(v).select("batch_id", "row_number"), f"WITH {ERRORS_SQL} SELECT batch_id, row_number FROM rows_ WHERE errors = '' AND row_number % 3 <> 0"),
    "version_addresses": (lambda v: I.version_addresses(v("patients").select("organization_id", "external_ref", F.lit(2).alias("version")), _accepted(v).withColumn("external_ref", F.upper(F.trim("external_ref")))).select("batch_id", "row_number", "version", "is_active"),
        f"WITH {ERRORS_SQL} SELECT batch_id, row_number, CAST(2 + row_number() OVER w AS INT) AS version, lead(batch_id) OVER w IS NULL AS is_active FROM rows_ WHERE errors = '' AND row_number % 3 <> 0 WINDOW w AS (PARTITION BY organization_id, upper(trim(external_ref)) ORDER BY batch_id, row_number)"),
    "commit_addresses": (lambda v: I.commit_addresses(v("patients").select("organization_id", "external_ref", F.lit(2).alias("version"), F.lit(True).alias("is_active"), F.lit("matched").alias("geocode_status")), _accepted(v).withColumn("external_ref", F.upper(F.trim("external_ref")))).select("organization_id", "external_ref", "version", "is_active", "geocode_status"),
        f"WITH {ERRORS_SQL}, acc AS (SELECT *, upper(trim(external_ref)) AS ref FROM rows_ WHERE errors = '' AND row_number % 3 <> 0) SELECT p.organization_id, p.external_ref, CAST(2 AS INT) AS version, NOT EXISTS (SELECT 1 FROM acc WHERE ref = p.external_ref AND acc.organization_id = p.organization_id) AS is_active, 'matched' AS geocode_status FROM patients p UNION ALL SELECT organization_id, ref, CAST(2 + row_number() OVER w AS INT), lead(batch_id) OVER w IS NULL, 'pending' FROM acc WINDOW w AS (PARTITION BY organization_id, ref ORDER BY batch_id, row_number)"),
    "upsert_patients": (lambda v: I.upsert_patients(v("patients").where("patient_id % 3 = 0"), _accepted(v).withColumns({"external_ref": F.upper(F.trim("external_ref")), "display_ref": F.when(F.col("row_number") % 2 == 0, F.concat(F.lit(" "), "display_ref"))})),
        f"WITH {ERRORS_SQL}, acc AS (SELECT *, upper(trim(external_ref)) AS ref FROM rows_ WHERE errors = '' AND row_number % 3 <> 0), n AS (SELECT organization_id, ref AS external_ref, arg_max(CASE WHEN row_number % 2 = 0 THEN display_ref ELSE ref END, (batch_id, row_number)) AS shown, min(batch_id) AS b FROM acc GROUP BY 1, 2), o AS (SELECT organization_id, external_ref, display_ref, CAST(source_batch_id AS STRING) AS sb FROM patients WHERE patient_id % 3 = 0) SELECT organization_id, external_ref, coalesce(shown, display_ref) AS display_ref, coalesce(sb, b) AS source_batch_id FROM o FULL JOIN n USING (organization_id, external_ref)"),
    "normalize_address": (lambda v: v("addresses").select("address_id", text.normalize_address(F.col("address")).alias("normalized")),
        "SELECT address_id, trim(regexp_replace(replace(replace(replace(address, 'C/ ', 'Calle '), 'Avda. ', 'Avenida '), 'Pl. ', 'Plaza. '), '\\s+', ' ', 'g')) AS normalized FROM addresses"),
    "address_parts": (lambda v: v("addresses").withColumn("p", text.street_number(text.strip_floor_door(F.col("address")))).select("address_id", "p.street", "p.number"),
        "WITH t AS (SELECT address_id, trim(split_part(address, ',', 1)) AS a FROM addresses) SELECT address_id, CASE WHEN regexp_matches(a, '^.+?\\s+[0-9]+[A-Za-z]?$') THEN trim(regexp_extract(a, '^(.+?)\\s+([0-9]+[A-Za-z]?)$', 1)) ELSE a END AS street, CASE WHEN regexp_matches(a, '^.+?\\s+[0-9]+[A-Za-z]?$') THEN regexp_extract(a, '^(.+?)\\s+([0-9]+[A-Za-z]?)$', 2) END AS number FROM t"),
    "street_keys": (lambda v: v("addresses").select("address_id", text.street_key(F.col("address")).alias("street_key")),
        "SELECT address_id, trim(regexp_replace(" + KEY_SQL.format("replace(address, 'º', 'o')") + ", ' +', ' ', 'g')) AS street_key FROM addresses"),
    "commit_counts": (_commits, f"WITH {ERRORS_SQL} SELECT batch_id, count(*) AS accepted, count(*) FILTER (errors = '') AS committed, count(*) FILTER (errors <> '') AS skipped FROM rows_ WHERE row_number % 3 <> 0 GROUP BY 1"),
    "query_hashes": (lambda v: v("addresses").select("address_id", text.text_hash(F.col("address"), F.col("postal_code"), F.col("municipality")).alias("query_hash")),
        "SELECT address_id, sha256(lower(trim(address)) || '|' || postal_code || '|' || lower(municipality)) AS query_hash FROM addresses"),
    "gazetteer_lookup": (lambda v: _lookup(v).select("p_partkey", "point_no", "with_postal_code"),
        "WITH g AS (SELECT lower(street) AS k, house_number, municipality, postal_code, min(point_no) AS point_no FROM gazetteer GROUP BY ALL), q AS (SELECT p_partkey, lower(p_name) AS k, CAST(p_size AS STRING) AS house_number, 'Muni ' || CAST(p_partkey % 40 AS STRING) AS municipality, CAST(48000 + p_partkey % 77 AS STRING) AS postal_code FROM part), l AS (SELECT k, house_number, municipality, min(point_no) AS point_no FROM g GROUP BY ALL) SELECT p_partkey, coalesce(g.point_no, l.point_no) AS point_no, g.point_no IS NOT NULL AS with_postal_code FROM q LEFT JOIN g USING (k, house_number, municipality, postal_code) LEFT JOIN l USING (k, house_number, municipality)"),
    "score_candidates": (lambda v: _ranked(v).select("address_id", "ordinal", "score", "rank"), f"WITH {SCORED_SQL} SELECT address_id, ordinal, score, CAST(rank AS INT) AS rank FROM ranked"),
    "classify_addresses": (lambda v: _outcomes(v), f"WITH {SCORED_SQL} SELECT address_id, top_score, runner_up, outcome FROM outcomes"),
    "outcome_counts": (lambda v: G.outcome_counts(_outcomes(v).withColumn("batch", F.col("address_id") % 9)), f"WITH {SCORED_SQL} SELECT batch, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'not_found') AS not_found FROM outcomes GROUP BY batch"),
    "match_rate": (lambda v: G.match_rate(_outcomes(v).withColumn("organization_id", F.col("address_id") % 25), v("patients").where("patient_id % 2 = 0").select(F.col("patient_id").alias("address_id")), v("patients").where("patient_id % 14 = 0").select(F.col("patient_id").alias("address_id"))),
        f"WITH {SCORED_SQL} SELECT address_id % 25 AS organization_id, round_even(avg(CASE WHEN outcome = 'matched' THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) FILTER (outcome <> 'matched') AS failures FROM outcomes WHERE address_id % 2 = 0 AND address_id % 14 <> 0 GROUP BY 1"),
    "first_candidates": (lambda v: G.first_candidates(v("candidates"), 5).select("address_id", F.size("candidates").cast("long").alias("kept"), F.element_at("candidates", -1)["class"].alias("last_class")),
        "SELECT address_id, count(*) AS kept, arg_max(place_class, ordinal) AS last_class FROM candidates WHERE ordinal <= 5 GROUP BY address_id"),
    "augment_candidates": (lambda v: G.augment_candidates(v("candidates"), v("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("address_id"), F.concat(F.lit("Calle "), F.col("c_custkey") % 30).alias("street"), F.when(F.col("c_custkey") % 2 == 0, "Vía MÚNI 7").alias("aliases"), (F.col("c_custkey") % 25).cast("string").alias("house_number"), F.lit(43.2).alias("latitude"), F.lit(-2.9).alias("longitude"))).select("address_id", "ordinal", "place_class", "house_number"),
        """WITH p AS (SELECT c_custkey AS address_id, 'calle ' || CAST(c_custkey % 30 AS STRING) AS street, CAST(c_custkey % 25 AS STRING) AS no FROM customer WHERE c_custkey % 3 = 0), j AS (SELECT c.*, p.street, max(coalesce(c.house_number = p.no AND (contains(lower(display_label), p.street) OR contains(lower(display_label), substr(p.street, 7)) OR (c.address_id % 2 = 0 AND contains(lower(display_label), 'muni 7'))), false)) OVER (PARTITION BY c.address_id) AS there FROM candidates c LEFT JOIN p USING (address_id)), u AS (
SELECT address_id, ordinal, place_class, house_number FROM j WHERE street IS NULL OR there OR house_number IS NOT NULL UNION ALL SELECT address_id, 0, 'house', no FROM p WHERE address_id NOT IN (SELECT address_id FROM j WHERE there)) SELECT address_id, CAST(row_number() OVER (PARTITION BY address_id ORDER BY ordinal) AS INT) AS ordinal, place_class, house_number FROM u"""),
    "import_row_page": (lambda v: I.row_page(I.checked_rows(v("import_rows")), 2, 5, "valid").select("batch_id", "row_number", "place", "more"),
        f"WITH {ERRORS_SQL}, pl AS (SELECT batch_id, row_number, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY row_number) AS INT) AS place FROM rows_ WHERE errors = '' AND row_number > 2) SELECT batch_id, row_number, place, place > 5 AS more FROM pl WHERE place <= 6"),
    "address_keys": (lambda v: v("addresses").select("address_id", text.municipality_key(F.concat(F.lit(" "), F.col("municipality"), F.lit("Ñ "))).alias("municipality_key"), text.house_number_key(F.concat(F.lit(" "), F.col("patient_id") % 50, F.lit("B "))).alias("number_key")),
        "SELECT address_id, strip_accents(lower(municipality || 'n')) AS municipality_key, CAST(patient_id % 50 AS STRING) || 'b' AS number_key FROM addresses"),
    "municipality_retry": (_retry, """WITH asked AS (SELECT patient_id AS address_id, municipality FROM addresses WHERE is_active), m AS (SELECT municipality, min(point_no) AS point_no FROM gazetteer GROUP BY 1)
 SELECT address_id, ordinal, CAST(NULL AS BIGINT) AS point_no, false AS retried FROM candidates UNION ALL SELECT address_id, CAST(1 AS INT), point_no, true FROM asked JOIN m USING (municipality) WHERE address_id NOT IN (SELECT address_id FROM candidates)"""),
    "cache_misses": (lambda v: G.cached_lookup(*_cache(v), "1997-06-01")[1], "SELECT DISTINCT CAST(user_id AS STRING) AS query_hash, 'v1' AS provider_version FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01' - INTERVAL 30 DAY)"),
    "latest_attempts": (lambda v: G.latest_attempts(v("events").select(F.col("user_id").alias("address_id"), F.col("ts").alias("requested_at"), F.col("event_id").alias("id"))).select("address_id", "id"),
        "SELECT user_id AS address_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
}


def _cache(v):
    asked = v("events").select(F.col("user_id").cast("string").alias("query_hash"), F.lit("v1").alias("provider_version"))
    return asked, v("orders").select(F.col("o_orderkey").cast("string").alias("query_hash"), F.lit("v1").alias("provider_version"), F.col("o_orderkey").alias("reply_no"), F.col("o_orderdate").alias("stored_at"))
