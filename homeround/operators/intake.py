"""Import rows: validation, duplicates, batch status, corrections, commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeround.functions.text import text_hash

FIELDS = ("external_ref", "display_ref", "address", "postal_code", "municipality", "province")
REQUIRED = ("external_ref", "address", "postal_code", "municipality", "province")
MAX_LENGTH = 300


def field_errors(fields: tuple[str, ...] = FIELDS) -> Column:
    """Ordered array of (field, code): each field's own checks in turn; formula, length and control checks see the raw value."""

    def when(condition: Column, field: str, code: str) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))

    checks = [when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", f, "REQUIRED_FIELD_MISSING") for f in REQUIRED]
    for f in fields:
        checks += [
            when(F.col(f).rlike(r"^[=+\-@\t\r]"), f, "FORMULA_INJECTION_REJECTED"),
            when(F.length(f) > MAX_LENGTH, f, "FIELD_TOO_LONG"),
            when(F.col(f).rlike(r"[\x00-\x09\x0B-\x1F\x7F]"), f, "INVALID_CHARACTERS"),
        ]
    postal = F.trim("postal_code")
    checks.append(when((postal != "") & ~postal.rlike("^[0-9]{5}$"), "postal_code", "INVALID_POSTAL_CODE_FORMAT"))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def validate_rows(rows: DataFrame) -> DataFrame:
    """Adds ``errors``, the reference hash and the status from the row alone. A blank reference has no hash."""
    blank = F.trim(F.coalesce("external_ref", F.lit(""))) == ""
    return rows.withColumns(
        {"errors": field_errors(), "reference_hash": F.when(~blank, text_hash(F.col("external_ref")))}
    )


def mark_duplicates(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds DUPLICATE_IN_BATCH (a later row of the batch with that reference), else DUPLICATE_IN_PERIOD.

    The second: the reference is in a valid row of another, not cancelled batch of the period, among ``rows`` or ``stored`` (rows checked
    before, with validation_status). References are counted before the rows meet the counts, and only those found more than once are
    kept, so a reference that very many rows share is a skewed join, which the adaptive planner splits; blank ones are set apart by their own row.
    """
    key = F.coalesce("reference_hash", F.concat(F.lit("row|"), F.col("batch_id"), F.lit("|"), F.col("row_number")))
    by = ["organization_id", "period", "__key"]
    counts = (F.size("errors") == 0) & ~F.col("cancelled")
    keyed = rows.withColumn("__key", key)
    each = keyed.groupBy(*by, "batch_id").agg(F.count("*").alias("__rows"), F.min("row_number").alias("__first_row"), F.max(F.when(counts, F.col("batch_id"))).alias("__holder"))
    per = each.groupBy(*by).agg(F.sum("__rows").alias("__all"), F.min("__holder").alias("__low"), F.max("__holder").alias("__high")).where("__all > 1").drop("__all")
    repeated = each.join(per, by).select(*by, "batch_id", "__first_row", "__low", "__high")
    marked = keyed.join(repeated, [*by, "batch_id"], "left").drop("__key").withColumn("__nth", F.when(F.col("row_number") > F.col("__first_row"), 2).otherwise(1)).drop("__first_row").select(*rows.columns, "__low", "__high", "__nth")
    if stored is not None:
        held = stored.where(F.col("validation_status").isin("valid", "corrected") & ~F.col("cancelled"))
        before = held.groupBy("organization_id", "period", "reference_hash").agg(F.min("batch_id").alias("__first"), F.max("batch_id").alias("__last"))
        marked = marked.join(before, ["organization_id", "period", "reference_hash"], "left")
        marked = marked.withColumns({"__low": F.least("__low", "__first"), "__high": F.greatest("__high", "__last")}).drop("__first", "__last")
    known = F.col("reference_hash").isNotNull()
    elsewhere = (F.col("__low") != F.col("batch_id")) | (F.col("__high") != F.col("batch_id"))
    code = F.when(known & (F.col("__nth") > 1), "DUPLICATE_IN_BATCH").when(known & elsewhere, "DUPLICATE_IN_PERIOD")
    extra = F.when(code.isNotNull(), F.array(F.struct(F.lit("external_ref").alias("field"), code.alias("code"))))
    return marked.withColumn("errors", F.concat("errors", F.coalesce(extra, F.slice("errors", 1, 0)))).drop("__low", "__high", "__nth")


def with_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("validation_status", F.when(F.size("errors") == 0, "valid").otherwise("invalid"))


def batch_summary(rows: DataFrame) -> DataFrame:
    """Per batch: counts and status."""
    out = rows.groupBy("organization_id", "period", "batch_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("validation_status") != "invalid").alias("valid_rows"),
        F.count_if(F.col("validation_status") == "invalid").alias("invalid_rows"),
    )
    return out.withColumn("status", F.when(F.col("invalid_rows") > 0, "requires_correction").otherwise("validated"))


def apply_corrections(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Overlay corrected fields by (batch, row) and check again; duplicates are not searched again."""
    keys = ["batch_id", "row_number"]
    fixes = corrections.select(*keys, F.lit(True).alias("__fixed"), *[F.col(f).alias(f"__{f}") for f in FIELDS])
    joined = rows.join(fixes, keys, "left")
    joined = joined.select(
        *[F.coalesce(F.col(f"__{f}"), F.col(f)).alias(f) if f in FIELDS else F.col(f) for f in rows.columns], "__fixed"
    )
    checked = joined.withColumn("errors", F.when(F.col("__fixed"), field_errors()).otherwise(F.col("errors")))
    status = F.when(F.col("__fixed"), F.when(F.size("errors") == 0, "corrected").otherwise("invalid")).otherwise(F.col("validation_status"))
    return checked.withColumn("validation_status", status).drop("__fixed")


def accept_rows(rows: DataFrame, batches: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows that a commit takes: of a validated batch, in the accepted set, valid or corrected."""
    ready = batches.where(F.col("status").isin("validated", "requires_correction")).select("batch_id")
    return (
        rows.join(ready, "batch_id", "left_semi")
        .join(accepted, ["batch_id", "row_number"], "left_semi")
        .where(F.col("validation_status").isin("valid", "corrected"))
    )


def commit_counts(rows: DataFrame, batches: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per batch with accepted rows: how many were accepted, how many the commit takes, and how many it skips, for whatever reason."""
    keys = ["batch_id", "row_number"]
    taken = accept_rows(rows, batches, accepted).select(*keys, F.lit(True).alias("__taken"))
    each = accepted.select(*keys).distinct().join(taken, keys, "left")
    return each.groupBy("batch_id").agg(F.count("*").alias("accepted"), F.count("__taken").alias("committed"), F.count_if(F.col("__taken").isNull()).alias("skipped"))


def row_page(rows: DataFrame, after: int, limit: int, status: str | None = None) -> DataFrame:
    """A page of every batch: its first ``limit`` rows after row ``after``, of one status if asked, and one row more where ``more`` follow."""
    if status is not None:
        rows = rows.where(F.col("validation_status") == status)
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("row_number"))
    page = rows.where(F.col("row_number") > after).withColumn("place", place).where(F.col("place") <= limit + 1)
    return page.withColumn("more", F.col("place") > limit)


def version_addresses(current: DataFrame, rows: DataFrame) -> DataFrame:
    """New address versions of a commit: per (organization, reference) the rows follow the highest version; only the last is active."""
    order = Window.partitionBy("organization_id", "external_ref").orderBy("batch_id", "row_number")
    top = current.groupBy("organization_id", "external_ref").agg(F.max("version").alias("top"))
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .withColumn("is_active", F.lead("nth").over(order).isNull())
        .join(top, ["organization_id", "external_ref"], "left")
        .withColumn("version", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("int"))
        .drop("nth", "top")
    )


def commit_addresses(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Addresses after a commit, by (organization, reference): earlier active ones closed, one new version a row, the last of them active and pending."""
    keys = ["organization_id", "external_ref"]
    new = version_addresses(current.where("is_active"), rows)
    touched = rows.select(*keys, F.lit(True).alias("__new")).distinct()
    old = current.join(touched, keys, "left").withColumn("is_active", F.col("is_active") & F.col("__new").isNull()).drop("__new")
    fresh = new.select(*keys, "version", "is_active", F.lit("pending").alias("geocode_status"), *[c for c in ("batch_id", "row_number", "address", "postal_code", "municipality", "province") if c in new.columns])
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert_patients(patients: DataFrame, rows: DataFrame) -> DataFrame:
    """Patients by (organization, reference) after a commit: the last row's display reference, or the reference itself; new ones name the first row's batch."""
    keys = ["organization_id", "external_ref"]
    shown = F.coalesce(F.when(F.trim("display_ref") != "", F.trim("display_ref")), F.col("external_ref"))
    place = F.struct("batch_id", "row_number")
    new = rows.groupBy(*keys).agg(F.max_by(shown, place).alias("__shown"), F.min("batch_id").alias("__batch"))
    both = patients.select(*keys, "display_ref", F.col("source_batch_id").cast("string").alias("source_batch_id"), F.lit(True).alias("__old")).join(new, keys, "full_outer")
    return both.select(*keys, F.coalesce("__shown", "display_ref").alias("display_ref"), F.when(F.col("__old"), F.col("source_batch_id")).otherwise(F.col("__batch")).alias("source_batch_id"))


def checked_rows(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    return with_status(mark_duplicates(validate_rows(rows), stored))
