"""The audit log: building events, looking them up, and the daily export behind a quality gate."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import privacy

CATEGORIES = {"SNOMED_STATUS": "ner", "SUMMARY_EDIT": "summarization"}


def build_events(changes: DataFrame) -> DataFrame:
    """Events from (document_id, user_id, change_type, before_state, after_state, metadata), states as masked JSON or null."""
    state = lambda c: F.when(F.coalesce(F.col(c), F.lit("")).isin("", "{}", "null", "[]"), None).otherwise(privacy.mask_json(c)).alias(c)
    return changes.select(F.uuid().alias("audit_id"), "document_id", "user_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "change_type", state("before_state"), state("after_state"), state("metadata"))


def newest(events: DataFrame, column: str, value, limit: int = 100) -> DataFrame:
    """The newest events of a document or user."""
    return events.filter(F.col(column) == value).orderBy(F.desc("ts"), F.desc("audit_id")).limit(limit)


def newest_per_key(events: DataFrame, column: str, limit: int = 100) -> DataFrame:
    w = Window.partitionBy(column).orderBy(F.desc("ts"), F.desc("audit_id"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def history(events: DataFrame, document_id) -> DataFrame:
    return events.filter(F.col("document_id") == document_id).orderBy("ts", "audit_id")


def between(events: DataFrame, start: str, end: str, document_id=None) -> DataFrame:
    """Both ends included."""
    out = events.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return out if document_id is None else out.filter(F.col("document_id") == document_id)


def parse_states(events: DataFrame) -> DataFrame:
    return events.withColumns({f"{c}_v": F.try_parse_json(c) for c in ("before_state", "after_state", "metadata")})


def latest_state(states: DataFrame, key: str = "document_id") -> DataFrame:
    """Each document's last state."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "audit_id")).alias("s")).select(key, "s.*")


def approve(states: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New states of documents under approval, and the changes to log."""
    now = latest_state(states).alias("n").join(approvals.alias("a"), "document_id")
    changed = now.select("document_id", F.lit("APPROVED").alias("status"), F.col("n.status").alias("before"), F.col("a.user_id").alias("user_id"))
    log = changed.select("document_id", "user_id", F.lit("DOCUMENT_APPROVAL").alias("change_type"), F.to_json(F.struct(F.col("before").alias("status"))).alias("before_state"), F.to_json(F.struct("status")).alias("after_state"), F.lit(None).cast("string").alias("metadata"))
    return changed.drop("before"), log


#: States of documents under approval; version counts the changes of a document.
STATES = "document_id string, status string, approved boolean, approved_by string, approved_at string, version long"


def judged_approvals(states: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approvals (document_id, request_id, user_id, approved_at, expected) with the state that they met and an outcome.

    A document without a state is pending at version 0. Of a document's requests that expect its version (or, with null, any) the earliest
    is approved; all others are stale: what they were made on is no longer so. Equal times and ids are told apart by the user, so that the
    outcome doesn't depend on the order of rows.
    """
    met = approvals.join(states.select("document_id", F.struct("status", "approved", "approved_by", "approved_at", "version").alias("before")), "document_id", "left")
    version = F.coalesce("before.version", F.lit(0).cast("long"))
    fits = F.coalesce(F.col("expected") == version, F.lit(True))
    order = F.row_number().over(Window.partitionBy("document_id", fits).orderBy("approved_at", "request_id", "user_id"))  # requests of one document in one batch
    return met.withColumn("version", version).withColumn("outcome", F.when(fits & (order == 1), "approved").otherwise("stale"))


def merged_approvals(states: DataFrame, approvals: DataFrame) -> DataFrame:
    """States after approvals; the function that ``versioned.merge`` applies to the parts that approvals touch."""
    new = judged_approvals(states, approvals).filter("outcome = 'approved'")
    new = new.select("document_id", F.lit("approved").alias("status"), F.lit(True).alias("approved"), F.coalesce("user_id", F.lit("api-user")).alias("approved_by"), "approved_at", (F.col("version") + 1).alias("version"))
    return states.join(new, "document_id", "left_anti").unionByName(new)


def approval_events(judged: DataFrame) -> DataFrame:
    """The changes to log of judged approvals that were approved; a document without a state was pending review."""
    before = F.to_json(F.coalesce("before", F.struct(F.lit("pending_review").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("approved", "boolean"), ("approved_by", "string"), ("approved_at", "string"), ("version", "long"))))))
    after = F.to_json(F.struct(F.lit("approved").alias("status"), F.lit(True).alias("approved"), F.coalesce("user_id", F.lit("api-user")).alias("approved_by"), "approved_at"))
    metadata = F.lit('{"source": "api_gateway", "endpoint": "PUT /documents/{doc_id}/approve"}')
    return judged.filter("outcome = 'approved'").select("document_id", F.coalesce("user_id", F.lit("api-user")).alias("user_id"), F.lit("API_DOCUMENT_APPROVE").alias("change_type"), before.alias("before_state"), after.alias("after_state"), metadata.alias("metadata"))


def with_expiry(sessions: DataFrame, days: int = 30) -> DataFrame:
    return sessions.withColumn("ttl_expiry", F.unix_seconds("logout") + F.lit(days * 86400))


def active_sessions(sessions: DataFrame, now: int) -> DataFrame:
    return with_expiry(sessions).filter(F.col("ttl_expiry") > now)


def daily_feedback(events: DataFrame, day: str, anonymise: bool = True, legacy_string_range: bool = False) -> DataFrame:
    """A day's events (half-open day, UTC; or the range of ISO strings) with category, hashed users and masked texts."""
    if legacy_string_range:
        rows = events.filter(F.col("timestamp").between(f"{day}T00:00:00Z", f"{day}T23:59:59Z"))
    else:
        start = F.lit(f"{day}T00:00:00Z").cast("timestamp")  # whatever the session's time zone
        rows = events.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    out = rows.withColumn("category", F.coalesce(F.try_element_at(known, "change_type"), F.lit("general")))
    if not anonymise:
        return out
    return out.withColumns({"user_id": privacy.hash_id(F.col("user_id")), "before_state": privacy.mask_patterns(F.col("before_state")), "after_state": privacy.mask_patterns(F.col("after_state")), "metadata": privacy.mask_patterns(F.col("metadata"))})


def quality_issues(rows: DataFrame) -> DataFrame:
    """A row per issue: missing ids and times, markers of personal data in a row without a redaction."""
    json = F.to_json(F.struct(*[c for c in rows.columns if c != "ts"]))
    marks = F.transform(privacy.residual_pii(json), lambda m: F.concat(F.lit("Possible PII detected in "), F.col("category"), F.lit(": "), m))
    missing = F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.concat(F.lit(f"Missing {c} in "), F.col("category"))) for c in ("audit_id", "timestamp")])
    return rows.select("audit_id", "category", F.explode(F.concat(F.array_compact(missing), marks)).alias("issue"))


def quality_gate(rows: DataFrame, most: int = 10) -> DataFrame:
    """One row: passed, total_records and the first issues."""
    found = quality_issues(rows)
    n = rows.agg(F.count("*").alias("total_records"))
    first = found.orderBy("issue", "audit_id").limit(most).agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    listed = F.when(F.col("total_records") == 0, F.array(F.lit("No records to export"))).otherwise(F.col("issues"))
    return n.crossJoin(first).select((F.size(listed) == 0).alias("passed"), "total_records", listed.alias("issues"))  # one row each


def run_daily_export(events: DataFrame, path: str, day: str | None = None, anonymise: bool = True) -> dict:
    """Export a day, yesterday in UTC by default: no_data, quality_check_failed (nothing is written) or success. Runs again safely."""
    from chartloom.sources.sinks import write_export

    day = day or str(datetime.now(UTC).date() - timedelta(days=1))
    rows = daily_feedback(events, day, anonymise).persist()
    try:
        gate = quality_gate(rows).first()
        if not gate.total_records:
            return {"status": "no_data", "date": day}
        if not gate.passed:
            return {"status": "quality_check_failed", "date": day, "issues": list(gate.issues)}
        write_export(rows, path, day)
        counts = {r.category: r.n for r in rows.groupBy("category").agg(F.count("*").alias("n")).collect()}
        return {"status": "success", "date": day, "records": gate.total_records, "categories": counts}
    finally:
        rows.unpersist()
