"""Tables in their layouts and tables that are merged into: what is read, what is shuffled, what a failure leaves."""

import pytest
from pyspark.sql import functions as F

from chartloom.operators import audit
from chartloom.sources import layouts, schemas, versioned


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("audit_id"), (F.col("id") % 37).cast("string").alias("document_id"), (F.col("id") % 11).cast("string").alias("user_id"),
        F.concat(F.lit("2024-01-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("timestamp"), F.lit("EDIT").alias("change_type"), *(F.lit(None).cast("string").alias(c) for c in ("before_state", "after_state", "metadata")),
    )
    path = str(tmp_path_factory.mktemp("layouts") / "log")
    spark.sql("DROP TABLE IF EXISTS log_by_document")
    return layouts.write_layout(rows, "audit_logs", "log_by_document", path, 8).withColumn("ts", F.to_timestamp("timestamp")), path


def test_lookups_shuffle_nothing_and_read_one_bucket(spark, log):
    events, _ = log
    assert "Exchange" not in plan(audit.latest_state(events)) and audit.latest_state(events).count() == 37
    assert "Exchange" not in plan(audit.newest_per_key(events, "document_id", 3)) and audit.newest_per_key(events, "document_id", 3).count() == 111
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else files of other buckets are skipped without a word in the plan
    try:
        one = audit.newest(events, "document_id", "5")
        assert "SelectedBucketsCount: 1 out of 8" in plan(one) and "Exchange" not in plan(one) and one.count() == 100
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_ranges_of_days_read_their_partitions(spark, log):
    events, _ = log
    some = audit.between(layouts.between_days(events, "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z"), "2024-01-02", "2024-01-03T00:00:00Z")
    assert some.count() == events.filter("timestamp BETWEEN '2024-01-02' AND '2024-01-03T00:00:00Z'").count() > 0
    assert len({f.split("day=")[1][:10] for f in layouts.between_days(events, "2024-01-02", "2024-01-03").inputFiles()} - {""}) >= 2
    assert "PartitionFilters: [isnotnull(day" in plan(some)


def test_a_table_is_opened_again_in_its_layout(spark, log):
    events, path = log
    again = layouts.open_layout(spark, "audit_logs", "log_opened", path, 8)
    try:
        assert again.count() == events.count() and "Exchange" not in plan(again.groupBy("document_id").count())
    finally:
        spark.sql("DROP TABLE log_opened")


def test_every_layout_names_columns_of_its_table(spark):
    for layout in layouts.LAYOUTS.values():
        names = set(spark.createDataFrame([], layout.schema).columns)
        assert {layout.key, *layout.order} <= names and (layout.time is None or layout.time in names)
    assert {n for n, x in layouts.LAYOUTS.items() if x.schema == schemas.AUDIT and x.time is None} == {"audit", "audit_document_index", "audit_user_index"}


APPROVALS = "document_id string, request_id long, user_id string, approved_at string, expected long"


def test_merges_touch_few_parts_and_leave_no_trace_when_they_fail(spark, tmp_path):
    path = str(tmp_path / "states")
    states = spark.range(200).select(F.col("id").cast("string").alias("document_id"), F.lit("pending_review").alias("status"), F.lit(False).alias("approved"), *(F.lit(None).cast("string").alias(c) for c in ("approved_by", "approved_at")), F.lit(4).cast("long").alias("version"))
    assert versioned.merge(spark, path, audit.STATES, "document_id", states, lambda _, new: new, "first", 16)
    given = spark.createDataFrame([("7", 1, "u", "2024-02-01", 4), ("7", 2, "v", "2024-01-01", 3), ("7", 3, "w", "2024-03-01", None), ("9", 4, "x", "2024-01-01", 5), ("new", 5, None, "2024-01-01", None)], APPROVALS)
    before = {tuple(r) for r in versioned.read_current(spark, path, audit.STATES).collect()}

    def broken(rows, new):
        return rows.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        versioned.merge(spark, path, audit.STATES, "document_id", given, broken, "second", 16)
    assert {tuple(r) for r in versioned.read_current(spark, path, audit.STATES).collect()} == before
    assert versioned.merge(spark, path, audit.STATES, "document_id", given, audit.merged_approvals, "second", 16)
    after = {tuple(r) for r in versioned.read_current(spark, path, audit.STATES).collect()}
    assert after - before == {("7", "approved", True, "u", "2024-02-01", 5), ("new", "approved", True, "api-user", "2024-01-01", 1)} and len(after) == 201
    assert not versioned.merge(spark, path, audit.STATES, "document_id", given, broken, "second", 16)
    assert {tuple(r) for r in versioned.read_current(spark, path, audit.STATES).collect()} == after
    generations = [r.generation for r in versioned._manifests(spark, path).filter("n = 1 AND part IS NOT NULL").collect()]
    assert generations.count(1) <= 3 and generations.count(0) >= 12


def test_stale_approvals_are_refused_and_good_ones_logged(spark):
    states = spark.createDataFrame([("a", "edited", False, None, None, 2)], audit.STATES)
    given = spark.createDataFrame([("a", 1, "u", "2024-01-01", 1), ("a", 2, "v", "2024-01-02", 2), ("a", 3, "w", "2024-01-03", 2), ("b", 4, "x", "2024-01-01", None)], APPROVALS)
    judged = audit.judged_approvals(states, given)
    assert {r.request_id: r.outcome for r in judged.collect()} == {1: "stale", 2: "approved", 3: "stale", 4: "approved"}
    events = {r.document_id: r for r in audit.approval_events(judged).collect()}
    assert events["a"].before_state == '{"status":"edited","approved":false,"version":2}' and events["b"].before_state == '{"status":"pending_review"}'
    assert events["a"].after_state == '{"status":"approved","approved":true,"approved_by":"v","approved_at":"2024-01-02"}' and events["b"].change_type == "API_DOCUMENT_APPROVE"
