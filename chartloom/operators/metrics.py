"""Roll-ups of stages, latencies, accuracies, routes and alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import text
from chartloom.sources.scratch import stored

#: Seconds that a stage may take.
STAGE_TARGETS = {"tier1_textract_per_page": 5.0, "tier2_layoutlmv3_per_page": 8.0, "tier3_vision_llm_per_region": 10.0, "track_a_snomed_per_document": 10.0, "track_b_summary_per_document": 15.0, "pipeline_end_to_end_per_document": 60.0}


def phi_summary(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """detected, count and counts by type."""
    counts = spans.groupBy(by, F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.lit(True).alias("phi_detected"), F.sum("n").alias("entity_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts_by_type"))


def stage_metrics(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """A long row per group and metric: n, mean and largest value."""
    long = rows.unpivot(by, values, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))


def value_at_place(rows: DataFrame, by: str, value: str, share: float, most: int = 100_000) -> DataFrame:
    """Per group: n, and the value at place floor((n - 1) * share) in order. Null values are left out.

    A group of more than ``most`` candidates is looked into again: its values are counted by ranges between approximate quantiles, each
    quantile's own value being a range for itself, and only the range that holds the place stays. Counts are exact, so the
    result is, whatever the quantiles are; each look is one pass with sums by range, and no task sorts more than ``most`` rows of a group.
    """
    given = rows.select(by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    place = F.floor((F.col("n") - 1) * share).cast("long")
    groups = given.groupBy(by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    found = stored(groups.withColumns({"_k": place, "_in": F.col("n")}), "places")
    near = sorted({min(1.0, max(0.0, share + d / 10_000 * s)) for d in (1, 2, 8, 64, 512) for s in (-1, 1)} | {i / 64 for i in range(65)})
    while True:
        large = F.col("_in") > most
        state = found.agg(F.count_if(large & (F.col("_lo") < F.col("_hi"))).alias("open"), F.count("*").alias("groups")).first()
        bounds = F.broadcast(found) if state.groups <= 10_000 else found  # as many rows at most
        inside = given.join(bounds, by).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        if not state.open:
            break
        wide = inside.filter(large & (F.col("_lo") < F.col("_hi")))
        cuts = wide.groupBy(by).agg(F.array_distinct(F.percentile_approx("_v", [float(x) for x in near], 10_000)).alias("_cuts"))
        ranged = wide.join(F.broadcast(cuts) if state.groups <= 10_000 else cuts, by).withColumn("_r", 2 * F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))) - F.array_contains("_cuts", F.col("_v")).cast("int"))
        counts = ranged.groupBy(by, "_r", "n", "_k").agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_in").over(Window.partitionBy(by).orderBy("_r")) - F.col("_in")  # as many rows as ranges
        holding = counts.withColumn("_b", before).filter((F.col("_b") <= F.col("_k")) & (F.col("_k") < F.col("_b") + F.col("_in")))
        narrowed = holding.select(by, "n", "_lo", "_hi", (F.col("_k") - F.col("_b")).alias("_k"), "_in")
        found = stored(found.filter(~(large & (F.col("_lo") < F.col("_hi")))).select(by, "n", "_lo", "_hi", "_k", "_in").unionByName(narrowed), "places")
    numbered = inside.filter(F.col("_lo") < F.col("_hi")).withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy("_v")) - 1)
    sorted_out = numbered.filter(F.col("_p") == F.col("_k")).select(by, "n", F.col("_v").alias("at_place"))
    return found.filter(F.col("_lo") == F.col("_hi")).select(by, "n", F.col("_lo").alias("at_place")).unionByName(sorted_out)


def latency_summary(rows: DataFrame, targets: DataFrame | None = None, by: str = "stage", value: str = "seconds", most: int = 100_000) -> DataFrame:
    """count, mean, p95 (the value at place floor((n - 1) * 0.95) in order), largest, and whether that is within the target."""
    p95 = value_at_place(rows, by, value, 0.95, most).select(by, F.col("at_place").alias("p95"))
    out = rows.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.max(value).alias("most")).join(p95, by)
    if targets is None:
        return out
    return out.join(targets, by, "left").withColumn("target_met", F.col("most") <= F.col("target"))


#: Stages as their metrics name them.
EXTRACTION, MAPPING, SUMMARIES, AGGREGATION = "Tier1Textract", "TrackASNOMED", "TrackBSummarization", "ConfidenceAggregation"


def _points(rows: DataFrame, stage: str, metrics: list[tuple[str, str, Column]], **dimensions: str) -> DataFrame:
    """A row per document and metric that has a value: metric, unit, stage, document_type, role, route, value."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), v.cast("double").alias("value")) for m, u, v in metrics])
    kinds = {d: F.col(dimensions[d]) if d in dimensions else F.lit(None).cast("string") for d in ("document_type", "role", "route")}
    long = rows.select(*[c.alias(d) for d, c in kinds.items()], F.explode(values).alias("m"))
    return long.filter("m.value IS NOT NULL").select("m.metric", "m.unit", F.lit(stage).alias("stage"), *kinds, "m.value")


def extraction_points(results: DataFrame) -> DataFrame:
    """Metrics of (document_type, success, latency_seconds, line_confidence): a document that was read also shows its mean confidence
    in per cent and, as a coarse error rate, what that lacks of 100. Without lines the confidence is 0."""
    ok, conf = F.coalesce(F.col("success"), F.lit(False)), F.coalesce("line_confidence", F.lit(0.0))
    return _points(results, EXTRACTION, [
        ("StageLatencySeconds", "Seconds", F.col("latency_seconds")), ("ExtractionSuccessCount", "Count", ok.cast("double")), ("ExtractionErrorRate", "Percent", F.when(ok, 0.0).otherwise(100.0)),
        ("ExtractionConfidenceAvg", "Percent", F.when(ok, conf)), ("ExtractionErrorRate", "Percent", F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - conf)))),
    ], document_type="document_type")


def mapping_points(results: DataFrame) -> DataFrame:
    """Metrics of (document_type, total, mapped, fallback, latency_seconds); of a document whose total is null only a success rate of 0."""
    read = F.col("total").isNotNull()
    rate = F.when(F.col("total") > 0, F.col("mapped") / F.col("total") * 100).otherwise(0.0)
    return _points(results, MAPPING, [("StageLatencySeconds", "Seconds", F.when(read, F.col("latency_seconds"))), ("SNOMEDMappingSuccessRate", "Percent", rate), ("SNOMEDFallbackCount", "Count", F.when(read, F.col("fallback")))], document_type="document_type")


def summary_points(results: DataFrame) -> DataFrame:
    """Metrics of (document_type, role, latency_ms, confidence_score), the latter where there is one."""
    return _points(results, SUMMARIES, [("LLMInferenceLatencyMs", "Milliseconds", F.col("latency_ms")), ("LLMConfidenceScore", "None", F.col("confidence_score"))], document_type="document_type", role="role")


def routing_points(results: DataFrame) -> DataFrame:
    """Metrics of (document_type, route, final_confidence, latency_ms)."""
    return _points(results, AGGREGATION, [("UnifiedConfidenceScore", "None", F.col("final_confidence")), ("AggregationLatencyMs", "Milliseconds", F.col("latency_ms"))], document_type="document_type", route="route")


def metric_rollup(points: DataFrame) -> DataFrame:
    """Statistics of each metric by all its dimensions, by its stage and document type, and by its stage: level, n, total, mean, least, most.

    One pass: each point is expanded to three keys and pre-aggregated before the shuffle. A metric without a role or a route has the same
    rows at its first two levels.
    """
    keys = ["metric", "unit", "stage", "document_type", "role", "route"]
    sets = [[F.col(k) for k in keys[:n]] for n in (6, 4, 3)]
    stats = [F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")]
    level = F.when(F.grouping_id() == 0, "dimensions").when(F.grouping_id() == 3, "document_type").otherwise("stage").alias("level")
    return points.groupingSets(sets, *keys).agg(*stats, level).select("level", *keys, "n", "total", "mean", "least", "most")


def flatten_profiles(profiles: DataFrame) -> DataFrame:
    """stage and seconds from nested profiles."""
    names = list(STAGE_TARGETS)
    parts = [profiles.select(F.lit(n).alias("stage"), F.explode(c).alias("x")).select("stage", F.col("x.latency_seconds").alias("seconds")) for n, c in zip(names, ("tier1_pages", "tier2_pages", "tier3_regions"), strict=False)]
    parts += [profiles.select(F.lit(n).alias("stage"), F.col(c).alias("seconds")).filter("seconds IS NOT NULL") for n, c in zip(names[3:], ("track_a_seconds", "track_b_seconds", "pipeline_total_seconds"), strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def benchmark_report(profiles: DataFrame) -> DataFrame:
    targets = profiles.sparkSession.createDataFrame(list(STAGE_TARGETS.items()), "stage string, target double")
    return latency_summary(flatten_profiles(profiles), targets)


def accuracy(rows: DataFrame, score: Column, least: float) -> DataFrame:
    """Mean of a score in per cent, and whether it reaches ``least``; false without rows."""
    return rows.agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg(score), F.lit(0.0)), 3).alias("accuracy")).withColumn("passed", (F.col("n") > 0) & (F.col("accuracy") >= least))


def text_scores(cases: DataFrame) -> DataFrame:
    """Of (document_id, extracted, ground_truth) the similarity of each case in per cent: document_id, score_percent."""
    return cases.select(F.coalesce("document_id", F.lit("unknown")).alias("document_id"), F.bround(text.sequence_ratio(F.col("extracted"), F.col("ground_truth")) * 100, 3).alias("score_percent"))


def text_accuracy(cases: DataFrame, least: float = 98.0) -> DataFrame:
    """Mean similarity of all cases, and whether it reaches ``least`` before it is rounded; false without cases."""
    found = text_scores(cases).agg(F.count("*").alias("n"), F.coalesce(F.avg("score_percent"), F.lit(0.0)).alias("mean"))
    return found.select("n", F.bround("mean", 3).alias("accuracy"), ((F.col("n") > 0) & (F.col("mean") >= least)).alias("passed"))


def mapping_accuracy(rows: DataFrame, least: float = 95.0) -> DataFrame:
    return accuracy(rows, F.when(F.trim("predicted") == F.col("expected"), 100.0).otherwise(0.0), least)


def routing_accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_and(F.col("actual") == F.col("expected")), F.lit(False)).alias("passed"), F.count("*").alias("n"))


def alarms(points: DataFrame, by: list[str], threshold: float, period: int, periods: int, statistic: str = "avg") -> DataFrame:
    """Windows of ``period`` seconds that end ``periods`` breaches in a row. Points: ts, value. A gap ends a row of breaches."""
    start = (F.floor(F.unix_seconds("ts") / period) * period).cast("long")
    per = points.groupBy(*by, start.alias("start")).agg(getattr(F, statistic)("value").alias("stat"))
    breach = per.withColumn("breach", (F.col("stat") > threshold).cast("int"))
    window = Window.partitionBy(*by).orderBy("start").rangeBetween(-(periods - 1) * period, 0)
    return breach.withColumn("alarm", F.coalesce(F.sum("breach").over(window), F.lit(0)) == periods)


def batch_number(df: DataFrame, n: int, order: str) -> DataFrame:
    """Numbers of batches of n rows, in order. Places come from counts of range partitions, so no task sees all rows."""
    parts = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    placed = parts.withColumn("_k", own)
    bases = placed.groupBy("_p").agg(F.max("_k").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(bases.select("_p", "_b")), "_p").withColumn("batch", F.floor((F.col("_b") + F.col("_k") - 1) / n)).drop("_p", "_k", "_b")


def queue_depth(events: DataFrame) -> DataFrame:
    """Outstanding messages per queue from events with delta +1 or -1."""
    return events.groupBy("queue").agg(F.sum("delta").alias("depth"))
