"""The final score of a document and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import scores


def entity_source_means(entities: DataFrame, by: str = "doc_id") -> DataFrame:
    """Mean confidence of coded entities and of those from the fallback; 0 where a document has none."""
    mean = lambda s: F.coalesce(F.avg(F.when(F.col("source") == s, scores.unit_interval(F.col("score")))), F.lit(0.0))
    return entities.groupBy(by).agg(mean("comprehend_medical").alias("comprehend"), mean("semantic_fallback").alias("faiss"))


def fill_components(given: DataFrame, found: DataFrame, by: str = "doc_id") -> DataFrame:
    """Given scores, and for those that are zero or missing what was found in a document's artefacts."""
    joined = given.alias("g").join(found.alias("f"), by, "left")
    part = lambda k: F.coalesce(F.nullif(scores.unit_interval(F.col(f"g.{k}")), F.lit(0.0)), F.col(f"f.{k}"), F.lit(0.0)).alias(k)
    return joined.select(by, *[part(k) for k in scores.COMPONENTS])


def route_final(components: DataFrame, threshold: float = 0.85, weights: dict[str, Column] | None = None) -> DataFrame:
    """Add final_score and route: at or over the threshold past review, else to it."""
    bar = threshold / 100 if threshold > 1 else threshold
    scored = components.withColumn("final_score", scores.weighted_score({k: F.col(k) for k in scores.COMPONENTS}, weights))
    return scored.withColumn("route", F.when(F.col("final_score") >= bar, "bypass_database").otherwise("human_review"))


def route_payload(routed: DataFrame) -> DataFrame:
    """The message of each document."""
    w = scores.resolve_weights()
    return routed.withColumn("payload", F.to_json(F.struct("doc_id", "final_score", "route", F.struct(*scores.COMPONENTS).alias("components"), F.struct(*[v.alias(k) for k, v in w.items()]).alias("weights"))))


_STORED = "unified_confidence_score string, threshold string, route string, body string"


def confidence_bundle(documents: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Documents with components and stored JSON: a stored score (or one nested in its body) wins over a computed one."""
    stored = F.from_json("stored", _STORED)
    nested = F.from_json(stored.getField("body"), _STORED)
    pick = lambda k: F.coalesce(stored.getField(k), nested.getField(k))
    computed = route_final(documents, threshold)
    score = F.coalesce(pick("unified_confidence_score").try_cast("double"), F.col("final_score"))
    bar = scores.unit_interval(pick("threshold"), threshold)
    return computed.withColumn("score", score).withColumn("threshold", bar).withColumn("route", F.coalesce(pick("route"), F.when(score >= bar, "bypass_database").otherwise("human_review"))).withColumn("band", scores.confidence_band(F.col("score")))


def split_escalations(elements: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Accepted elements and those to escalate."""
    low = F.coalesce(F.col("conf") < threshold, F.lit(True))
    return elements.filter(~low), elements.filter(low)


def review_required(documents: DataFrame, thresholds: DataFrame, default: float = 0.72) -> DataFrame:
    """Scores under their type's threshold. ``thresholds``: letter_type, threshold; a table of types."""
    joined = documents.join(thresholds, "letter_type", "left")
    bar = F.coalesce("threshold", F.lit(default))
    return joined.withColumn("threshold", bar).withColumn("review_required", F.col("score") < bar)


def needs_second_pass(score: Column, low: float = 0.60, high: float = 0.85) -> Column:
    return (score >= low) & (score < high)


def tier_entities(entities: DataFrame) -> DataFrame:
    """A diagnosis trait first, then the score decides."""
    diagnosis = F.exists("traits", lambda t: F.upper(t) == "DIAGNOSIS")
    return entities.withColumn("tier", F.when(diagnosis, "diagnosis").when(F.col("score") >= 0.70, "significant").when(F.col("score") >= 0.30, "minor").otherwise("problem"))


def normalise_actions(items: Column, today: Column) -> Column:
    """Structs (text, priority, due_date, assignee): titles for priorities, a week from today for dates that can't be read."""
    title = lambda p: F.when(F.initcap(F.coalesce(p, F.lit(""))).isin("High", "Medium", "Low"), F.initcap(p)).otherwise("Medium")
    due = lambda d: F.coalesce(F.substring(d, 1, 10).try_cast("date"), F.date_add(today, 7))
    made = F.transform(items, lambda x: F.struct(F.trim(F.coalesce(x.getField("text"), F.lit(""))).alias("text"), title(x.getField("priority")).alias("priority"), due(x.getField("due_date")).alias("due_date"), F.coalesce(x.getField("assignee"), F.lit("")).alias("assignee")))
    return F.filter(made, lambda x: x.getField("text") != "")


def serialise_actions(items: Column) -> Column:
    """As JSON; only actions without text, assignee and code are dropped."""
    empty = lambda x, n: F.trim(F.coalesce(x.getField(n), F.lit(""))) == ""
    return F.to_json(F.filter(items, lambda x: ~(empty(x, "text") & empty(x, "assignee") & empty(x, "code"))))


def parse_actions(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^-+\s*", ""))), lambda x: x != "")


def format_actions(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
