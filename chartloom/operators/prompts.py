"""Deterministic assignment of prompt versions, rendering and composition of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_weights(weights: Column) -> Column:
    """A map of strings to shares: what isn't a positive number is dropped."""
    good = F.map_filter(F.transform_values(weights, lambda _, w: w.try_cast("double")), lambda _, w: F.coalesce(w > 0, F.lit(False)))
    total = F.aggregate(F.map_values(good), F.lit(0.0), lambda a, w: a + w)
    return F.transform_values(good, lambda _, w: w / total)


def unit_hash(template: Column, document: Column, role: Column, salt: Column) -> Column:
    """A number between 0 and 1 that depends on these alone."""
    digest = F.sha2(F.concat_ws("|", template, document, role, salt), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def assign_variant(requests: DataFrame) -> DataFrame:
    """version and mode: a forced version, else by the weights of an A/B test, else the active one.

    Versions are tried in order of their names against the running sum of their shares.
    """
    shares = F.array_sort(F.map_entries(normalise_weights(F.col("weights"))))
    running = F.aggregate(
        shares,
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("version")),
        lambda a, s: F.struct((a["sum"] + s["value"]).alias("sum"), F.coalesce(a["version"], F.when(F.col("u") <= a["sum"] + s["value"], s["key"])).alias("version")),
        lambda a: a["version"],
    )
    hashed = requests.withColumn("u", unit_hash(F.col("template"), F.col("document_id").cast("string"), F.col("role"), F.coalesce("salt", "template")))
    tested = hashed.withColumn("ab", F.when(F.col("enabled"), running))
    mode = F.when(F.col("forced").isNotNull(), "forced").when(F.col("ab").isNotNull(), "ab_test").otherwise("active")
    return tested.withColumn("version", F.coalesce("forced", "ab", "active_version", F.lit("v1"))).withColumn("mode", mode).drop("ab", "u")


def render_template(template: Column, variables: dict[str, Column]) -> Column:
    """rendered text with the hashes of template and text."""
    out = template
    for name, value in variables.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.struct(out.alias("rendered"), F.sha2(template, 256).alias("template_sha256"), F.sha2(out, 256).alias("rendered_sha256"))


def compose_prompt(system: Column, task: Column, style: Column, contexts: Column, text: Column, most: int = 12_000, first: int = 3) -> Column:
    """Three templates, the first contexts numbered, and as much of the text as fits."""
    numbered = F.transform(F.slice(contexts, 1, first), lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    prompt = F.concat_ws("\n\n", system, task, style, F.array_join(numbered, "\n"), F.substring(text, 1, most))
    return F.struct(prompt.alias("prompt"), (F.length(text) > most).alias("truncated"))


def active_version(change_log: DataFrame, as_of: str | None = None) -> DataFrame:
    """Per template the version after the last change, up to a time."""
    log = change_log.filter(F.col("action").isin("SET_ACTIVE", "ROLLBACK", "CONFIGURE"))
    log = log.filter(F.col("ts") <= F.lit(as_of)) if as_of else log
    last = Window.partitionBy("template").orderBy(F.desc("ts"), F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("template", F.col("after_version").alias("active_version"), "action", "ts")
