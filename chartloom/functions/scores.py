"""Score arithmetic on columns. Scores lie between 0 and 1 unless a name says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components of the final score and their default weights.
COMPONENTS = {"textract": 0.25, "comprehend": 0.25, "faiss": 0.25, "llm_logprobs": 0.25}


def unit_interval(x: Column, default: float = 0.0) -> Column:
    """A number between 0 and 1: percentages (over 1) are divided by 100, what can't be read is the default."""
    n = x.try_cast("double")
    return F.when(n.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n))))


def resolve_weights(weights: dict[str, Column] | None = None) -> dict[str, Column]:
    """Weights that add up to 1; where all are zero, the defaults."""
    given = {k: unit_interval((weights or {}).get(k, F.lit(None)), d) for k, d in COMPONENTS.items()}
    total = reduce(lambda a, b: a + b, given.values())
    return {k: F.when(total > 0, F.try_divide(w, total)).otherwise(F.lit(COMPONENTS[k])) for k, w in given.items()}


def weighted_score(scores: dict[str, Column], weights: dict[str, Column] | None = None) -> Column:
    w = resolve_weights(weights)
    return F.bround(reduce(lambda a, b: a + b, (w[k] * scores[k] for k in COMPONENTS)), 6)


def unified_confidence(ocr: Column, coding: Column, llm: Column, letter_type: Column) -> Column:
    """Coding counts a fifth, but for letters whose tables can't be coded it doesn't count."""
    uncoded = letter_type.isin("Ambulance Clinical Report", "111 First ED Report")
    return F.when(uncoded, 0.5 * ocr + 0.5 * llm).otherwise(0.4 * ocr + 0.2 * coding + 0.4 * llm)


def self_weighted_confidence(c: Column) -> Column:
    """Aggregate: scores weighted by themselves."""
    return F.coalesce(F.bround(F.try_divide(F.sum(c * c), F.sum(c)), 4), F.lit(0.0))


def confidence_band(score: Column, threshold: float = 0.85, medium: float = 0.60) -> Column:
    return F.when(score >= threshold, "high").when(score >= medium, "medium").otherwise("low")


def recommendation(band: Column) -> Column:
    return F.when(band == "high", "bypass").when(band == "medium", "quick_review").otherwise("full_review")


def band_visual(band: Column) -> Column:
    """A band's label and colour for display."""
    known = F.create_map(*[x for k, label, colour in (("high", "High confidence", "green"), ("medium", "Check", "amber"), ("low", "Review", "red")) for x in (F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(colour).alias("colour")))])
    return F.try_element_at(known, band)


def quality_badge(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold, "high").when(score >= 0.75 * threshold, "check").otherwise("low")


def blend_confidence(accepted: Column, ocr: Column, llm: Column) -> Column:
    return F.bround(F.when(accepted, (ocr + llm) / 2).otherwise(ocr), 4)


def cost_savings(base: Column, optimised: Column) -> Column:
    """Per cent saved; nothing where there was no cost."""
    return F.when(base <= 0, 0.0).otherwise(F.bround(F.try_divide(base - optimised, base) * 100, 2))


def batch_status(failed: Column, total: Column) -> Column:
    return F.when((total > 0) & (failed == total), "FAILED").when(failed > 0, "PARTIAL").otherwise("SUCCESS")


def layout_complexity(tables: Column, titles: Column, megapixels: Column) -> Column:
    least = lambda most, x: F.least(F.lit(most), x)
    return F.least(F.lit(1.0), least(0.3, 0.1 * tables) + least(0.3, 0.05 * titles) + least(0.4, 0.2 * megapixels))


def bbox(box: Column) -> Column:
    """Corners from left, top, width and height."""
    at = lambda n: box.getField(n)
    return F.when(box.isNull(), F.array().cast("array<double>")).otherwise(F.array(at("Left"), at("Top"), at("Left") + at("Width"), at("Top") + at("Height")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
