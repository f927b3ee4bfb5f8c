"""Quality rules: a decision list over text statistics, learned by sequential covering and applied as a Spark expression.

Statistics are built-in expressions over each whole text. Labelled documents (a bounded sample, ``most`` rows) are split
into a growing and a pruning part. A rule grows by the condition ``feature <= t`` or ``feature > t`` with the best gain, the
thresholds being quantiles; conditions are then cut from its end as long as that helps on the pruning part, and the rule
is kept if it is precise there. The rows that it covers are set aside and the next rule is grown. Each growing step is
one small grouped aggregation; the driver sees only counts by feature and bin. The list becomes ``when`` after ``when``.

No Python runs on the executors. Nothing but labels and numbers is shuffled. Edge cases: null and empty texts have no words
and fail the base rule; texts of any length are counted whole; conditions that gain alike are taken in order of feature and threshold;
documents with a null id or without a label are judged but not learned from; without labels of both classes the
list is empty and only the base rule rejects; repeated rows are judged one by one; extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import written

#: Characters that stand between words (ASCII white space), and the characters that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "digit_share", "mark_share", "line_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three that occur twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a.getField("h") == b.getField("h"), F.lit(False))
        again = lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        places = let(placed, lambda s: F.flatten(F.transform(again(s), lambda x: F.array(x.i, x.i + 1, x.i + 2))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(F.size(F.array_distinct(places)))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(hashed, covered)).cast("long")


def measured(text: Column) -> Column:
    """A struct of the base statistics and the features of a text, each computed once."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    capitals, digits, marks = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?:;@/\\^~+=_()[]{}"
    count = lambda letters: (F.length(text) - F.length(without(text, letters))).cast("long")
    raw = F.struct(of_words.alias("w"), of_lines.alias("l"), F.length(without(text, SPACES)).cast("long").alias("chars"), count(SYMBOLS).alias("symbols"), count(capitals).alias("capitals"), count(digits).alias("digits"), count(marks).alias("marks"))

    def shares(r: Column) -> Column:
        n, again, n_lines, dup = r["w"]["n"], r["w"]["again"], r["l"]["n"], r["l"]["dup"]
        chars = r["chars"]
        share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        base = zip(BASE, (n, chars, r["symbols"], dup, again), strict=True)
        rest = {"mean_word": share(chars, n), "symbol_share": share(r["symbols"], chars), "dup_line_share": share(dup, n_lines), "repeat_share": share(again, n), "capital_share": share(r["capitals"], chars), "digit_share": share(r["digits"], chars), "mark_share": share(r["marks"], chars), "line_words": share(n, n_lines)}
        return F.struct(*[v.alias(k) for k, v in (*base, *rest.items())])

    return let(raw, shares)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics and the features."""
    return docs.select(F.col("doc_id").cast("long"), measured(F.col("text")).alias("s")).select("doc_id", "s.*")


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


Condition = tuple[str, str, float]


def holds(rule: list[Condition], of: Callable[[str], Column] = F.col) -> Column:
    out = F.lit(True)
    for name, op, t in rule:
        out = out & (of(name) <= t if op == "<=" else of(name) > t)
    return out


def learn(labelled: DataFrame, bins: int = 16, rules: int = 6, conditions: int = 3, precision: float = 0.95, support: int = 10) -> list[list[Condition]]:
    """Rules for bad documents, in order; ``labelled``: doc_id, FEATURES and bad (boolean), a bounded sample."""
    given = labelled.select("doc_id", *[F.col(f).cast("double").alias(f) for f in FEATURES], "bad")
    sample = written(given.withColumn("pruning", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0), "labelled")
    points = [i / bins for i in range(1, bins)]
    quantiles = sample.agg(*[F.percentile_approx(f, points, 2000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), points, 2000).alias(f"bad_{f}") for f in FEATURES]).first()
    edges = {f: sorted({*(quantiles[f] or []), *(quantiles[f"bad_{f}"] or [])}) for f in FEATURES}
    bin_of = lambda f: sum((F.when(F.col(f) > t, 1).otherwise(0) for t in edges[f]), F.lit(0))
    binned = written(sample.select("*", F.map_from_entries(F.array(*[F.struct(F.lit(f), bin_of(f)) for f in FEATURES])).alias("bin")), "binned")
    found: list[list[Condition]] = []
    left = F.lit(True)
    for _ in range(rules):
        rule: list[Condition] = []
        while len(rule) < conditions:
            rows = binned.filter(left & ~F.col("pruning") & holds(rule)).select(F.explode("bin").alias("feature", "b"), "bad").groupBy("feature", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = _best(rows, edges, support)
            if best is None:
                break
            rule.append(best)
        if rule:
            tests = [F.count_if(holds(rule[:k]) & F.col("bad")) for k in range(1, len(rule) + 1)] + [F.count_if(holds(rule[:k]) & ~F.col("bad")) for k in range(1, len(rule) + 1)]
            got = binned.filter(left & F.col("pruning")).agg(*tests).first()
            k = len(rule)
            worth = [(got[i] - got[k + i]) / max(1, got[i] + got[k + i]) for i in range(k)]
            cut = max(range(k), key=lambda i: (worth[i], -i))
            p, q = got[cut], got[k + cut]
            rule = rule[: cut + 1] if p + q >= support // 2 and p >= precision * (p + q) else []
        if not rule:
            break
        found.append(rule)
        left = left & ~holds(rule)
    return found


def _best(rows: list, edges: dict[str, list[float]], support: int) -> Condition | None:
    """The condition with the largest gain over the rows that the rule covers so far."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows:
        by.setdefault(r.feature, {})[r.b] = (r.p, r.n)
    if not by:
        return None
    some = next(iter(by.values()))
    p0, n0 = sum(x[0] for x in some.values()), sum(x[1] for x in some.values())
    if not p0 or not n0:
        return None
    best, found = 1e-9, None
    for feature in FEATURES:
        p = n = 0
        for b, t in enumerate(edges[feature]):
            add = by.get(feature, {}).get(b, (0, 0))
            p, n = p + add[0], n + add[1]
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                if pp < support:
                    continue
                gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                if gain > best:
                    best, found = gain, (feature, op, float(t))
    return found


def verdict(rules: list[list[Condition]], of: Callable[[str], Column] = F.col) -> Column:
    """The decision list: false by the first rule that holds, else true."""
    out = None
    for rule in rules:
        out = F.when(holds(rule, of), False) if out is None else out.when(holds(rule, of), False)
    return F.lit(True) if out is None else out.otherwise(True)


def rules_for(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[list[Condition]]:
    """Learn from ``most`` labelled documents at most, those whose ids' hashes come first. So few ids are broadcast."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).alias("bad"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    # written first: a filter on the statistics would else be pushed below the join and measure every document
    stats = written(texts.select("doc_id", "bad", measured(F.col("text")).alias("s")).select("doc_id", "bad", "s.*"), "measured")
    return learn(stats.filter(~base_failed()))


def judge(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, statistics, base_failed and kept for every document; rules are learned from labels (doc_id, quality)."""
    rules = rules_for(docs, labels, most)
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))


def good_documents(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The documents that are kept, whole rows. The verdict is one expression, so nothing is joined or shuffled."""
    rules = rules_for(docs, labels, most)
    return docs.filter(let(measured(F.col("text")), lambda s: ~base_failed(s.getField) & verdict(rules, s.getField)))
