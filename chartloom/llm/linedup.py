"""Line deduplication: repeated runs of lines are found by a suffix array over line ids, and later copies are deleted.

A line is deleted if it lies in a run of whole lines with at least ``min_words`` words that occurs earlier as well: in an
earlier document (by doc_id) or earlier in its own. The first occurrence always stays. Runs don't cross documents; lines
without a word are no part of the sequences, and go where they stand within a deleted run.

Method: only lines that occur twice at least can be part of a repeated run, so all others are left out at once. What is left
are short stretches of line ids, and their suffixes are ranked by prefix doubling: ranks of 2^k lines, taken in pairs at
distance 2^k, sort the suffixes by 2^(k+1) lines. A rank is the place of its class in sorted order; pairs that occur once
are dropped, because no longer run can repeat there. Each suffix is of interest up to the first line at which it reaches
``min_words`` words, so doubling stops there. A class of suffixes that agree up to that line is an interval of the suffix
array whose longest common prefix has at least that length; two overlapping ranks name it. All members of an interval
but the first are later copies. The same is done for runs that end at a line, so that the tail of a long repeated run
is covered too; the deleted lines then join into maximal runs.

Everything is DataFrame operations. What is shuffled are line hashes (128 bits), never lines; texts are shuffled once,
to join each document with its few deleted runs. Frequent lines and ranks are pre-aggregated before a shuffle and written;
the joins back to them read both sides from tables, so Spark splits the partitions of a line that very many documents have.

Edge cases: a null text stays null; repeated rows of the same doc_id and text count as one document; a null doc_id comes
before all others; texts of any length are compared whole; extra columns are kept, but for those named like one that is
added (removed_lines, removed_words), which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import written

#: ASCII white space.
_SPACE = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]+"


def repeated_lines(docs: DataFrame) -> DataFrame:
    """d (the document), idx (the line's place among lines with a word), pos, words and the line's id h1, h2, for repeated lines."""
    text = F.col("text").cast("string")
    with_place = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_SPACE)).alias("line")))
    lines = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("t")).alias("d"), F.posexplode(F.filter(with_place, lambda s: s.line != "")).alias("idx", "s"))
    hashed = written(lines.select("d", "idx", "s.pos", F.regexp_count("s.line", F.lit(_WORD)).alias("words"), F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit("second"), "s.line").alias("h2")), "lines")
    often = written(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "often")
    return hashed.join(often, ["h1", "h2"]).distinct()


def ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``keys`` with their place in sorted order as ``rank``."""
    parts = written(keys.repartitionByRange(*columns).withColumn("part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return parts.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*columns))).select(*columns, "rank")


def _reach(words: Column, min_words: int) -> Column:
    """How many of the leading elements add up to ``min_words``; null if all don't."""
    done = F.aggregate(words, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, w: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n"))))
    return F.when(done["sum"] >= min_words, done["n"])


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Add seg, one number for each stretch of neighbouring repeated lines, and the lengths fwd and back of the shortest
    runs with ``min_words`` words that begin and end at each line."""
    of_doc = Window.partitionBy("d").orderBy("idx")
    of_seg = Window.partitionBy("d", "seg").orderBy("idx")
    seg = lines.withColumn("seg", F.col("idx") - F.row_number().over(of_doc))
    ahead = F.collect_list("words").over(of_seg.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(of_seg.rowsBetween(1 - min_words, 0)))
    return seg.withColumn("fwd", _reach(ahead, min_words)).withColumn("back", _reach(behind, min_words))


def later_copies(state: DataFrame, k: int) -> DataFrame:
    """Runs of 2^k to 2^(k+1) - 1 lines that occur earlier too: d, start, len."""
    of_seg = Window.partitionBy("d", "seg").orderBy("idx")
    size = 1 << k
    rank = F.coalesce("rank", F.lit(-1))
    ahead = F.collect_list(rank).over(of_seg.rowsBetween(0, size - 1))
    behind = F.reverse(F.collect_list(rank).over(of_seg.rowsBetween(1 - 2 * size, 0)))
    runs = state.withColumn("ahead", ahead).withColumn("behind", behind)
    fits = lambda n: (F.col(n) >= size) & (F.col(n) < 2 * size)
    begin = runs.filter(fits("fwd")).select("d", F.col("idx").alias("start"), F.col("fwd").alias("len"), F.col("ahead")[0].alias("r1"), F.get("ahead", F.col("fwd") - size).alias("r2"))
    end = runs.filter(fits("back")).select("d", (F.col("idx") - F.col("back") + 1).alias("start"), F.col("back").alias("len"), F.get("behind", F.col("back") - 1).alias("r1"), F.get("behind", F.lit(size - 1)).alias("r2"))
    both = written(begin.unionByName(end).filter("r1 > 0 AND r2 > 0").distinct(), "runs")
    intervals = written(both.groupBy("len", "r1", "r2").agg(F.min(F.struct("d", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "intervals")
    return both.join(intervals, ["len", "r1", "r2"]).filter(F.struct("d", "start") != F.col("first")).select("d", "start", "len")


def deleted_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """d, from_pos, to_pos, lines, words: the maximal runs to delete."""
    lines = written(repeated_lines(docs), "repeated")
    marked = stretches(lines, min_words)
    first = ranked(lines.select("h1", "h2").distinct(), ["h1", "h2"])
    state = written(marked.join(first, ["h1", "h2"]).drop("h1", "h2"), "state")
    longest = state.agg(F.max(F.greatest("fwd", "back"))).first()[0] or 0
    found, k = [], 0
    while 1 << k <= longest:
        found.append(later_copies(state, k))
        k += 1
        if 1 << k <= longest:
            # stretches without a run of that length have nothing left to rank
            of_seg = Window.partitionBy("d", "seg")
            deeper = state.withColumn("most", F.max(F.greatest("fwd", "back")).over(of_seg)).filter(F.col("most") >= 1 << k).drop("most")
            paired = deeper.withColumnRenamed("rank", "r1").withColumn("r2", F.lead("r1", 1 << (k - 1)).over(of_seg.orderBy("idx")))
            again = paired.filter("r1 IS NOT NULL AND r2 IS NOT NULL").groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2")
            state = written(paired.join(ranked(again, ["r1", "r2"]), ["r1", "r2"], "left").drop("r1", "r2"), "state")
    if not found:
        return lines.limit(0).select("d", F.col("pos").alias("from_pos"), F.col("pos").alias("to_pos"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("words"))
    copies = found[0]
    for more in found[1:]:
        copies = copies.unionByName(more)
    covered = copies.select("d", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("idx")).distinct().join(lines.select("d", "idx", "pos", "words"), ["d", "idx"])
    island = F.col("idx") - F.row_number().over(Window.partitionBy("d").orderBy("idx"))
    return covered.withColumn("island", island).groupBy("d", "island").agg(F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"), F.count("*").alias("lines"), F.sum("words").alias("words")).drop("island")


def without_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with text less the runs; adds (or replaces) removed_lines and removed_words."""
    per_doc = runs.groupBy("d").agg(F.collect_list(F.struct("from_pos", "to_pos")).alias("cuts"), F.sum("lines").alias("cut_lines"), F.sum("words").alias("cut_words"))
    text = F.col("o.text").cast("string")
    cut = per_doc.select(F.col("d.id").alias("cut_id"), F.col("d.t").alias("cut_t"), "cuts", "cut_lines", "cut_words")
    joined = docs.select(F.struct("*").alias("o")).join(cut.hint("merge"), (F.col("o.doc_id").cast("long").eqNullSafe(F.col("cut_id"))) & (F.xxhash64(text) == F.col("cut_t")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.exists("cuts", lambda c: i.between(c.from_pos, c.to_pos))), "\n")
    new = F.when(F.col("cuts").isNull(), text).otherwise(kept)
    others = [F.col("o").getField(c).alias(c) if c != "text" else new.alias("text") for c in docs.columns if c.lower() not in ("removed_lines", "removed_words")]
    return joined.select(*others, F.coalesce("cut_lines", F.lit(0)).alias("removed_lines"), F.coalesce("cut_words", F.lit(0)).alias("removed_words"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All documents, with the text that is left and what was removed."""
    return without_runs(docs, written(deleted_runs(docs, min_words), "deleted"))
