"""How far the words of each source of a language lie from those of the language and of its other sources.

Method (iceberg prefix refinement): texts are read once into a table of terms, each task with a row per language and term that
holds its counts by source and at most ``least`` of its documents. Byte prefixes of a first length are then counted by distinct
documents over all languages; those below the threshold go, with every term under them, and the terms that are left are counted by
prefixes of twice the length, until each prefix that is left is a whole term. Only terms that are kept are summed up by source,
so that the long tail of rare strings is never shuffled by whole terms. A task names up to ``least`` documents of a prefix; as
documents differ between rows, that many distinct ones are found over all tasks if and only if there are that many.

Divergence of p from q at a term is floor((p - q)^2 / q) in whole numbers, with smoothed shares p and q of 10^9. Sources that lack
a term share one value of p, so the sum over all kept terms splits into two sums over how often each p occurs in a source, and a
correction over terms that both sources have. Both are computed for pairs of blocks of sources, the correction in blocks of terms.

Edge cases: null text, lang and source are ''; a document without terms still makes its source occur; rows count as documents,
so repeated rows and rows with a null or shared doc_id count each; a term of any length is kept whole; texts of any
length are cut into slices between terms; ties in value go by the item's bytes; an empty table gives no rows; other columns,
whatever their names, are ignored. A language without kept terms gives pairs of value 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import batch_of, blocks, bounded, small, written

#: Terms are made of ASCII letters and of the bytes of all other characters beyond ASCII; A-Z count as a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
SCALE = 1_000_000_000

_TERMS = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_PREFIXES = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("complete", pa.bool_()), ("doc", pa.int64()), ("docs", pa.int64())])
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_PAIRS_DDL = "lang string, source string, item string, value long"


def slices(data: bytes, most: int) -> Iterator[bytes]:
    """Runs of about ``most`` bytes, cut at spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    differs = np.zeros(len(columns[0]), bool)
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    differs[:1] = True
    return np.flatnonzero(differs)


def _lists(values: pa.Array, starts: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Values as lists by row; ``starts``: where each value's run begins, ``rows``: where each row does."""
    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(starts, rows), len(starts)), pa.int32()), values)


def _block_terms(held: list[tuple[str, str, int, bytes]], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_TERMS`` of the given texts (lang, source, document, words between spaces)."""
    held.sort(key=lambda h: h[:3])
    cut = pc.ascii_split_whitespace(pa.array([h[3] for h in held], pa.binary()).view(pa.string()))
    coded = cut.flatten().dictionary_encode()
    place = np.repeat(np.arange(len(held)), pc.list_value_length(cut).to_numpy())
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    full = pc.binary_length(words).to_numpy()[codes] > 0 if len(codes) else np.empty(0, bool)
    pairs, times = np.unique(codes[full] * len(held) + place[full], return_counts=True)
    if not len(pairs):
        return
    code, at = np.divmod(pairs, len(held))
    names = [pa.array([h[i] for h in held], pa.string()).dictionary_encode() for i in (0, 1)]
    lang, source = (x.indices.to_numpy()[at] for x in names)
    doc = np.array([h[2] for h in held], np.int64)[at]
    rows, entries, seen = _starts(code, lang), _starts(code, lang, source), _starts(code, lang, doc)
    early = np.arange(len(seen)) - np.searchsorted(seen, rows)[np.searchsorted(rows, seen, "right") - 1] < least
    seen = seen[early]
    columns = {
        "lang": names[0].dictionary.take(pa.array(lang[rows])),
        "term": words.take(pa.array(code[rows])).view(pa.binary()),
        "docs": _lists(pa.array(doc[seen]), seen, rows),
        "sources": _lists(names[1].dictionary.take(pa.array(source[entries])), entries, rows),
        "counts": _lists(pa.array(np.add.reduceat(times, entries), pa.int64()), entries, rows),
    }
    whole = batch_of(_TERMS, columns)
    yield from (whole.slice(i, 20_000) for i in range(0, len(rows), 20_000))


def term_table(docs: DataFrame, least: int = 3, block_bytes: int = 24 << 20) -> DataFrame:
    """A row per block of ``block_bytes`` of text, language and term: up to ``least`` of its documents, and the counts by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held, size = [], 0
        for block in blocks(batches, "text", 4 << 20):
            for lang, source, text in zip(*(block[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                for part in slices(text.translate(TERM_BYTES), block_bytes):
                    held.append((lang, source, number, part))
                    size += len(part)
                    if size >= block_bytes:
                        yield from _block_terms(held, least)
                        held, size = [], 0
                number += 1
        yield from _block_terms(held, least) if held else ()

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return bounded(given).mapInArrow(run, "lang string, term binary, docs array<long>, sources array<string>, counts array<long>")


def frequent_prefixes(terms: DataFrame, length: int, least: int = 3, most_rows: int = 200_000) -> DataFrame:
    """Prefixes of ``length`` bytes in at least ``least`` documents: lang, prefix, complete (it is a whole term).

    Of each run of rows a prefix is sent once if that run alone has enough documents of it, else with its documents.
    """

    def counted(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(rows).combine_chunks()
        prefix, lang = (c.combine_chunks().dictionary_encode() for c in (pc.binary_slice(got["term"], 0, length), got["lang"]))
        whole = pc.less_equal(pc.binary_length(got["term"]), length).to_numpy()
        key = (prefix.indices.to_numpy().astype(np.int64) * 2 + whole) * len(lang.dictionary) + lang.indices.to_numpy()
        docs = got["docs"].combine_chunks()
        owner, doc = np.repeat(key, pc.list_value_length(docs).to_numpy()), docs.flatten().to_numpy()
        order = np.lexsort((doc, owner))
        owner, doc = owner[order], doc[order]
        each = _starts(owner, doc)
        owner, doc = owner[each], doc[each]
        groups = _starts(owner)
        enough = np.diff(np.append(groups, len(owner))) >= least
        which = np.searchsorted(groups, np.arange(len(owner)), "right") - 1
        sent = ~enough[which]
        sent[groups] = True
        owner, doc, enough = owner[sent], doc[sent], enough[which][sent]
        code, complete = np.divmod(owner // len(lang.dictionary), 2)
        columns = {"lang": lang.dictionary.take(pa.array(owner % len(lang.dictionary))), "prefix": prefix.dictionary.take(pa.array(code)), "complete": pa.array(complete == 1), "doc": pa.array(doc, mask=enough), "docs": pa.array(np.where(enough, least, 1))}
        found = batch_of(_PREFIXES, columns)
        yield from (found.slice(i, 50_000) for i in range(0, len(found), 50_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most_rows:
                yield from counted(held)
                held, size = [], 0
        yield from counted(held) if size else ()

    found = bounded(terms.select("lang", "term", "docs")).mapInArrow(run, "lang string, prefix binary, complete boolean, doc long, docs long")
    distinct = found.repartition("lang", "prefix", "complete").groupBy("lang", "prefix", "complete", "doc").agg(F.max("docs").alias("docs"))
    return distinct.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")


def kept_terms(terms: DataFrame, least: int = 3, first_length: int = 4) -> DataFrame:
    """Terms in at least ``least`` documents of their language, by refinement of prefixes: lang, term."""
    kept, length, left = None, first_length, terms
    while True:
        found = written(frequent_prefixes(left, length, least), "prefixes")
        whole, begun = found.filter("complete").select("lang", F.col("prefix").alias("term")), found.filter("NOT complete").select("lang", "prefix")
        kept = whole if kept is None else kept.unionByName(whole)
        if begun.isEmpty():
            return kept
        longer = terms.select("lang", "term", "docs", F.substring("term", 1, length).alias("prefix")).filter(F.length("term") > length)
        left = longer.join(small(begun), ["lang", "prefix"], "left_semi")
        length *= 2


def _share(count: str, of: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (of + terms)), beyond 64 bits inside."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({count} + 1)) div greatest({of} + terms, 1)")


def _divergence(p, q):
    return (p - q) * (p - q) // q


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Each row for every pair of blocks that its own block is in: low, high."""
    every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other")


def _pair_rows(lang: str, names: list[str], block: np.ndarray, alike: bool, values: np.ndarray, wanted: np.ndarray) -> pa.Table:
    """Values as rows: of pairs within the block if both are ``alike``, else of pairs from one to the other."""
    wanted = wanted & (alike | (block[:, None] != block[None, :]))
    np.fill_diagonal(wanted, False)
    a, b = np.nonzero(wanted)
    named = pa.array(names, pa.string())
    return pa.table([pa.array([lang] * len(a), pa.string()), named.take(pa.array(a)), named.take(pa.array(b)), pa.array(values[a, b], pa.int64())], schema=_PAIRS)


def _numbered(got: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names of sources, each row's source, and the block and the share of absent terms of each source."""
    coded = got["source"].combine_chunks().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    first = np.unique(codes, return_index=True)[1]
    return names, codes, *(got[c].to_numpy()[first] for c in ("block", "absent"))


def _absent_sums(key: tuple, got: pa.Table) -> pa.Table:
    """Sums over all kept terms as if no two sources shared one: from how many terms of a source have each share."""
    names, codes, block, absent = _numbered(got)
    times, share = got["times"].to_numpy(), got["share"].to_numpy()
    size = np.bincount(codes, times, len(names)).astype(np.int64)
    values = (got["terms"][0].as_py() - size[:, None] - size[None, :]) * _divergence(absent[:, None], absent[None, :])
    for i in range(len(names)):
        own = codes == i
        for at in range(0, int(own.sum()), 8192):
            p, n = share[own][at : at + 8192, None], times[own][at : at + 8192, None]
            values[i] += (n * _divergence(p, absent[None, :])).sum(axis=0)
            values[:, i] += (n * _divergence(absent[None, :], p)).sum(axis=0)
    return _pair_rows(key[0].as_py(), names, block, key[1] == key[2], values, np.ones(values.shape, bool))


def _shared_terms(key: tuple, got: pa.Table) -> pa.Table:
    """What the sums above miss at terms that two sources share, for one block of terms."""
    names, codes, block, absent = _numbered(got)
    terms = got["term"].combine_chunks().dictionary_encode()
    shape = (len(names), len(terms.dictionary))
    share, has = np.ones(shape, np.int64), np.zeros(shape, bool)
    at = (codes, terms.indices.to_numpy())
    share[at], has[at] = got["share"].to_numpy(), True
    values, wanted = np.zeros((shape[0], shape[0]), np.int64), np.zeros((shape[0], shape[0]), bool)
    other = absent[:, None]
    for i in range(shape[0]):
        mine = has[i]
        p, q, both = share[i, mine][None, :], share[:, mine], has[:, mine]
        none = _divergence(absent[i], other)
        missed = _divergence(p, q) - _divergence(p, other) - _divergence(absent[i], q) + none
        values[i], wanted[i] = np.where(both, missed, 0).sum(axis=1), both.any(axis=1)
    return _pair_rows(key[0].as_py(), names, block, key[2] == key[3], values, wanted)


def audit(docs: DataFrame, least: int = 3, top: int = 200, first_length: int = 4, block_sources: int = 128, block_terms: int = 4096) -> DataFrame:
    """Rows of two parts: lang, source, part, item, value, rank.

    ``pair``: the source's divergence from each other source of its language. ``term``: its ``top`` terms that are more frequent in
    it than in the language. A pair of blocks of sources and a block of terms is one task's work.
    """
    terms = written(term_table(docs, least), "terms")
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    kept = written(kept_terms(terms, least, first_length), "kept")
    left = terms.join(small(kept), ["lang", "term"], "left_semi")
    single = left.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", "term", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    summed = single.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = written(summed.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))), "counts")  # as many rows as sources

    sums = written(counts.groupBy("lang", "source").agg(F.sum("n").alias("source_all")), "sums")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_all"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("lang_sources")).join(langs, "lang", "left").join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    groups = named.join(sums, ["lang", "source"], "left").join(sizes, "lang").na.fill(0, ["terms", "lang_all", "source_all"])
    groups = groups.withColumn("blocks", F.ceil(F.col("lang_sources") / block_sources).cast("int")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = written(groups.select("lang", "source", "terms", "lang_all", "source_all", "blocks", "block", _share("CAST(0 AS LONG)", "source_all").alias("absent")), "groups")

    shares = counts.join(small(groups), ["lang", "source"]).select("lang", "source", "term", "terms", "block", "blocks", "absent", _share("n", "source_all").alias("share"), _share("lang_n", "lang_all").alias("lang_share"))
    shares = written(shares, "shares")
    value = F.expr("(share - lang_share) * (share - lang_share) div lang_share")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    above = shares.filter("share > lang_share").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    best = above.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / block_terms))
    common = _in_blocks(shares.select("lang", "source", "term", "share", "absent", "block", "blocks", chunk.alias("chunk"))).groupBy("lang", "chunk", "low", "high").applyInArrow(_shared_terms, _PAIRS_DDL)
    times = shares.groupBy("lang", "source", "terms", "absent", "block", "blocks", "share").agg(F.count("*").alias("times"))
    without = groups.select("lang", "source", "terms", "absent", "block", "blocks", F.lit(1).cast("long").alias("share"), F.lit(0).cast("long").alias("times"))
    apart = _in_blocks(times.unionByName(without)).groupBy("lang", "low", "high").applyInArrow(_absent_sums, _PAIRS_DDL)
    pairs = apart.unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(best.withColumn("item", F.col("item").cast("string"))).select("lang", "source", "part", "item", "value", "rank")
