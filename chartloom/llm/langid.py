"""Language identification: what a text says, what it declares and where it comes from, joined by Bayes' rule.

Text likelihoods: hashed byte trigrams of the whole text under one smoothed distribution for each language. The
distributions are fitted on a bounded sample of declared documents (``sample`` rows); all else covers all rows.
Trigrams of one text are far from independent, so their mean log likelihood counts as at most ``weight`` observations.

Fused with it: how often a declared language comes with a language of the text (grouped counts), how often an address
suffix does, and a prior of the host. The prior is smoothed along a hierarchy: a host's expected counts lean on its
domain's, these on those of all rows, each with ``kappa`` rows' weight; a row's own count is taken out of its host's first.

Declared languages are compared without their region (en-GB and en_us are en). All that are declared take part.

Distribution: one pass over the texts gives a narrow table (an id and one number per language), and only that is grouped
and joined. Sums by host are combined before the shuffle, and a host with a third of all rows meets its sums in a
sort-merge join, which Spark splits. Tables by declared language are bounded by the number of languages.

A document is kept if its text has at least one trigram and the best language's posterior is at least ``least``. Edge cases:
null and empty texts have no evidence and aren't kept; null declared languages, suffixes and hosts are values like
others; a null id stays null; texts of any length are read whole; repeated rows count as rows; of equally likely languages
the first by name counts; extra columns are ignored, whatever their names; without any declared row nothing is kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import batch_of, blocks, bounded, written

BUCKETS = 1 << 15
_EVIDENCE = ["id", "text", "declared", "suffix", "host", "domain"]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts one after another (each padded by spaces), and where each text begins."""
    raw = [b" " + (x or "").encode("utf-8", "surrogatepass").lower() + b" " for x in texts]
    raw = [x if len(x) > 2 else b"" for x in raw]
    joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    lengths = np.array([len(x) for x in raw], np.int64)
    if not len(joined):
        return np.empty(0, np.int64), np.zeros(len(raw) + 1, np.int64)
    mixed = (joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA77) + joined[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    ends = np.cumsum(lengths)
    inside = np.ones(len(joined), bool)
    some = lengths > 0
    inside[ends[some] - 1] = inside[ends[some] - 2] = False
    return mixed[inside[: len(mixed)]].astype(np.int64), np.append(0, np.cumsum(np.maximum(0, lengths - 2)))


def fit(evidence: DataFrame, sample: int = 20_000, most_languages: int = 1024, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """All declared languages, and the log probability of each bucket under each.

    The table is held whole by every task, so more than ``most_languages`` declared values (there, they would be something
    else) raise ValueError; none is left out."""
    counts = evidence.filter("declared IS NOT NULL AND text IS NOT NULL").groupBy("declared").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} declared languages: clean the column or raise most_languages")
    languages = sorted(r.declared for r in counts)
    total = sum(r["count"] for r in counts)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    chance = {r.declared: min(1.0, sample / len(languages) / r["count"]) for r in counts}
    limit = F.create_map(*[x for k, v in chance.items() for x in (F.lit(k), F.lit(v))])
    drawn = evidence.filter(F.col("declared").isin(languages)).filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20) < F.element_at(limit, F.col("declared")))
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = np.empty(0, np.int64), np.empty(0, np.int64)  # only the pairs of language and bucket that the sample has
        for block in blocks(batches, "text", 2 << 20):
            grams, starts = trigrams(block["text"].to_pylist())
            of = np.repeat([place[x] for x in block["declared"].to_pylist()], np.diff(starts))
            own, times = np.unique(of * BUCKETS + grams, return_counts=True)
            at, where = np.unique(np.append(at, own), return_inverse=True)
            n = np.bincount(where, np.append(n, times), len(at)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

    rows = bounded(drawn.select("text", "declared")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow() if total else None
    at, n = (rows[c].to_numpy() for c in ("at", "n"))
    order = np.argsort(at)
    cuts = np.searchsorted(at[order], np.arange(len(languages) + 1) * BUCKETS)
    table = np.empty((len(languages), BUCKETS), np.float32)
    for i in range(len(languages)):
        own = order[cuts[i] : cuts[i + 1]]
        row = np.full(BUCKETS, alpha)
        row[at[own] - i * BUCKETS] += n[own]
        table[i] = np.log(row / row.sum())
    return languages, table


def text_evidence(evidence: DataFrame, languages: list[str], table: np.ndarray, weight: float) -> DataFrame:
    """id, declared, suffix, host, domain, grams (trigrams in the text) and ll, the tempered log likelihoods."""
    given = evidence.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T, np.float32))
    schema = pa.schema([("id", pa.int64()), ("declared", pa.string()), ("suffix", pa.string()), ("host", pa.string()), ("domain", pa.string()), ("grams", pa.int64()), ("ll", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 2 << 20):
            grams, starts = trigrams(block["text"].to_pylist())
            n = np.diff(starts)
            sums = np.zeros((len(n), len(languages)))
            some = np.flatnonzero(n)
            if len(some):
                sums[some] = np.add.reduceat(given.value[grams], starts[:-1][some], axis=0, dtype=np.float64)
            scaled = sums / np.maximum(1, n)[:, None] * (n / (1 + n / weight))[:, None]
            yield batch_of(schema, {c: block[c] for c in ("id", "declared", "suffix", "host", "domain")} | {"grams": n, "ll": list(np.round(scaled, 6))})

    return bounded(evidence.select(*_EVIDENCE)).mapInArrow(run, "id long, declared string, suffix string, host string, domain string, grams long, ll array<double>")


def posterior(parts: list[list[Column]]) -> Column:
    """Normalised exponentials of sums of log evidence, an array with one number per language."""
    sums = F.array(*[sum(c[1:], c[0]) for c in zip(*parts, strict=True)])
    shifted = F.transform(F.array(sums), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(F.array(shifted), lambda s: F.transform(s, lambda x: x / F.aggregate(s, F.lit(0.0), lambda a, y: a + y)))[0]


def _each(array: str, k: int) -> list[Column]:
    return [F.col(array)[i] for i in range(k)]


def identify(evidence: DataFrame, fitted: tuple[list[str], np.ndarray] | None = None, weight: float = 60.0, kappa: float = 20.0, least: float = 0.5) -> DataFrame:
    """id, declared, text_language, language, posterior, grams, kept; ``evidence``: id, text, declared, suffix, host, domain."""
    languages, table = fitted or fit(evidence)
    k = len(languages)
    if not k:
        return evidence.select("id", "declared", F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(0).cast("long").alias("grams"), F.lit(False).alias("kept"))
    said = text_evidence(evidence, languages, table, weight)
    known = F.when(F.col("declared").isin(languages), F.concat(F.lit("="), "declared")).otherwise(F.when(F.col("declared").isNull(), "none").otherwise("other"))
    own = written(said.withColumn("q", posterior([_each("ll", k)])).withColumn("known", known), "evidence")

    add = lambda: [F.sum(F.when(F.col("grams") > 0, F.col("q")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(k)]
    whole = [x or 0.0 for x in own.agg(*add()).first()]
    n_all = sum(whole) or 1.0
    global_prior = [(whole[i] + 1) / (n_all + k) for i in range(k)]

    def conditional(column: str) -> DataFrame:
        """log P(value | language), smoothed over the values."""
        sums = own.groupBy(column).agg(*add())
        return sums.select(F.col(column).alias("value"), *[F.log((F.col(f"s{i}") + 0.5) / (float(whole[i]) + 1.0)).alias(f"e{i}") for i in range(k)])

    declared = F.broadcast(conditional("known").select("value", F.array(*[f"e{i}" for i in range(k)]).alias("by_declared")))  # k + 2 rows
    suffix = conditional("suffix").select("value", F.array(*[f"e{i}" for i in range(k)]).alias("by_suffix"))
    domains = own.groupBy("domain").agg(*add(), F.count_if(F.col("grams") > 0).alias("n"))
    of_domain = domains.select("domain", F.array(*[(F.col(f"s{i}") + kappa * global_prior[i]) / (F.col("n") + kappa) for i in range(k)]).alias("d"))
    hosts = own.groupBy("host", "domain").agg(*add(), F.count_if(F.col("grams") > 0).alias("n"))
    of_host = hosts.join(of_domain, hosts.domain.eqNullSafe(of_domain.domain), "left").select(hosts.host.alias("h_host"), hosts.domain.alias("h_domain"), "n", F.array(*[f"s{i}" for i in range(k)]).alias("s"), "d")

    joined = own.join(declared, own.known == declared.value).drop("value")
    joined = joined.join(suffix, joined.suffix.eqNullSafe(suffix.value), "left").drop("value")
    joined = joined.join(of_host, joined.host.eqNullSafe(of_host.h_host) & joined.domain.eqNullSafe(of_host.h_domain), "left")
    mine = F.when(F.col("grams") > 0, 1.0).otherwise(0.0)
    prior = [F.log((F.greatest(F.col("s")[i] - mine * F.col("q")[i], F.lit(0.0)) + kappa * F.col("d")[i]) / (F.col("n") - mine + kappa)) for i in range(k)]
    fused = posterior([prior, _each("ll", k), _each("by_declared", k), _each("by_suffix", k)])
    names = F.array(*map(F.lit, languages))
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return (
        joined.withColumn("p", fused)
        .select("id", "declared", F.when(F.col("grams") > 0, best(F.col("q"))).alias("text_language"), best(F.col("p")).alias("language"), F.round(F.array_max("p"), 6).alias("posterior"), "grams")
        .withColumn("kept", (F.col("grams") > 0) & (F.col("posterior") >= least))
    )


def without_region(language: Column) -> Column:
    """Lower case, up to the first hyphen or underscore; null where nothing is left."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(language)), "^([^-_]*)", 1), F.lit(""))


def document_evidence(docs: DataFrame) -> DataFrame:
    """From documents: the declared language is ``lang``, the host is ``source``; there is no address."""
    null = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"), without_region(F.col("lang")).alias("declared"), null.alias("suffix"), F.col("source").cast("string").alias("host"), null.alias("domain"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """From web pages: the markup's language, and the address's last label, host and domain."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    labels = F.split(host, r"\.")
    return pages.select(F.col("page_id").cast("long").alias("id"), plain.alias("text"), declared.alias("declared"), F.get(F.reverse(labels), F.lit(0)).alias("suffix"), host.alias("host"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".").alias("domain"))
