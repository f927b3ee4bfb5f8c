"""Embedding, vector tables and exact top-k retrieval. Models are callables on arrays of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Default model: signed counts of hashed words. Deterministic, needs no weights."""
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            out[i, h % size] += 1 if h >> 63 else -1
    return out


def embed(df: DataFrame, text: str = "text", model: Callable[[list[str]], np.ndarray] = hash_embedding, most: int = 8000) -> DataFrame:
    """Add embedding. Each distinct text goes to the model once, in Arrow batches."""
    key = F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, most), 256)
    keyed = df.withColumn("_key", key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "embedding": list(model(b["_text"].tolist()))})

    distinct = keyed.select("_key", F.substring(F.coalesce(text, F.lit("")), 1, most).alias("_text")).dropDuplicates(["_key"])
    return keyed.join(distinct.mapInPandas(run, "_key string, embedding array<float>"), "_key").drop("_key")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Of length 1; null for a zero vector."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))[0]


def build_vector_table(df: DataFrame, least: int = 50_000) -> DataFrame:
    """Normalised vectors; refused when there are too few."""
    if (n := df.count()) < least:
        raise ValueError(f"{n} vectors; at least {least} are needed")
    return df.withColumn("embedding", normalised(F.col("embedding")))


def _rows(got: pa.Table, unit: bool) -> np.ndarray:
    """The embeddings of a table as a matrix, of length 1 if ``unit`` (not-a-number for zero vectors)."""
    column = got["embedding"].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, length, where=length > 0, out=np.full_like(flat, np.nan)) if unit else flat


def _best(k: int, cosine: bool, tile: int):
    """Of two groups of rows the k nearest to each query, by tiles of scores; what a tile adds is merged with the best so far."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        n, found = q.num_rows if v.num_rows else 0, []
        for i in range(0, n, tile):
            some = q.slice(i, tile)
            left, number = _rows(some, cosine), some["query_id"].to_numpy()
            score, ids = np.full((len(left), 0), 0.0), np.full((len(left), 0), 0)
            for j in range(0, v.num_rows, tile):
                part = v.slice(j, tile)
                new = np.round(left @ _rows(part, cosine).T, 6)
                new[np.isnan(new)] = -np.inf
                score, ids = np.hstack([score, new]), np.hstack([ids, np.broadcast_to(part["id"].to_numpy(), new.shape)])
                if score.shape[1] > k:
                    order = np.lexsort((ids, -score), axis=1)[:, :k] if score.shape[1] <= 4 * k else _first(score, ids, k)
                    score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
            row, place = np.nonzero(np.isfinite(score))
            found.append((number[row], ids[row, place], score[row, place]))
        columns = [np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "id", "score"), columns, strict=True)))

    return run


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties by id: a partition finds the k-th score, and only ties with it are ordered."""
    bar = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(score), k), np.int64)
    for i, over in enumerate(score >= bar):
        at = np.flatnonzero(over)
        out[i] = at[np.lexsort((ids[i, at], -score[i, at]))[:k]]
    return out


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, cosine: bool = True, part_bytes: int = 32 << 20, tile: int = 1024) -> DataFrame:
    """query_id, id, score and rank of the k vectors nearest to each query, ties by id. Null vectors are left out.

    Queries are the small side. Queries and vectors are dealt into parts of about ``part_bytes`` of 32-bit numbers; each pair of
    parts meets once, and the bests of all parts meet in a window. No pair becomes a row. A task holds two parts, a tile of each in
    64 bits, and one tile's scores with the best so far: under 200 MB with vectors of up to 4,096 numbers.
    """
    some = vectors.filter("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
    rows = max(1, part_bytes // (4 * (some.n if some else 1)))
    blocks, parts = (max(least, -(-df.count() // rows)) for df, least in ((queries, 1), (vectors, queries.sparkSession.sparkContext.defaultParallelism)))

    def dealt(df: DataFrame, key: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        given = df.filter("embedding IS NOT NULL").select(F.col(key).cast("long"), "embedding", F.pmod(F.xxhash64(key), F.lit(own[1])).cast("long").alias(own[0]))
        return given.withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other[1] - 1).cast("long"))))

    block, part = ("block", blocks), ("part", parts)
    q, v = dealt(queries, "query_id", block, part).groupBy("block", "part"), dealt(vectors, "id", part, block).groupBy("block", "part")
    pairs = q.cogroup(v).applyInArrow(_best(k, cosine, tile), "query_id long, id long, score double")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k)


def retrieval_confidence(cosine: Column) -> Column:
    return F.bround((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)) + 1) / 2, 4)


def token_overlap(pairs: pd.DataFrame) -> pd.Series:
    """Default scorer: the share of the query's words that a candidate has."""
    share = lambda a, b: len(set(a.lower().split()) & set(b.lower().split())) / max(1, len(set(a.lower().split())))
    return pd.Series([share(a or "", b or "") for a, b in zip(pairs["query"], pairs["candidate"], strict=True)])


def rerank(candidates: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None = token_overlap) -> DataFrame:
    """Order candidates (query_id, query, candidate, rank) by a pair score; without a scorer the order stays."""
    if scorer is None:
        return candidates.withColumn("confidence", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def score(q: pd.Series, c: pd.Series) -> pd.Series:
        return scorer(pd.DataFrame({"query": q, "candidate": c}))

    scored = candidates.withColumn("pair_score", score("query", "candidate")).withColumn("confidence", 1 / (1 + F.exp(-F.col("pair_score"))))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pair_score"), "rank")))


def retrieve_context(docs: DataFrame, chunks: DataFrame, k: int = 5, scope: str = "document", model: Callable = hash_embedding) -> DataFrame:
    """For each document (doc_id, doc_type, first_chunk) the k chunks nearest to a summary request.

    ``scope``: 'document' looks among a document's own chunks, 'corpus' among all.
    """
    ask = F.concat(F.lit("Summarize this "), "doc_type", F.lit(": "), F.substring("first_chunk", 1, 200))
    queries = embed(docs.select(F.col("doc_id").alias("query_id"), ask.alias("text")), "text", model)
    vectors = embed(chunks.select(F.col("chunk_no").alias("id"), "doc_id", F.col("chunk").alias("text")), "text", model)
    if scope == "corpus":
        return knn(queries, vectors, k, cosine=False)
    pairs = queries.select("query_id", F.col("embedding").alias("q")).join(vectors, F.col("query_id") == F.col("doc_id"))
    score = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    ranked = pairs.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def semantic_fallback(vectors: DataFrame, model: Callable = hash_embedding, scorer: Callable | None = token_overlap, k: int = 10) -> Callable[[DataFrame], DataFrame]:
    """A fallback for ``map_entities``: a term with its context is embedded, its k nearest descriptions (id, code, description,
    embedding) are ranked by the scorer, and the best gives the code, its cosine the confidence."""

    def run(keys: DataFrame) -> DataFrame:
        asked = keys.withColumn("query", F.concat_ws(" [SEP] ", "term", "context")).withColumn("query_id", F.xxhash64("key"))
        near = knn(embed(asked, "query", model).select("query_id", "embedding"), vectors.select("id", "embedding"), k)
        named = near.join(vectors.select("id", "code", F.col("description").alias("candidate")), "id").join(asked.select("query_id", "key", F.col("term").alias("query")), "query_id")
        best = rerank(named.select("query_id", "key", "query", "candidate", "code", "score", "rank"), scorer).filter("rank = 1")
        return best.select("key", "code", retrieval_confidence(F.col("score")).alias("confidence"))

    return run
