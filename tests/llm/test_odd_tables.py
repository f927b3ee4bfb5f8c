"""Every registered query over tables of documents that are odd, and over empty ones: nothing crashes, no row is lost."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartloom.llm import registry

#: One row a document, whatever it holds.
ONE_EACH = ["op1_simhash", "op2_language", "op5_sharding", "op6_line_dedup", "op7_quality", "op8_avi", "op9_token_files", "op10_bpe", "op12_infill", "op13_licenses"]
CLASHING = ["id", "fp", "component_id", "language", "posterior", "size", "shard", "slot", "removed_lines", "n_words", "kept", "n_bytes", "feature", "start", "n_tokens", "ids_sha256", "part", "item", "value", "rank", "form", "labels", "score", "piece", "sequence_id"]


def tables(spark, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0 if not rows else 50).write.parquet(f"{path}/labels.parquet")
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(len(rows)).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(2000)]
    long = " ".join(rng.choices(words, k=1_000_000))  # over 5 MB: more than a block of any operator
    line = " ".join(rng.choices(words, k=60))
    texts = [long, None, "", "\n", "x" * 200_000, line, f"{line}\n{line}", line, "é漢 <P> under the MIT license", long[: 1 << 20]]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    return tables(spark, tmp_path_factory.mktemp("odd"), [*rows, rows[5], (None, line, "en", "s", 9), (None, None, None, None, None)]), len(texts) + 3


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", ONE_EACH)
def test_odd_rows_come_back_one_each(spark, odd, name):
    path, n = odd
    got = registry.queries()[name](spark, path)
    assert got.count() == n


@pytest.mark.parametrize("name", ["op4_packing", "op11_divergence", "pages_language"])
def test_odd_rows_are_taken_whole(spark, odd, name):
    assert registry.queries()[name](spark, odd[0]).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def test_the_pipeline_takes_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert set(corpus_pipeline.run(spark, odd[0]).columns) >= {"doc_id", "piece", "sequence_id"}
