"""The pipeline: each stage over all that its predecessor kept, and what it does to planted cases."""

import random

import corpus_pipeline
from chartloom.llm.shared import written


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = [r for r in given.collect() if r.lang == "en" and 80 < len((r.text or "").split()) < 400 and "#" not in r.text][:10]
    words = [w for r in good for w in r.text.split()]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(60)
    unique = [text(150) for _ in range(3)]
    near = unique[2].split()
    near[70] = "changedword"
    rows = [(10**6 + i, t, "en", "src1", len(t or "")) for i, t in enumerate([f"{unique[0]}\n{passage}", f"{unique[1]}\n{passage}", unique[2], " ".join(near), None, "", "too few words"])]
    spark.createDataFrame(rows, given.schema).unionByName(given).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == given.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    left = {r.doc_id: r.text for r in docs.collect()}
    assert passage in left[10**6] and left[10**6 + 1] == unique[1]
    assert 10**6 + 2 in left and not {10**6 + 3, 10**6 + 4, 10**6 + 5, 10**6 + 6} & set(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_run_returns_the_packing(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
