"""The pipeline's stages on a small table, against what each operator says of its input."""

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm import common, jaccard, packing, pii, toxicity
from tests.oracle import SMALL


def test_stages(spark, tmp_path):
    docs = common.table(spark, SMALL, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == before.columns
    clean, unique, masked, mixed, packed = kept
    raw = common.table(spark, SMALL, "documents")
    model = toxicity.fit_frames(raw, common.table(spark, SMALL, "labels"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in raw.collect() if model.score(r.text) < toxicity.THRESHOLD}
    groups = {r.doc_id: r.component_id for r in jaccard.linked_groups(clean).collect()}
    assert {r.doc_id for r in unique.collect()} == {d for d, c in groups.items() if d == c}
    texts = {r.doc_id: r.text for r in unique.collect()}
    field = pii.default_field()
    assert {r.doc_id: r.text for r in masked.collect()} == {d: pii.redact_text(t, field) for d, t in texts.items()}
    assert masked.exceptAll(mixed).count() == 0 and mixed.count() == masked.count()
    assert packed.agg({"length": "sum"}).first()[0] == packing.pieces(mixed).agg({"length": "sum"}).first()[0]


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_sequences_follow_the_mix(spark, tmp_path):
    rows = [(n, "word " * (5 + n * 7919 % 90 if n % 100 else 5000), "b" if n >= 9000 else "a") for n in range(10000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, stage in corpus_pipeline.STAGES[-2:]:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    # square roots of 9000 and 1000 are as 3 to 1; b lasts for 4000 documents
    seen = {"a": 0, "b": 0}
    first = docs.groupBy("doc_id").agg(F.min("sequence_id").alias("s")).orderBy("s").collect()
    for n, r in enumerate(first[:3500]):
        seen["b" if r.doc_id >= 9000 else "a"] += 1
        assert abs(seen["b"] - (n + 1) / 4) < 128, n
    assert docs.agg({"length": "sum"}).first()[0] == docs.dropDuplicates(["doc_id"]).agg({"doc_tokens": "sum"}).first()[0]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.CAPACITY).isEmpty()
