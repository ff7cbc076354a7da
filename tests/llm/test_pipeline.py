"""The corpus pipeline, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm.common import persist

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = persist(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > sizes[0] // 3
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.columns == docs.columns and sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() >= 0
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_quality_stage_counts_every_trusted_document(spark, tmp_path):
    n, odd = 21_000, 40
    last = spark.range(n).orderBy(F.xxhash64("id").desc()).limit(odd).select(F.col("id").alias("odd_id"))
    text = F.when(F.col("odd_id").isNull(), F.lit("a b c d e f g h i j")).otherwise(F.lit("q r s t u v w x y z"))
    docs = spark.range(n).join(F.broadcast(last), F.col("id") == F.col("odd_id"), "left").select(F.col("id").alias("doc_id"), text.alias("text"))
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == n
