"""Runs, their filters, and a second batch against an index."""

import glob
import random

from pyspark.sql import functions as F

from codeloom.llm import exact_dedup
from codeloom.llm.exact_dedup import DigestIndex, sha256_digest


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))


def ranked(docs, digest=sha256_digest):
    return docs.select(digest(F.coalesce("text", F.lit(""))).alias("digest"), (-F.col("doc_id")).alias("rank"))


def weak(text):
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)).cast("string").cast("binary")


def test_a_second_batch_equals_brute_force(spark):
    r = random.Random(1)
    texts = [f"text {r.randrange(80)}" for _ in range(120)] + [None, ""]
    stored = table(spark, list(enumerate(texts)))
    batch = [(1000 + i, f"text {r.randrange(160)}") for i in range(100)] + [(2000, None), (2001, "new"), (2001, "new"), (None, "text 1")]
    want = sorted((i or 0, t or "") for i, t in batch if (t or "") not in {x or "" for x in texts})
    for digest in (sha256_digest, weak):
        index = DigestIndex(spark)
        index.flush(ranked(stored.filter("doc_id < 60"), digest))
        index.flush(ranked(stored.filter("doc_id >= 60"), digest), 3)
        for _ in range(2):
            out = exact_dedup.unseen(table(spark, batch), stored, index, digest=digest)
            assert out.columns == stored.columns
            assert sorted((x["doc_id"] or 0, x["text"] or "") for x in out.collect()) == want
            index.compact()
        assert len(index.runs) == 1


def test_compaction_keeps_the_smallest_rank_and_counts(spark):
    index = DigestIndex(spark)
    for i in range(3):
        index.flush(table(spark, [(j, f"t{j % 4}") for j in range(i, 20)]).select(sha256_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("rank")))
    got = {r["digest"]: (r["rank"], r["n"]) for r in index.compact().table.collect()}
    assert sorted(got.values()) == [(0, 13), (1, 14), (2, 15), (3, 15)]
    d = next(iter(got))
    assert [(bytes(r["digest"]), r["rank"], r["n"]) for r in index.find([bytes(d), b"absent"]).collect()] == [(bytes(d), *got[d])]
    assert index.repeated().table.count() == 4


def test_filters_drop_rows_and_row_groups(spark):
    docs = spark.range(40_000).select(F.col("id").alias("rank"), sha256_digest(F.col("id").cast("string")).alias("digest"))
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        index = DigestIndex(spark)
        index.flush(docs.coalesce(1))
    finally:
        spark.conf.unset("parquet.block.size")
    others = spark.range(50_000, 60_000).select("id", sha256_digest(F.col("id").cast("string")).alias("digest"))
    maybe, no = index.runs[0].candidates(others)
    assert maybe.count() + no.count() == 10_000 and no.count() > 8000
    import hashlib

    import pyarrow.parquet as pq

    files = [f for f in glob.glob(index.runs[0].path.removeprefix("file:") + "/*.parquet")]
    assert any(pq.ParquetFile(f).metadata.num_rows for f in files)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in (7, 50_000)]
    found = index.find(digests)
    assert [r["rank"] for r in found.collect()] == [7]
    assert "EqualTo(digest" in found._jdf.queryExecution().toString()
