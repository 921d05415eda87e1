"""Payloads that no other page has are archived where they are read, without a shuffle."""

from pyspark.sql import functions as F

from tidemark.llm import warc as W


def test_only_repeated_payloads_are_shuffled(spark):
    pages = [(i, f"u{i}", f"page {i}") for i in range(200)] + [(200, "u", "page 3"), (201, None, None), (202, "v", ""), (5, "u5", "page 5"), (None, "w", "page 9")]
    read = spark.createDataFrame(pages, "page_id long, url string, html string")
    hashed = read.select("page_id", W.payload().alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    sole, others = W.parted(hashed, hashed.groupBy("sha256").agg(F.count("*").alias("n")))
    repeated = {3, 200, 201, 202, 5, 9, None}
    assert repeated <= {r.page_id for r in others.collect()} and others.count() < 30
    assert sole.count() + others.count() == len(pages)
    archive = W.write_archive(read)
    assert archive.payloads().count() == archive.payloads().distinct().count() == 201
    got = sorted((r.page_id is None, r.page_id or 0, bytes(r.payload).decode()) for r in archive.originals().collect())
    assert got == sorted((p is None, p or 0, h or "") for p, _, h in pages)
