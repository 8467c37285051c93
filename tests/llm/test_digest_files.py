"""The digest index writes one file a bucket, however many tasks write it."""

from sessile.llm import exact_dedup


def test_a_batch_has_a_file_for_each_bucket_at_most(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 150}") for i in range(300)], "doc_id long, text string")
    kind = type(docs)
    dealt = kind.repartition
    # As on a cluster that raises the number of tasks: 13 and 3 have no common divisor.
    monkeypatch.setattr(kind, "repartition", lambda self, n, *keys: dealt(self, max(n, 13), *keys))
    index = exact_dedup.DigestIndex(spark, "index_of_files", buckets=3)
    index.drop()
    try:
        out = exact_dedup.dedup(docs, index).collect()
        assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(i, i % 150, 2) for i in range(300)}
        assert index.rows().count() == 150 and len(index.rows().inputFiles()) <= 3
    finally:
        index.drop()
