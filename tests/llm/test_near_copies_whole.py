"""Rows that share an id, or have none, each have their own fate among near copies."""

import corpus_pipeline


def test_only_near_copies_go(spark):
    text = "one two three four five six seven eight nine ten " + " ".join(f"w{i}" for i in range(60))
    other, third = (" ".join(f"{c}{i}" for i in range(50)) for c in "uv")
    rows = [(1, text), (None, text + " more"), (None, other), (None, None), (7, text + " again"), (7, third), (7, third), (9, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _own string")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [rows[i] for i in (0, 2, 3, 5, 6, 7)]))
