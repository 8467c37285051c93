"""Committed versions, re-curation, merges and loads by header on small tables."""

import pytest
from pyspark.sql import functions as F

from sessile import sources as src
from sessile.operators import recuration
from sessile.sources.versions import OverwriteError, VersionedTables


def test_a_write_that_breaks_off_leaves_the_last_version(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "star"))
    assert store.last() == 0 and store.tables() == {} and store.log().count() == 0
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert store.commit({"a": a, "b": a.limit(1)}, "first") == 1
    broken = a.withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("broken off"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken off"):
        store.commit({"a": a.union(a), "b": broken}, "second")  # one table is written, the other breaks
    assert store.last() == 1 and store.read("a").count() == 2
    (tmp_path / "star" / "manifest" / "00000002").mkdir()  # a manifest without its mark
    assert store.last() == 1
    assert store.commit({"b": a}, "second") == 2
    assert store.read("b").count() == 2 and store.read("b", 1).count() == 1 and store.read("a").count() == 2
    assert {(r["table"], r.version) for r in store.log().collect()} == {("a", 1), ("b", 1), ("a", 2), ("b", 2)}
    assert all(r.intact for r in store.verify().collect())
    folder = store.tables()["b"]["folder"]
    a.withColumn("v", F.lit("changed")).write.mode("overwrite").parquet(folder)
    assert {r["table"]: r.intact for r in store.verify().collect()} == {"a": True, "b": False}
    with pytest.raises(KeyError):
        store.read("none")


def test_a_rebuild_over_external_rows_is_refused(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "star"))
    rows = spark.createDataFrame([(1, "train"), (2, "outside")], "id int, split string")
    store.rebuild({"splits": rows.filter("split = 'train'")}, "migrate", "split = 'outside'")
    store.rebuild({"splits": rows.filter("split = 'train'")}, "rebuild", "split = 'outside'")
    store.commit({"splits": rows}, "merge", "split = 'outside'")
    with pytest.raises(OverwriteError, match="splits"):
        store.rebuild({"splits": rows.filter("split = 'train'")}, "rebuild", "split = 'outside'")
    assert store.last() == 3 and store.read("splits").count() == 2


FACTS = "measurement_id int, source_id string, key string, value double, censored boolean"


def test_recuration_gives_rows_excluded_rows_and_sources(spark):
    facts = spark.createDataFrame([(1, "a", "k", 10.0, False), (2, "a", "k", 20.0, False), (3, "b", "k", 30.0, False), (4, "c", "k", 40.0, False), (5, "d", "k", None, None)], FACTS)
    sources = spark.createDataFrame([(s, s.upper()) for s in "abcde"], "source_id string, name string")
    new = spark.createDataFrame([(31, "b", "k", 31.0, False), (32, "b", "k", None, True), (33, "b", "k", None, False), (34, "a", "k", 1.0, False)], FACTS)
    fix = spark.createDataFrame([(4, 41.5), (1, 99.0)], "measurement_id int, value double")
    choose = lambda *d: spark.createDataFrame(list(zip("abcde", d)), "source_id string, decision string")  # noqa: E731, B905
    out = recuration.recurate(facts, sources, choose("exclude", "replace", "correct", "retain", "retain"), new, fix)
    assert {(r.measurement_id, r.value, r.origin, r.state) for r in out["measurements"].collect()} == {(31, 31.0, "replacement", "active"), (32, None, "replacement", "censored"), (4, 41.5, "corrected", "active")}
    assert {(r.measurement_id, r.reason) for r in out["excluded"].collect()} == {(1, "excluded_by_decision"), (2, "excluded_by_decision"), (3, "superseded"), (33, "no_value"), (5, "no_value")}
    assert {(r.source_id, r.status, r.rows) for r in out["sources"].collect()} == {("b", "active", 2), ("c", "active", 1), ("d", "empty", 0), ("e", "empty", 0)}
    assert {(r.source_id, r.retained, r.excluded) for r in out["manifest"].collect()} == {("a", 0, 2), ("b", 2, 2), ("c", 1, 0), ("d", 0, 1), ("e", 0, 0)}
    for bad, name in ((choose("exclude", "pending", "retain", "retain", "retain"), "unknown_decision"), (choose("retain"), "undecided"), (choose(*["retain"] * 5).union(choose("retain")), "repeated"), (choose(*["retain"] * 5).union(spark.createDataFrame([("z", "retain")])), "no_such_source")):
        with pytest.raises(recuration.DecisionError, match=name):
            recuration.recurate(facts, sources, bad, new, fix)


def write(path, text, bom=False):
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")


def test_files_are_grouped_by_header(spark, tmp_path):
    write(tmp_path / "a.csv", "id,name,x\n1,one,0.5\n\n2, two ,\n", bom=True)
    write(tmp_path / "b.csv", "id,name,x\n3,\"thr,ee\",1\n")
    write(tmp_path / "c.csv", "label,ID No\nfour,4\n")
    write(tmp_path / "d.csv", "id,label,name\n5,other,five\n")  # it has the column and its other name
    rows = src.read_glob(spark, str(tmp_path / "*.csv"), {"label": "name", "ID No": "id"}, ["id", "name"]).collect()
    assert {(r["id"], r["name"], r.x, r["_file"], r["_row"]) for r in rows} == {("1", "one", "0.5", "a.csv", 1), ("2", "two", None, "a.csv", 2), ("3", "thr,ee", "1", "b.csv", 1), ("4", "four", None, "c.csv", 1), ("5", "five", None, "d.csv", 1)}
    write(tmp_path / "e.csv", "number,name\n1,x\n")
    with pytest.raises(ValueError, match=r"e\.csv.*id"):
        src.read_glob(spark, str(tmp_path / "*.csv"), {"label": "name", "ID No": "id"}, ["id", "name"])
