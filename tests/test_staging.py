"""Staged rows alone: equal to those of the whole validation, made once, and without shuffle files left."""

import pytest

import __spark_entry__
from sessile.operators import imports
from sessile.sources.work import materialised
from tests.test_imports import frame, registry

SMALL = "/root/testdata/sf0.001"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (found.apply(k).getName() for k in range(found.size())) if x.startswith("shuffle_") and x.endswith(".data")}


@pytest.mark.parametrize("broadcast", [100, 0])
def test_staged_rows_equal_those_of_the_validation(spark, monkeypatch, broadcast):
    monkeypatch.setattr(imports, "BROADCAST_ROWS", broadcast)
    more = [(k, n, name, "polymer", "sheet", "di water", gamma, 21.8, 51.0, angle, "Static", "m") for n, (k, name, gamma, angle) in enumerate((("A", "X", 72.8, 10.0), ("A", " ", 72.8, 10.0), ("B", "X", None, 10.0), ("C", "X", 72.8, 181.0), ("D", "X", 72.8, 11.0), ("E", "X", 72.8, 12.0), ("F", "X", 72.8, 13.0)), 50)]
    known = registry(spark).unionByName(spark.createDataFrame([(k, "10.1/x" if k != "E" else " ", None, "to_verify" if k == "D" else " Verified") for k in "ABCDEF"], "source_id string, doi string, url string, verification_status string"))
    for drop in ((), ("liquid_polar_mN_m",)):
        rows = frame(spark, *more, drop=drop)
        got, want = imports.stage(rows, known), imports.validate(rows, known)[0]
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert {r.source_id for r in got.collect() if r.import_status == "validated_staged"} == (set() if drop else {"OPEN", "F"})
    assert imports.stage(frame(spark, drop=("contact_angle_type",)), known).count() == 0
    with pytest.raises(Exception, match="absent from the registry"):
        imports.stage(frame(spark, ("OTHER", 1, *["x"] * 4, 1.0, 1.0, 1.0, 1.0, "static", "m")), known).collect()


def test_rows_are_made_once_for_staging(spark):
    plan = __spark_entry__.queries()["import_staged"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "row_number" not in plan


def test_shuffle_files_go_with_the_last_write(spark):
    rows = spark.range(10_000).repartition(3).groupBy("id").count()
    before = shuffle_files(spark)
    kept = materialised(rows.filter("id % 2 = 0"), "kept")
    assert shuffle_files(spark) - before
    before = shuffle_files(spark)
    gone = materialised(rows, "gone", last=True)
    assert not shuffle_files(spark) - before
    assert gone.count() == 2 * kept.count() == 10_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
