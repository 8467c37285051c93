import math

import pytest
from pyspark.sql import functions as F

from sessile.functions import clean as c
from sessile.functions import metrics, physics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [(None, ""), ("", ""), ("  a \t b\n", "a b"), ("x", "x")])
def test_clean_text(spark, given, want):
    assert one(spark, c.clean_text(F.lit(given).cast("string"))) == want


def test_ids_ignore_case_and_space_and_recipes_differ(spark):
    a = one(spark, c.stable_id("S", [F.lit(" DOI "), F.lit("PTFE")]))
    b = one(spark, c.stable_id("S", [F.lit("doi"), F.lit("ptfe")]))
    assert a == b and a.startswith("S_") and len(a) == 14
    assert a != one(spark, c.piped_id("S", [F.lit("doi"), F.lit("ptfe")]))


def test_null_part_is_not_skipped(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, c.stable_id("S", [nothing, F.lit("a")])) != one(spark, c.stable_id("S", [F.lit("a"), nothing]))


def test_alias(spark):
    assert one(spark, c.canonical_name(F.lit("Glycerin "))) == "glycerol"
    assert one(spark, c.canonical_name(F.lit("water"))) == "water"


@pytest.mark.parametrize(("given", "want"), [("1.5", 1.5), ("x", None), ("NaN", None), ("Infinity", None), ("", None)])
def test_finite(spark, given, want):
    assert one(spark, c.finite(F.lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("72.8 mN/m", 72.8), ("-.5x", -0.5), ("abc", None), (None, None)])
def test_leading_number(spark, given, want):
    assert one(spark, c.leading_number(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("105 ± 2", (105.0, 2.0)), ("105 (2.5)", (105.0, 2.5)), ("105", (105.0, None)), ("n/a", (None, None)), ("100-110", (None, None))])
def test_value_with_deviation(spark, given, want):
    assert tuple(one(spark, c.value_with_deviation(F.lit(given)))) == want


@pytest.mark.parametrize(("given", "want"), [("", "reported_unspecified"), ("Static, unspecified", "reported_unspecified"), ("washburn", "capillary_rise_derived"), ("Equilibrium", "equilibrium"), ("Advancing", "advancing"), ("other", "other")])
def test_angle_type(spark, given, want):
    assert one(spark, c.angle_type(F.lit(given))) == want


def test_family_order_matters(spark):
    assert one(spark, c.family(F.lit("paper on polymer"))) == "polymer"
    assert one(spark, c.family(F.lit(None).cast("string"))) == "other"


def test_bins_are_right_closed_and_null_safe(spark):
    b = lambda x: one(spark, c.right_closed_bin(F.lit(x).cast("double"), (-0.1, 60, 90), ("a", "b")))
    assert [b(0), b(60), b(60.1), b(91), b(None), b(-0.1)] == ["a", "a", "b", None, None, None]


def test_lists(spark):
    assert one(spark, c.list_of(F.lit("A;B;;nan"))) == ["A", "B"]
    assert one(spark, c.list_text(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "a;b"


def test_anchored(spark):
    assert [one(spark, c.anchored(F.lit(a), F.lit(b))) for a, b in ((10.0, -20.0), (170.0, 30.0), (70.0, 5.0))] == [0.0, 180.0, 75.0]
    assert one(spark, c.anchored(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_permission_rule_sets_differ(spark):
    assert tuple(one(spark, c.permissions(F.lit("train")))) == ("yes", "no", "no")
    assert tuple(one(spark, c.permissions(F.lit("train"), True))) == ("yes", "yes", "no")


def test_draw_is_fixed(spark):
    assert one(spark, c.draw(F.lit("a"), F.lit(1))) == 225584429


def test_owens_wendt_angle(spark):
    cosine = 2 * (math.sqrt(25 * 21.8) + math.sqrt(10 * 51.0)) / 72.8 - 1
    x = physics.raw_cosine("owens_wendt", *map(F.lit, (25.0, 10.0, 72.8, 21.8, 51.0)))
    assert one(spark, physics.angle(x)) == pytest.approx(math.degrees(math.acos(cosine)))
    assert one(spark, physics.was_clipped(F.lit(1.5)))


def test_metrics(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 4.0), ("c", 2.0, 2.0), ("c", 2.0, 2.0), ("d", None, 1.0)], "k string, observed double, predicted double")
    got = {r.k: r for r in d.groupBy("k").agg(*metrics.regression()).collect()}
    assert (got["a"].n, got["a"].mae, got["a"].r2) == (2, 0.5, 0.5)
    assert got["b"].r2 is None and got["c"].r2 == 1.0
    assert got["d"].n == 0 and got["d"].mae is None
