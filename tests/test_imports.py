"""Validation of contributed tables on small frames."""

import pytest

from sessile.operators import imports

COLUMNS = ["source_id", "line", "solid_name", "solid_family", "solid_substrate", "liquid_name", "liquid_total_surface_tension_mN_m", "liquid_dispersion_mN_m", "liquid_polar_mN_m", "contact_angle_deg", "contact_angle_type", "measurement_method"]
LIQUIDS = (("water", 72.8, 21.8, 51.0), ("formamide", 58.0, 39.0, 19.0), ("diiodomethane", 50.8, 50.8, 0.0))


def frame(spark, *more, drop=()):
    rows = [("OPEN", k + 2, "PTFE", "polymer", "sheet", *x, 110.0 - 20 * k, "static", "sessile_drop") for k, x in enumerate(LIQUIDS)] + list(more)
    return spark.createDataFrame(rows, COLUMNS).drop(*drop)


def registry(spark, status="verified", doi="10.1/x"):
    return spark.createDataFrame([("OPEN", doi, None, status)], "source_id string, doi string, url string, verification_status string")


def by_rule(report, kind):
    return {r.rule: (r.n, r.detail) for r in report.filter(f"kind = '{kind}'").collect()}


def test_valid_table_is_staged(spark):
    staged, report = imports.validate(frame(spark), registry(spark))
    assert by_rule(report, "status") == {"pass": (1, "")} and by_rule(report, "error") == {}
    assert {k: v[0] for k, v in by_rule(report, "count").items()} == {"n_rows": 3, "n_surfaces": 1, "n_liquids": 3, "n_feasible_surfaces": 1, "duplicate_key_rows": 0}
    rows = staged.collect()
    assert {r.import_status for r in rows} == {"validated_staged"} and {r.source_group_id for r in rows} == {"OPEN"} and len({r.source_row_id for r in rows}) == 3


def test_each_rule_is_told_with_its_first_rows(spark):
    more = [
        ("OPEN", 9, " ", "polymer", "sheet", "water", 72.8, 21.8, 51.0, 181.0, "static", "m"),
        ("OPEN", 10, "X", None, "sheet", "water", None, -1.0, 51.0, float("nan"), "tilting", ""),
        ("OPEN", 11, "PTFE", "polymer", "sheet", "di water", 72.8, 21.8, 51.0, 99.0, "Static", "m"),
        *[("OPEN", 100 + k, "Y", "polymer", "sheet", f"l{k}", 72.8, 21.8, 51.0, 200.0, "static", "m") for k in range(30)],
    ]
    staged, report = imports.validate(frame(spark, *more), registry(spark, "to_verify", " "))
    errors = by_rule(report, "error")
    assert errors["missing_values:solid_name"] == (1, "9") and errors["missing_values:solid_family"] == (1, "10") and errors["missing_values:measurement_method"] == (1, "10")
    assert errors["angle_out_of_range"] == (32, ",".join(map(str, [9, 10, *range(100, 118)])))
    assert errors["non_numeric_or_missing:contact_angle_deg"] == (1, "10") and errors["non_numeric_or_missing:liquid_total_surface_tension_mN_m"] == (1, "10")
    assert errors["negative_liquid_property:liquid_dispersion_mN_m"] == (1, "10") and errors["unsupported_angle_type"] == (1, "tilting")
    assert {"registry_license_or_access_not_verified", "registry_has_no_doi_or_url"} <= set(errors)
    assert by_rule(report, "warning") == {"duplicate_surface_liquid_angle_type_rows": (2, "")}
    assert {r.import_status for r in staged.collect()} == {"rejected"} and by_rule(report, "status") == {"fail": (1, "")}


def test_missing_columns_and_unknown_sources(spark):
    staged, report = imports.validate(frame(spark, drop=("contact_angle_type",)), registry(spark))
    assert staged.count() == 0 and by_rule(report, "error") == {"missing_required_columns": (1, "contact_angle_type")}
    _, report = imports.validate(frame(spark, drop=("liquid_polar_mN_m",)), registry(spark))
    assert "missing_required_numeric_column:liquid_polar_mN_m" in by_rule(report, "error")
    staged, _ = imports.validate(frame(spark, ("OTHER", 1, *["x"] * 4, 1.0, 1.0, 1.0, 1.0, "static", "m")), registry(spark))
    with pytest.raises(Exception, match="absent from the registry"):
        staged.collect()
    staged, report = imports.validate(frame(spark).filter("line < 0"), registry(spark))
    assert staged.count() == 0 and report.count() == 0
