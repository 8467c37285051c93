"""Grids of tables with spans and nesting, and the extractor's cases on generated markup."""

import pytest

from sessile.operators import grids
from sessile.operators.grids import Measured, TableSpec


def cells(markup):
    return [g.rows for g in grids.grids(markup)]


def test_spans_fill_the_grid():
    markup = "<table><tr><th rowspan='2'>A</th><th colspan=2>B</th></tr><tr><th>c</th><th>d</th></tr><tr><td rowspan=0>x</td><td>1</td><td rowspan='2'>2</td></tr><tr><td>3</td></tr></table>"
    assert cells(markup) == [[["A", "B", "B"], ["A", "c", "d"], ["x", "1", "2"], ["x", "3", "2"]]]
    assert cells("<table><tr><td>a<td>b</td><td rowspan=3>z</td></tr><tr><td>c</td></tr><tr></tr></table>") == [[["a", "b", "z"], ["c", "", "z"]]]
    assert cells("<table><thead><tr><td rowspan=9>h</td></tr></thead><tbody><tr><td>b</td></tr></tbody></table>") == [[["h"], ["b"]]]


def test_nested_tables_captions_and_broken_markup():
    markup = "<table-wrap id='T1'><caption><title>Contact <b>angles</b></title><p>average &amp; SD</p></caption><table><tr><td>out <table id='in'><caption>inner</caption><tr><td>99</td></tr></table> side</td><td/><td><![CDATA[<5>]]></td></tr></table></table-wrap><table><tr><td>open"
    found = grids.grids(markup)
    assert [(g.id, g.caption, g.depth, g.rows) for g in found] == [("T1", "Contact angles average & SD", 0, [["out side", "", "<5>"]]), ("in", "inner", 1, [["99"]]), ("", "", 0, [["open"]])]
    assert grids.grids(None) == [] and grids.grids("</table></td><caption>") == []


def row(*values):
    return "<tr>" + "".join(f"<td>{v}</td>" for v in values) + "</tr>"


def wrap(ident, caption, *rows):
    return f"<article><table-wrap id='{ident}'><caption><p>{caption}</p></caption><table>{''.join(rows)}</table></table-wrap></article>"


def read(spark, xml, spec):
    docs = spark.createDataFrame([(1, xml), (2, None), (3, "<p>none</p>")], "doc_id long, xml string")
    return grids.measurements_of(grids.table_grids(docs), spec)


def test_three_plain_columns_of_eighteen_surfaces(spark):
    """A caption chooses the table; rows whose cells are no numbers are left."""
    body = [row(f"P{k}", 60 + k, f"{50 + k}.5", 40) for k in range(18)] + [row("note", "n.d.", 1, 2), row("short", 1)]
    spec = TableSpec((Measured("water", 1), Measured("formamide", 2), Measured("diiodomethane", 3)), caption=("contact angle results", "polymer"), least=4)
    found = read(spark, wrap("t3", "Contact angle results of various polymer surfaces", row("s", "w", "f", "d"), *body), spec)
    (told,) = grids.report(found).collect()
    assert (told.n_rows, told.n_labels, told.n_liquids, told.skipped) == (56, 19, 3, {"cells": 3, "unparsed": 1})


def test_ranges_and_unknown_liquids_are_counted(spark):
    body = [row("a", "water", "80 ± 2", "x"), row("b", "water", "70-80", "x"), row("c", "milk", "50", "x"), row("d", "glycerol", "61.5", "x")]
    spec = TableSpec((Measured("as told", 2),), table_id="Tab1", least=4, pattern="with_deviation", rules=(("unsupported_liquid", 1, "^(?!water$|glycerol$)"), ("range", 2, r"^\d+\s*[-–]\s*\d+$")))
    found = read(spark, wrap("Tab1", "any", row("s", "l", "a", "n"), *body), spec).orderBy("row").collect()
    assert [(r.value, r.deviation, r.reason) for r in found] == [(80.0, 2.0, None), (None, None, "range"), (None, None, "unsupported_liquid"), (61.5, None, None)]


def test_exact_cells_offsets_and_constants(spark):
    """Columns beside the wanted ones are left out; counts and constants go with each row."""
    head = "<tr><th rowspan=2>specimen</th><th colspan=3>water</th><th colspan=3>formamide</th></tr>" + "<tr>" + "<th>CA</th><th>SD</th><th>n</th>" * 2 + "</tr>"
    spec = TableSpec((Measured("water", 1, 2, 3), Measured("formamide", 4, 5, 6)), table_id="t6", skip=2, exact=7, label_pattern="[A-Za-z]", strict=True, constants=(("type", "static"),))
    found = read(spark, wrap("t6", "c", head, row("PET", 81, "± 3", 5, 60.5, 2, 4), row("12", 1, 1, 1, 1, 1, 1), row("short", 1)), spec)
    got = [(r.label, r.liquid, r.value, r.deviation, r.n_replicates, r.constants["type"]) for r in found.filter("reason IS NULL").orderBy("value").collect()]
    assert got == [("PET", "formamide", 60.5, 2.0, 4.0, "static"), ("PET", "water", 81.0, 3.0, 5.0, "static")]
    assert {r.reason for r in found.collect()} == {None, "cells", "label"}
    broken = read(spark, wrap("t6", "c", head, row("PET", "?", 3, 5, 60, 2, 4)), spec)
    with pytest.raises(Exception, match="no value in row PET"):
        broken.collect()


def test_labels_that_span_rows_and_the_first_table_that_fits(spark):
    body = "<tr><td rowspan=2>glass</td><td>water</td><td>31.0 ± 1.5</td></tr>" + row("glycerol", "44")
    xml = wrap("x", "Angles", row("a", "b", "c"), body) + wrap("y", "Angles again", row("a", "b", "c"), row("q", "water", "9"))
    found = read(spark, xml, TableSpec((Measured("", 2),), caption=("angles",), pattern="with_deviation", least=3)).orderBy("row").collect()
    assert [(r.table_id, r.label, r.value) for r in found] == [("x", "glass", 31.0), ("x", "glass", 44.0)]


def test_each_document_is_parsed_once(spark, monkeypatch):
    xml = "<table-wrap><caption>Angles</caption><table><tr><td>h</td><td>w</td></tr><tr><td>a</td><td>1</td></tr></table></table-wrap>" * 2
    docs = spark.createDataFrame([(k, xml) for k in range(3)] + [(9, None)], "doc_id long, xml string")
    spec = grids.TableSpec((grids.Measured("water", 1),), caption=("angles",))
    found = grids.measurements_in(docs, spec)
    assert sorted(map(str, found.collect())) == sorted(map(str, grids.measurements_of(grids.table_grids(docs), spec).collect()))
    for d in (found, grids.report(found)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1, plan
    assert {(r.doc_id, r.n_rows, r.n_labels, r.n_liquids, r.skipped) for r in grids.report(found).collect()} == {(k, 1, 1, 1, None) for k in range(3)}


def test_tags_as_written():
    tags = ["<td>", "</TD >", "<br/>", "<a//>", "<x:td a='>' b=\"/>\" c=d/>", "<!-- <td> -->", "<![CDATA[ <td> ]]>"]
    assert [grids._tag(t)[1:] for t in tags[:5]] == [("", "td", "", ""), ("/", "td", " ", ""), ("", "br", "", "/"), ("", "a", "/", "/"), ("", "td", " a='>' b=\"/>\" c=d", "/")]
    assert grids._tag(tags[5])[2] == "" and grids._tag(tags[6])[0] == " <td> "
    assert grids._SPLIT.split("x<" + "".join(tags) + "< 3")[1::2] == tags
