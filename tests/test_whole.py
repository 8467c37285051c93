"""Queries against plain Python over all of their rows."""

import collections
import os

import duckdb
import pytest

from sessile import roles
from sessile.plans import modelling

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_batch_score_takes_all_probes(spark):
    duck = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    surfaces = collections.defaultdict(set)
    for surface, number, name, angle in duck.execute(roles.SQL + "SELECT surface_group_id, liquid_id, liquid_name, angle FROM m").fetchall():
        surfaces[surface].add((number, name, angle))
    got = {r.surface_group_id: r for r in modelling.batch_score(spark, SF).collect()}
    assert set(got) == set(surfaces) and max(map(len, surfaces.values())) > 4
    leaks = 0
    for surface, rows in surfaces.items():
        target = min(rows)[1]
        probes = [] if surface % 6 == 0 else [r for r in rows if surface % 2 or r[1] != target]
        reasons = ["unknown_mode"] if surface % 3 == 2 else ["probes_in_zero_shot"] if surface % 3 == 0 and probes else ["too_few_probes"] if surface % 3 == 1 and len(probes) < 2 else []
        if surface % 2:
            reasons.append("target_among_probes")
            leaks += 1
        assert got[surface].reasons == ";".join(reasons)
        if reasons:
            assert got[surface].estimate is None
        else:
            assert got[surface].estimate == pytest.approx(sum(r[2] for r in probes) / len(probes) if probes else 90.0, abs=1e-4)
    assert leaks
