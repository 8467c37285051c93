"""Learning curves of drawn subsets: bits and sums of groups of sources against members as rows."""

import hashlib
import time

import numpy as np
import pytest

from sessile.functions import draws
from sessile.operators import curves
from sessile.sources.work import materialised


@pytest.mark.parametrize("sources", [1, 2, 3, 300])
def test_drawn_curve_equals_the_curve_of_drawn_subsets(spark, sources):
    rng = np.random.default_rng(sources)
    of = np.concatenate([np.arange(sources), rng.integers(0, sources, 200)])
    y, p = rng.uniform(0, 180, len(of)), rng.uniform(0, 180, len(of))
    data = [(f"s{k}", float(a), float(b)) for k, a, b in zip(of, y, p, strict=True)] + [(None, 1.0, 2.0), ("s0", None, 3.0)]
    frame = spark.createDataFrame(data, "s string, y double, p double")
    draws = 20 if sources < 10 else 1
    got = sorted(tuple(r) for r in curves.drawn_curve(frame, "s", "y", "p", draws).collect())
    if sources == 1:
        assert got == []
        return
    subsets = curves.drawn_subsets(frame.filter("s IS NOT NULL").select("s").distinct(), "s", range(1, sources), draws)
    want = sorted(tuple(r) for r in curves.learning_curve(frame, "s", "y", "p", subsets).collect())
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=2e-6)
    assert len(got) <= (sources - 1) * draws


def test_draws_equal_digests_of_single_texts():
    keys = [b"%d" % k for k in range(0, 30_000, 7)]
    for names in (keys, keys[:20], [b"a" * k for k in range(70)], [b"a" * k for k in range(47)] * 2, [f"é{k}".encode() for k in range(100)], [b""] * 70, []):
        prefixes = [b"%d|%d|" % (size, k) for size in (1, 12, 12_345) for k in (1, 20)] + [b"", b"12345678"]
        want = [[int(hashlib.md5(p + k).hexdigest()[:8], 16) for k in names] for p in prefixes]
        assert draws.Draws(names).numbers(prefixes).tolist() == want


def test_draws_of_many_keys_are_made_together():
    keys = [b"%d" % k for k in range(30_000)]
    drawn, start = draws.Draws(keys), time.process_time()
    drawn.numbers([b"1234|%d|" % k for k in range(10, 20)])
    middle = time.process_time()
    for k in range(10, 20):
        b"".join([hashlib.md5(b"1234|%d|" % k + x).digest()[:4] for x in keys])
    assert middle - start < (time.process_time() - middle) / 2


def test_sources_do_not_travel_with_each_group_of_draws(spark, monkeypatch):
    made = []
    monkeypatch.setattr(curves, "materialised", lambda frame, name: made.append((name, frame)) or materialised(frame, name))
    frame = spark.range(60).selectExpr("concat('s', id % 30) s", "cast(id * 3 as double) y", "cast(id * 2 as double) p")
    assert curves.drawn_curve(frame, "s", "y", "p", 4).count() > 100
    plan = dict(made)["curve-drawn"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "curve-sources" not in plan
