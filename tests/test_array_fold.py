"""The batch form of the clusterer decides as the form that holds a story at a time."""

import math
import random
import time

import pytest

from storyloom.streaming import clusterer


def _events(n, seed, salient=9, clubs=3, dim=4):
    rng = random.Random(seed)
    names = ["transfer", "contract", "match", None, "unknown"]
    tokens = lambda: [f"t{rng.randrange(salient)}", f"c{rng.randrange(clubs)}"][: rng.choice([0, 1, 2, 2, 2])]
    return [(i, rng.randrange(20) * clusterer.DAY_US // 3, rng.choice(names), tokens(), [0.0] * dim if i % 19 == 0 else [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"low": 0.3, "high": 0.45}, {"low": 0.3, "high": 0.45, "anchor": 0.4}, {"low": 0.3, "high": 0.6, "anchor": 0.2, "stress": True}])
def test_same_decisions(options):
    for seed in range(6):
        events = sorted(_events(150, seed), key=lambda e: (e[1], e[0]))
        want, now = clusterer.fold(events, **options), clusterer.ArrayFold(**options)
        got = [now.place(*e) for e in events]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all((g[3] is None) == (w[3] is None) and (g[3] is None or math.isclose(g[3], w[3], abs_tol=1e-9)) for g, w in zip(got, want))


def test_an_event_costs_no_call_per_candidate():
    events = sorted(_events(1500, 1, salient=100, clubs=2, dim=16), key=lambda e: (e[1], e[0]))
    start = time.process_time()
    clusterer.fold(events)
    one_by_one, now, start = time.process_time() - start, clusterer.ArrayFold(), time.process_time()
    for e in events:
        now.place(*e)
    assert now.n > 300 and time.process_time() - start < one_by_one / 2


def test_evaluation_joins_no_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from storyloom.plans import streams

    homes = spark.range(9).select(F.col("id").alias("event_id"), F.col("id").alias("homes"))
    plan = streams._placed(spark, "/root/testdata/sf0.001", homes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and "Join" in plan
