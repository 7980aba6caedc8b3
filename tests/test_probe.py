"""Probing posting lists without reading the longest one."""

import random

from storyloom.operators import pairs as P


def test_probe_against_counting_all(spark):
    rng = random.Random(11)
    posts = sorted({("k", str(int(rng.random() ** 2 * 9)), f"s{rng.randrange(60):02d}") for _ in range(300)})
    asks = sorted({(i, "k", str(rng.randrange(11))) for i in range(40) for _ in range(rng.randrange(1, 5))})
    got = P.probe(spark.createDataFrame(asks, "e long, key_type string, key_value string"), spark.createDataFrame(posts, "key_type string, key_value string, story_id string"), "e", 5)
    want = set()
    for e in {a[0] for a in asks}:
        count = {}
        for k in (a[2] for a in asks if a[0] == e):
            for p in posts:
                if p[1] == k:
                    count[p[2]] = count.get(p[2], 0) + 1
        best = sorted(count.items(), key=lambda c: (-c[1], c[0]))[:5]
        want |= {(e, s, n, i + 1) for i, (s, n) in enumerate(best)}
    assert set(map(tuple, got.collect())) == want


def test_probe_does_not_widen_a_crowded_list(spark):
    """4000 stories under one key and 3000 queries for it: 12 million matches, of which no task makes more than a list."""
    posts = spark.range(4000).selectExpr("'k' as key_type", "'all' as key_value", "cast(id as string) as story_id").localCheckpoint()
    asks = spark.range(3000).selectExpr("id as e", "'k' as key_type", "'all' as key_value").localCheckpoint()
    found = P.probe(asks, posts, "e")
    assert found.count() == 3000 * 16
    counts = []

    def walk(node):
        m = node.metrics().get("numOutputRows")
        counts.append(m.get().value() if m.isDefined() else 0)
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        if inner is not None:
            walk(inner)
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    out = found.groupBy().count()
    out.collect()
    walk(out._jdf.queryExecution().executedPlan())
    assert max(counts) <= 3000 * 16
