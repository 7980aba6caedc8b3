"""Pairs of token vectors, block by block, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import sparse as S
from storyloom.plans import stories


def _vectors(n=90):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        names = {f"t{min(int(rng.expovariate(0.12)), 60)}" for _ in range(rng.randrange(9))}
        w = {t: rng.random() + 0.1 for t in names}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        rows += [(i * 2, ["x", "x", "y", None][i % 4], t, x / norm) for t, x in w.items()]
    return rows


def _brute(rows, least):
    docs = {}
    for i, k, t, w in rows:
        docs.setdefault((k, i), {})[t] = w
    out = {}
    for (ka, a), va in docs.items():
        for (kb, b), vb in docs.items():
            if ka is not None and ka == kb and a < b and (s := sum(w * vb[t] for t, w in va.items() if t in vb)) >= least:
                out[a, b] = s
    return out


def test_token_pairs_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)  # many cells, of blocks that may be empty
    rows = _vectors()
    tokens = spark.createDataFrame(rows, "id long, key string, token string, w double")
    sizes = tokens.groupBy("key").agg(F.count_distinct("id").alias("n"))
    got = {(r.a, r.b): r.score for r in S.token_pairs(tokens, "id", "w", 0.3, "key", sizes).collect()}
    want = _brute(rows, 0.3)
    assert got.keys() == want.keys() and len(want) > 50
    assert all(math.isclose(got[p], want[p], abs_tol=1e-12) for p in want)


@pytest.mark.parametrize("dense", [0.0, 0.1, 1.0])
def test_strips_hold_all_scores(monkeypatch, dense):
    monkeypatch.setattr(S, "STRIP", 5)
    monkeypatch.setattr(S, "DENSE", dense)
    rng = np.random.default_rng(1)
    a, b = (rng.random((n, 30)) * (rng.random((n, 30)) < 0.2) for n in (13, 9))
    side = lambda m: S._Side(*np.nonzero(m), m[np.nonzero(m)], len(m))
    got = np.vstack([s for _, s in S._strips(side(a), side(b), 30)])
    assert np.allclose(got, a @ b.T, atol=1e-12)


def test_article_pairs_join_no_tokens(spark, monkeypatch, tmp_path):
    rows = [(i, "a b. " * i, "xx", "s") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = stories.tfidf_pairs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan


def _article(rng, i):
    tokens = sorted({f"w{min(int(rng.expovariate(0.2)), 25)}" for _ in range(rng.randrange(7))})
    weight = lambda t: 1 + int(t[1:]) / 10
    return (i, rng.choice([-40, -5, 0, 3]) + i // 3, tokens, [weight(t) for t in tokens], [rng.random() < 0.5 for _ in tokens], [int(t[1:]) % 2 == 0 for t in tokens])


def _overlaps(rows, width):
    out = {}
    for x in rows:
        for y in rows:
            both = {t for t in x[2] if t in y[2]}
            if x[0] >= y[0] or abs(x[1] - y[1]) > width or not both:
                continue
            w, named = ({t: w for r in (x, y) for t, w in zip(r[2], r[3])}), [{t for t, f in zip(r[2], r[4]) if f} for r in (x, y)]
            share = lambda i, u: sum(map(w.get, i)) / sum(map(w.get, u)) if u else 0.0
            title = named[0] & named[1]
            out[x[0], y[0]] = (abs(x[1] - y[1]), share(title, named[0] | named[1]), share(both, {*x[2], *y[2]}), len(title), len(both), sum(int(t[1:]) % 2 == 0 for t in both))
    return out


@pytest.mark.parametrize("strip, others", [(128, 1024), (3, 2)])
def test_band_overlaps_are_those_of_brute_force(spark, monkeypatch, strip, others):
    monkeypatch.setattr(S, "SPAN", 2)
    rng = random.Random(5)
    rows = [_article(rng, i) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, us long, tokens array<string>, weights array<double>, titled array<boolean>, salient array<boolean>")
    want = _overlaps(rows, 4)
    if strip == 128:  # workers have their own constants
        monkeypatch.setattr(S, "SPAN", 16)
        got = [tuple(r) for r in S.band_overlaps(df, 4).collect()]
    else:
        monkeypatch.setattr(S, "BAND_STRIP", strip)
        monkeypatch.setattr(S, "BAND_OTHERS", others)
        table = df.toArrow().append_column("cell", [[-1] * len(rows)]) if hasattr(df, "toArrow") else None
        import pyarrow as pa

        parts = {}
        for at, r in enumerate(rows):
            for cell in {r[1] // 8, (r[1] - 4) // 8}:
                parts.setdefault(cell, []).append(at)
        got = []
        for cell, at in parts.items():
            t = table.drop_columns(["cell"]).take(pa.array(at)).append_column("cell", pa.array([cell] * len(at)))
            for out in S._band_cell(t, 4):
                got += list(zip(*[out[n].tolist() for n in ("a", "b", "gap", "t", "c", "shared_title", "shared_context", "shared_salient")]))
    assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got} == want.keys() and len(want) > 200
    for a, b, *rest in got:
        assert np.allclose(rest, want[a, b], atol=1e-12)
