"""Pairs found block by block, against pairs found key by key and against brute force."""

import math
import random

from pyspark.sql import functions as F

from storyloom.functions import vector as V
from storyloom.operators import blocks as B
from storyloom.operators import evaluate as E
from storyloom.operators import pairs as P
from storyloom.plans import stories

SCHEMA = "id long, article long, family string, ts timestamp, people array<string>, clubs array<string>, relations array<string>, salient array<string>, tokens array<string>, vec array<float>, label int"


def _records(spark, n=120):
    rng = random.Random(7)
    some = lambda kind, of, most: [f"{kind}{rng.randrange(of)}" for _ in range(rng.randrange(most + 1))]
    rows = []
    for i in range(n):
        tokens = some("t", 12, 6)
        vec = [rng.choice([0.0, 1.0, rng.random()]) for _ in range(rng.choice([3, 3, 3, 0, 2]))]
        when = None if i % 17 == 0 else f"2024-01-{1 + i % 28:02d} 00:00:00"
        rows.append((i * 3, None if i % 41 == 0 else i // 2, rng.choice(["transfer", "match", "unknown", None]), when, some("p", 9, 2), some("c", 5, 3), some("c", 5, 1), tokens[:4], tokens, None if i % 13 == 0 else vec, i % 3))
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_blocks_find_what_keys_find(spark, monkeypatch):
    r = _records(spark).cache()
    monkeypatch.setattr(B, "BLOCK", 11)  # many cells, empty ones too
    p = P.shortlisted(r, "id")
    want = p.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.array_join("reasons", ",").alias("r"), V.jaccard(F.col("a.tokens"), F.col("b.tokens")).alias("lex"),
                    V.temporal(F.col("a.ts"), F.col("b.ts")).alias("tmp"), V.cosine(F.coalesce("a.vec", F.array().cast("array<float>")), F.coalesce("b.vec", F.array().cast("array<float>"))).alias("emb"), F.col("a.label").alias("la"))
    got = B.block_pairs(r, "id", ["n_people", "n_relations", "n_clubs", "n_salient", "kin", "lex", "tmp", "emb"], ["a_label"], "vec")
    got = got.select("a", "b", F.concat_ws(",", *[F.when(c, x) for c, x in B.reason_columns().values()]), "lex", "tmp", "emb", "a_label")
    want, got = sorted(map(tuple, want.collect())), sorted(map(tuple, got.collect()))
    assert len(want) > 500 and [x[:3] for x in want] == [x[:3] for x in got]
    assert all(math.isclose(x, y, abs_tol=1e-12) for a, b in zip(want, got) for x, y in zip(a[3:], b[3:]))


def test_vectors_are_not_joined_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(stories, "records", lambda *_: _records(spark).withColumnRenamed("id", "event_id").withColumnRenamed("vec", "embedding"))
    plan = stories.scored_pairs(spark, "", "hybrid")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_one_candidate_stands_for_all(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), f"u{rng.randrange(3)}", sorted({f"c{rng.randrange(12)}" for _ in range(2)})) for i in range(60)]
    got = {r.event_id for r in stories._looked_up(spark.createDataFrame(rows, "event_id long, article long, person string, clubs array<string>")).collect()}
    want = {b[0] for b in rows for a in rows if a[0] < b[0] and a[1] != b[1] and a[2] != b[2] and set(a[3]) & set(b[3])}
    assert got == want and 0 < len(want) < 60


def test_samples_take_what_a_full_sort_takes(spark):
    rng = random.Random(5)
    rows = [(f"{i}:{i + 1}", round(rng.gauss(0.65, 0.1), 3)) for i in range(900)]
    got = {(r.pair_id, r.bucket) for r in E.spectrum_sample(spark.createDataFrame(rows, "pair_id string, hybrid double")).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    spread = {order[math.floor(i * 899 / 99 + 0.5)] for i in range(100)}
    near = sorted((r for r in rows if r not in spread), key=lambda r: (abs(r[1] - 0.65), __import__("hashlib").sha256(r[0].encode()).hexdigest()[:12], r[0]))[:50]
    assert got == {(r[0], "spectrum") for r in spread} | {(r[0], "decision_focus") for r in near}


def test_cells_give_what_is_asked_for(spark, monkeypatch):
    r = _records(spark).cache()
    monkeypatch.setattr(B, "BLOCK", 11)
    every = B.block_pairs(r, "id", ["hybrid", "reasons", "lex", "tmp", "emb", "n_people", "n_relations", "n_clubs", "n_salient", "kin"], vector="vec")
    spelled = F.concat_ws(",", *[F.when(c, x) for c, x in B.reason_columns().values()])
    rows = every.select("a", "b", "hybrid", "reasons", spelled.alias("spelled"), F.round(V.hybrid(F.col("emb"), F.col("lex"), F.col("tmp")), 9).alias("h")).collect()
    assert len(rows) > 500 and all(x.reasons == x.spelled and math.isclose(x.hybrid, x.h, abs_tol=1e-9) for x in rows)
    high = B.block_pairs(r, "id", ["hybrid"], vector="vec", least=0.5).collect()
    assert sorted(map(tuple, high)) == sorted((x.a, x.b, x.hybrid) for x in rows if x.hybrid >= 0.5) and 0 < len(high) < len(rows)
    some = sorted((x.a, x.b, x.hybrid) for x in rows)[::7]
    asked = spark.createDataFrame([x[:2] for x in some] + [(0, 100_000), (3, 0)], "a long, b long")  # not there, and named the wrong way round
    extra = [x for x in sorted((x.a, x.b, x.hybrid) for x in rows) if x[:2] == (0, 3)]
    got = sorted(map(tuple, B.block_pairs(r, "id", ["hybrid"], vector="vec", only=asked).collect()))
    assert got == sorted({*some, *extra})


def test_pairs_are_counted_where_they_are_scored(spark, monkeypatch):
    from storyloom.plans import evaluation

    monkeypatch.setattr(B, "BLOCK", 11)
    monkeypatch.setattr(stories, "records", lambda *_: _records(spark).withColumn("label", F.when(F.col("id") % 5 != 0, F.col("label"))).withColumnRenamed("id", "event_id").withColumnRenamed("vec", "embedding"))
    p = stories.scored_pairs(spark, "", "hybrid", "a_label", "b_label").select((F.col("a_label") == F.col("b_label")).alias("same"), "hybrid")
    want = p.groupBy(F.floor(F.col("hybrid") * 20).cast("int").alias("bucket"), "same").agg(F.count("*").alias("pairs"), F.round(F.min("hybrid"), 6).alias("least"), F.round(F.max("hybrid"), 6).alias("most"))
    got = evaluation.score_histogram(spark, "")
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} and any(x.same is None for x in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "a_label" not in plan  # no pair leaves its cell
    m = E.threshold_metrics(p, evaluation._THRESHOLDS)
    cut = evaluation.threshold_metrics(spark, "")
    assert {tuple(x)[:5] for x in m.collect()} == {tuple(x)[:5] for x in cut.collect()}


def test_bridges_write_and_join_strong_pairs_only(spark, monkeypatch):
    from storyloom.plans import evaluation

    written = []
    monkeypatch.setattr(B, "BLOCK", 11)
    monkeypatch.setattr(stories, "records", lambda *_: _records(spark).withColumn("person", F.lit(1)).withColumnRenamed("id", "event_id").withColumnRenamed("vec", "embedding"))
    monkeypatch.setattr(evaluation, "kept", lambda df: written.append(df.cache()) or written[-1])
    got = {tuple(x) for x in evaluation.bridge_triads(spark, "").collect()}
    assert written[0].where("hybrid < 0.4").count() == 0 < written[0].count()
    p = stories.scored_pairs(spark, "", "hybrid", "a_family", "b_family").select("a", "b", "hybrid", V.family_compatible(F.col("a_family"), F.col("b_family")).alias("compatible"), F.lit(None).cast("string").alias("label"))
    c = E.bridge_candidates(E.bridge_triads(p, 0.3, 0.4))
    assert got == {tuple(x) for x in c.select("center", "triads", "family_block", "below_low", "ambiguous_gap", "not_shortlisted", F.round("max_severity", 4), "risk").collect()} and got


def test_events_are_read_once_and_only_those_with_a_vector(spark, monkeypatch):
    from __spark_entry__ import SMOKE

    seen = []
    monkeypatch.setattr(stories, "matched", lambda e, *others, real=stories.matched: seen.append(e.count()) or real(e, *others))
    p = stories.scored_pairs(spark, SMOKE, "hybrid")
    assert seen == [spark.read.parquet(f"{SMOKE}/embeddings.parquet").join(spark.read.parquet(f"{SMOKE}/events.parquet"), F.expr("vec_id = event_id")).count()]
    assert p.inputFiles() and not [f for f in p.inputFiles() if "events.parquet" in f or "embeddings.parquet" in f]


def test_blocks_are_sent_as_one_value(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 30)
    calls = []
    monkeypatch.setattr(B.F, "explode", lambda c, real=F.explode: calls.append(c) or real(c))
    plan = B.block_pairs(_records(spark), "id", ["hybrid"], vector="vec")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode") :]  # what is multiplied by the number of blocks: packed blocks, not rows
    assert len(calls) == 1 and "MapInArrow _packed" in below


def test_tiles_count_what_sets_have_in_common(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "TALL", 7)
    monkeypatch.setattr(B, "WIDE", 19)
    rng = random.Random(11)
    names = ("people", "clubs", "relations", "salient", "tokens")
    some = lambda of, most: [rng.choice([None, *map(str, range(of))]) for _ in range(rng.randrange(most + 1))]
    rows = [{"id": rng.randrange(60) * 5, "article": rng.choice([None, *range(30)]), "family": rng.choice(["a", "b", "unknown", None]), "us": i, "vector": [1.0], "people": some(40, 2), "clubs": some(9, 4), "relations": some(9, 2), "salient": some(20, 14), "tokens": some(20, 14), "at": i % 2} for i in range(101)]
    for single in (False, True):
        these = [r | {"block": 0 if single else r["at"], "other": 0 if single else 1 - r["at"], "id": r["id"] * 2 + (0 if single else r["at"])} for r in rows]
        want = []
        for i, x in enumerate(these):
            for y in these[:i]:
                a, b = sorted((x, y), key=lambda r: r["id"])
                s = {(n, m): len({*a[n]} & {*b[m]} - {None}) for n in names for m in names}
                people, clubs, salient, shared = (s[n, n] for n in ("people", "clubs", "salient", "tokens"))
                relations = s["relations", "relations"] + s["relations", "clubs"] + s["clubs", "relations"]
                kin = a["family"] == b["family"] and a["family"] not in ("unknown", None)
                apart = None not in (a["article"], b["article"]) and a["article"] != b["article"] and a["id"] != b["id"]
                if apart and (single or a["at"] != b["at"]) and (people or relations or clubs >= 2 or salient >= 4 or kin and (salient >= 3 or salient >= 2 and clubs)):
                    want.append((a["id"], b["id"], people, relations, clubs, salient, kin, shared / max(len({*a["tokens"], *b["tokens"]} - {None}), 1)))
        asked = ["n_people", "n_relations", "n_clubs", "n_salient", "kin", "lex"]
        got = [r for out in B._cell(pa.Table.from_pylist(these), asked, [], False) for r in zip(*(out[n].tolist() for n in ("a", "b", *asked)))]
        assert sorted(got) == sorted(want) and len(want) > 500 and max(w[5] for w in want) > 7
