"""Evaluation of scored pairs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import vector as V
from storyloom.operators import evaluate as E
from storyloom.operators import pairs as P
from storyloom.operators import review
from storyloom.plans.registry import query
from storyloom.plans.stories import _FAMILY_OK, PAIRS_SQL, scored_pairs
from storyloom.plans.texts import _MAIN, _TITLE
from storyloom.sources.sinks import kept
from storyloom.sources.tables import EVENTS_SQL, events, load, spread

_THRESHOLDS = [i / 200 for i in range(60, 157, 8)]
_COMPAT = _FAMILY_OK
_RAW_OK = re.sub(r"\bf([ab])\b", lambda m: {"a": "x", "b": "y"}[m[1]] + ".family", _COMPAT)
_ID = "sp2 AS (SELECT a || ':' || b AS pair_id, la = lb AS same, hybrid FROM sp)"


def _counted(spark: SparkSession, sf_dir: str, level) -> DataFrame:
    """(level, same, n, least, most): how many scored pairs of the same and of different labels have a level of their score,
    the least score and the greatest. Pairs are counted where they are scored: a few rows leave a batch of them."""

    def fold(out: dict) -> dict:
        same = pc.fill_null(pc.equal(out["a_label"], out["b_label"]).cast(pa.int8()), -1).to_numpy(zero_copy_only=False)
        kinds = level(out["hybrid"]).astype(np.int64) * 4 + same
        at = kinds - kinds.min()  # levels are few
        counts = np.bincount(at)
        least, most = np.full(len(counts), np.inf), np.full(len(counts), -np.inf)
        np.minimum.at(least, at, out["hybrid"])
        np.maximum.at(most, at, out["hybrid"])
        found = np.flatnonzero(counts)
        kinds = found + kinds.min()
        levels = (kinds + 1) // 4
        truth = pa.array(kinds - levels * 4 == 1, mask=kinds - levels * 4 < 0)
        return {"level": levels.astype(np.int32), "same": truth, "n": counts[found], "least": least[found], "most": most[found]}

    p = scored_pairs(spark, sf_dir, "hybrid", "a_label", "b_label", fold=(fold, "level int, same boolean, n long, least double, most double"))
    return p.groupBy("level", "same").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _truths(counted: DataFrame) -> DataFrame:
    """(level, s, d): pairs of the same and of different labels."""
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return counted.groupBy("level").agg(total(F.col("same")).alias("s"), total(~F.col("same")).alias("d"))


def _by_threshold(spark, sf_dir):
    ts = np.sort(_THRESHOLDS)
    return _truths(_counted(spark, sf_dir, lambda h: np.searchsorted(ts, h, "right")))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs by name, written once: a sample reads them several times."""
    p = kept(scored_pairs(spark, sf_dir, "hybrid").select("a", "b", "hybrid"))
    return p.select(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair_id"), "hybrid")


@query(f"WITH {PAIRS_SQL} SELECT round(quantile_cont(hybrid, 0.5), 6) AS p50, round(quantile_cont(hybrid, 0.9), 6) AS p90, round(quantile_cont(hybrid, 0.95), 6) AS p95, round(quantile_cont(hybrid, 0.99), 6) AS p99, round(median(emb), 6) AS median_cosine FROM sp")
def quantiles_of_scores(spark, sf_dir):
    p = scored_pairs(spark, sf_dir, "hybrid", "emb").select("hybrid", "emb")
    q = E.quantiles(p, "hybrid", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("n")
    m = E.quantiles(p, "emb", {"median_cosine": 0.5}).drop("n")  # one row each
    return q.join(m).select(*[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "median_cosine")])


@query(f"WITH {PAIRS_SQL}, t AS (SELECT unnest([{', '.join(map(str, _THRESHOLDS))}])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (hybrid >= threshold) AS kept FROM sp, t GROUP BY 1")
def kept_by_threshold(spark, sf_dir):
    m = E.threshold_rates(_by_threshold(spark, sf_dir), _THRESHOLDS)
    return m.select("threshold", (F.col("tp") + F.col("fp")).alias("kept"))


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT unnest([{', '.join(map(str, _THRESHOLDS))}])::DOUBLE AS threshold),
 c AS (SELECT threshold, count(*) FILTER (la = lb AND hybrid >= threshold) AS tp, count(*) FILTER (la <> lb AND hybrid >= threshold) AS fp, count(*) FILTER (la <> lb AND hybrid < threshold) AS tn, count(*) FILTER (la = lb AND hybrid < threshold) AS fn FROM sp, t GROUP BY 1),
 r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r FROM c)
 SELECT threshold, tp, fp, tn, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM r""")
def threshold_metrics(spark, sf_dir):
    m = E.threshold_rates(_by_threshold(spark, sf_dir), _THRESHOLDS)
    return m.select("threshold", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"""WITH {PAIRS_SQL}, z AS (SELECT lo::INT AS low, hi::INT AS high FROM range(120, 139) a(lo), range(128, 157) b(hi) WHERE hi >= lo + 3),
 l AS (SELECT la = lb AS same, floor(hybrid * 200 + 1e-9::DOUBLE) AS lv FROM sp),
 c AS (SELECT low, high, count(*) FILTER (lv >= high) AS merged, count(*) FILTER (lv >= high AND same) AS mr, count(*) FILTER (lv < low) AS fresh, count(*) FILTER (lv < low AND NOT same) AS fr, count(*) AS n FROM l, z GROUP BY 1, 2),
 r AS (SELECT *, CASE WHEN merged > 0 THEN mr / merged ELSE 1 END AS mp, CASE WHEN fresh > 0 THEN fr / fresh ELSE 1 END AS np FROM c)
 SELECT low, high, merged, fresh, round(mp, 6) AS merge_precision, round(np, 6) AS new_precision, round((merged + fresh) / n, 6) AS coverage, mp >= 0.97 AND np >= 0.97 AS safe, merged >= 5 AND fresh >= 5 AS support_ok FROM r""")
def zone_sweep(spark, sf_dir):
    counts = _counted(spark, sf_dir, lambda h: np.clip(np.nan_to_num(np.floor(h * 200 + 1e-9)), 119, 156))
    z = E.zone_rates(_truths(counts), (120, 138), (128, 156))
    return z.select("low", "high", "merged", "fresh", *[F.round(c, 6).alias(c) for c in ("merge_precision", "new_precision", "coverage")], "safe", "support_ok")


_BIN = "CASE " + " ".join(f"WHEN hybrid < {b}::DOUBLE THEN {i}" for i, b in enumerate(E.BINS)) + f" ELSE {len(E.BINS)} END"


@query(f"""WITH {PAIRS_SQL}, {_ID}, p AS (SELECT *, {_BIN} AS bin, substr(sha256(pair_id), 1, 12) AS rk FROM sp2), n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY rk, pair_id) AS n FROM p),
 f AS (SELECT * FROM n WHERE n <= 17), r AS (SELECT * FROM n WHERE n > 17 ORDER BY abs(hybrid - 0.65::DOUBLE), rk, pair_id LIMIT (SELECT 120 - count(*) FROM f)), u AS (SELECT * FROM f UNION ALL SELECT * FROM r)
 SELECT 'M' || lpad((row_number() OVER (ORDER BY hybrid DESC, pair_id))::VARCHAR, 3, '0') AS review_id, pair_id, round(hybrid, 6) AS hybrid, bin FROM u""")
def calibration_sample_v1(spark, sf_dir):
    return E.stratified_sample(_named(spark, sf_dir)).select("review_id", "pair_id", F.round("hybrid", 6).alias("hybrid"), "bin")


@query(f"""WITH {PAIRS_SQL}, {_ID}, p AS (SELECT *, row_number() OVER (ORDER BY hybrid, pair_id) - 1 AS place, count(*) OVER () AS n, substr(sha256(pair_id), 1, 12) AS rk FROM sp2),
 w AS (SELECT DISTINCT floor(i * ((SELECT count(*) FROM sp2) - 1) / 99 + 0.5)::BIGINT AS place FROM range(100) t(i)),
 s AS (SELECT *, 'spectrum' AS bucket FROM p WHERE place IN (SELECT place FROM w)), f AS (SELECT *, 'decision_focus' AS bucket FROM p WHERE place NOT IN (SELECT place FROM w) ORDER BY abs(hybrid - 0.65::DOUBLE), rk, pair_id LIMIT 50),
 u AS (SELECT * FROM s UNION ALL SELECT * FROM f)
 SELECT 'M' || lpad((row_number() OVER (ORDER BY hybrid DESC, pair_id))::VARCHAR, 3, '0') AS review_id, pair_id, round(hybrid, 6) AS hybrid, bucket, least(9, floor(place * 10 / n))::INT AS decile FROM u""")
def calibration_sample_v2(spark, sf_dir):
    return E.spectrum_sample(_named(spark, sf_dir)).select("review_id", "pair_id", F.round("hybrid", 6).alias("hybrid"), "bucket", "decile")


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT a.family AS fa, b.family AS fb, a.club = b.club AS club, a.salient = b.salient AS anchor FROM ev a JOIN ev b ON a.person = b.person AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 172800000000)
 SELECT concat_ws('|', least(fa, fb), greatest(fa, fb)) AS family_pair, {_COMPAT} AS family_ok, count(*) AS pairs, count(*) FILTER (club) AS same_club, count(*) FILTER (anchor) AS match_equal,
 count(*) FILTER (({_COMPAT}) AND anchor) AS football_ok, count(*) FILTER (({_COMPAT}) AND anchor AND club) AS anchored FROM p GROUP BY 1, 2""")
def gate_features(spark, sf_dir):
    """How many pairs each gate lets through, by pair of families."""
    e = events(spark, sf_dir).select("event_id", "person", "family", "club", "salient", F.unix_micros("ts").alias("us"))
    p = P.band_pairs(e, "event_id", "us", 48 * P.HOUR, ["person"])
    ok = V.family_compatible(F.col("a_family"), F.col("b_family"))
    same, anchor = F.col("a_club") == F.col("b_club"), F.col("a_salient") == F.col("b_salient")
    pair = F.concat_ws("|", F.least("a_family", "b_family"), F.greatest("a_family", "b_family"))
    return p.groupBy(pair.alias("family_pair"), ok.alias("family_ok")).agg(
        F.count("*").alias("pairs"), F.count_if(same).alias("same_club"), F.count_if(anchor).alias("match_equal"), F.count_if(ok & anchor).alias("football_ok"), F.count_if(ok & anchor & same).alias("anchored")
    )


_TRIADS = f"""{PAIRS_SQL}, c AS (SELECT a, b, hybrid, {_COMPAT} AS ok FROM sp), e AS (SELECT a AS c, b AS x, hybrid FROM c WHERE hybrid >= 0.4::DOUBLE AND ok UNION ALL SELECT b, a, hybrid FROM c WHERE hybrid >= 0.4::DOUBLE AND ok),
 t AS (SELECT l.c AS center, l.x AS x, r.x AS y, l.hybrid AS hx, r.hybrid AS hy FROM e l JOIN e r ON l.c = r.c AND l.x < r.x),
 g AS (SELECT t.*, d.hybrid AS direct, CASE WHEN d.a IS NULL THEN 'not_shortlisted' WHEN NOT d.ok THEN 'family_block' WHEN d.hybrid < 0.3::DOUBLE THEN 'below_low' WHEN d.hybrid < 0.4::DOUBLE THEN 'ambiguous_gap' ELSE 'high_connected' END AS gap FROM t LEFT JOIN c d ON d.a = t.x AND d.b = t.y),
 s AS (SELECT *, CASE gap WHEN 'family_block' THEN 220 WHEN 'below_low' THEN 150 WHEN 'ambiguous_gap' THEN 80 WHEN 'not_shortlisted' THEN 40 ELSE 0 END + coalesce(greatest(0, 0.4::DOUBLE - direct) * 100, 0) + least(hx, hy) * 10 AS sev FROM g WHERE gap <> 'high_connected')"""


@query(f"""WITH {_TRIADS} SELECT center, count(*) AS triads, count(*) FILTER (gap = 'family_block') AS family_block, count(*) FILTER (gap = 'below_low') AS below_low, count(*) FILTER (gap = 'ambiguous_gap') AS ambiguous_gap,
 count(*) FILTER (gap = 'not_shortlisted') AS not_shortlisted, round(max(sev), 4) AS max_severity, CASE WHEN bool_or(gap IN ('family_block', 'below_low')) THEN 'high' WHEN bool_or(gap = 'ambiguous_gap') THEN 'medium' ELSE 'review' END AS risk FROM s GROUP BY 1""")
def bridge_triads(spark, sf_dir):
    """Events that hold together others which do not; thresholds fit the invented vectors' scores."""
    def pairs(**options):
        p = scored_pairs(spark, sf_dir, "hybrid", "a_family", "b_family", **options)
        return p.select("a", "b", "hybrid", V.family_compatible(F.col("a_family"), F.col("b_family")).alias("compatible"), F.lit(None).cast("string").alias("label"))

    # Strong pairs are few. How the outer ends of their triads stand to one another is scored anew, for those ends alone,
    # so that the other pairs are neither written nor joined.
    strong = kept(pairs(least=0.4).where("compatible").select("a", "b", "hybrid"))
    triads = E.triads(strong)
    ends = triads.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    c = E.bridge_candidates(E.suspicious(triads, pairs(only=ends), 0.3, 0.4))
    return c.select("center", "triads", "family_block", "below_low", "ambiguous_gap", "not_shortlisted", F.round("max_severity", 4).alias("max_severity"), "risk")


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
 w AS (SELECT *, i = round(0.5::DOUBLE * (n - 1)) AS mid, i = round(0.9::DOUBLE * (n - 1)) AS high FROM r)
 SELECT source, n, max(CASE WHEN mid THEN n_chars END) AS p50, max(CASE WHEN high THEN n_chars END) AS p90 FROM w GROUP BY 1, 2""")
def length_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of text length per source, by rank and not by gathering a source's lengths."""
    return E.quantiles(load(spark, sf_dir, "documents"), "n_chars", {"p50": 0.5, "p90": 0.9}, ["source"], per=1 / 64, nearest=True)


@query(f"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, length({_MAIN}) AS n, length({_TITLE}) AS t FROM pages)
 SELECT host, count(*) AS pages, count(*) FILTER (n >= 200) AS usable, round(count(*) FILTER (n >= 200) / count(*), 6) AS rate, median(n) AS median_chars, max(t) AS longest_title FROM p GROUP BY 1""")
def extractor_compare(spark, sf_dir):
    """Usable bodies (200 characters or more) and their median length per host."""
    p = kept(spread(load(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.char_length(T.main_text(F.col("html"))).alias("n"), F.char_length(T.first_tag_text(F.col("html"), "title")).alias("t")))  # three numbers a page, written once: medians read them twice more
    usable = F.count_if(F.col("n") >= 200)
    g = p.groupBy("host").agg(F.count("*").alias("pages"), usable.alias("usable"), F.round(usable / F.count("*"), 6).alias("rate"), F.coalesce(F.max("t"), F.lit(0)).alias("longest_title"))
    return g.join(E.quantiles(p, "n", {"median_chars": 0.5}, ["host"], per=1 / 64).drop("n"), "host", "left")


@query("""WITH s AS (SELECT conv_id AS story_id, count(*) AS member_count, max(turn) AS revision, CASE WHEN bool_or(role = 'system') AND max(turn) > 3 THEN 'merged' ELSE 'active' END AS status FROM conversations GROUP BY 1),
 c AS (SELECT conv_id AS story_id, count(*) FILTER (role <> 'system') AS member_count, max(turn) AS revision FROM conversations GROUP BY 1)
 SELECT CASE WHEN s.status <> 'active' THEN 'candidate_story_inactive' WHEN s.member_count <> c.member_count OR s.revision <> c.revision THEN 'candidate_snapshot_changed' ELSE 'valid' END AS state, count(*) AS n FROM c LEFT JOIN s USING (story_id) GROUP BY 1""")
def snapshot_validation(spark, sf_dir):
    """Candidates as they were shown against the stories as they are."""
    g = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("story_id"))
    merged = F.max(F.col("role") == "system") & (F.max("turn") > 3)
    now = g.agg(F.count("*").alias("member_count"), F.max("turn").alias("revision"), F.when(merged, "merged").otherwise("active").alias("status")).withColumn("merged_into", F.lit(None).cast("long"))
    shown = g.agg(F.count_if(F.col("role") != "system").alias("member_count"), F.max("turn").alias("revision"))
    return review.snapshot_state(shown, now).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS_SQL}, b AS (SELECT b AS event_id, a AS story_id, row_number() OVER (PARTITION BY b ORDER BY hybrid DESC, a) AS place FROM sp),
 m AS (SELECT p.event_id AS story_id, e.event_id AS member_id, row_number() OVER (PARTITION BY p.event_id ORDER BY epoch_us(e.ts), e.event_id) AS member_place FROM ev p JOIN ev e ON e.person = p.person AND e.family = p.family AND e.club = p.club JOIN embeddings ON vec_id = p.event_id)
 SELECT b.event_id, b.story_id, place, member_id, member_place FROM b LEFT JOIN m ON b.story_id = m.story_id AND member_place <= 3 WHERE place <= 4""")
def representative_members(spark, sf_dir):
    """The best four candidate stories of each event with their first three members."""
    candidates = scored_pairs(spark, sf_dir, "hybrid").select(F.col("b").alias("event_id"), F.col("a").alias("story_id"), "hybrid")
    e = events(spark, sf_dir).select("person", "family", "club", F.col("event_id").alias("member_id"), F.unix_micros("ts").alias("rank"))
    # A story's members are those of its founder's person, family and club: the first of each such group are found once.
    group = ["person", "family", "club"]
    first = e.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("rank", "member_id"))).where(F.col("n") <= review.MOST_MEMBERS).drop("n")
    founders = events(spark, sf_dir).join(load(spark, sf_dir, "embeddings"), F.col("event_id") == F.col("vec_id"), "left_semi").select(F.col("event_id").alias("story_id"), *group)
    members = founders.join(first, group).select("story_id", "member_id", "rank")
    return review.representatives(candidates, members)


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT a, b, hybrid, floor(hybrid * 20)::INT AS bucket, la = lb AS same FROM sp) SELECT bucket, same, count(*) AS pairs, round(min(hybrid), 6) AS least, round(max(hybrid), 6) AS most FROM c GROUP BY 1, 2""")
def score_histogram(spark, sf_dir):
    c = _counted(spark, sf_dir, lambda h: np.nan_to_num(np.floor(h * 20)))
    return c.select(F.col("level").alias("bucket"), "same", F.col("n").alias("pairs"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with the gates: an event's person, club and salient token stand for its anchors."""
    e = events(spark, sf_dir).select("event_id", F.col("family").alias("kind"), F.col("person").cast("string").alias("who"), "club", F.col("salient").alias("anchor"))
    sides = [f"{s}_{c}" for s in "ab" for c in ("kind", "who", "club", "anchor")]
    p = scored_pairs(spark, sf_dir, "lex", "hybrid", "a_label", "b_label", *sides, extra=e)
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    for s in "ab":
        p = p.withColumns({f"{s}_family": F.col(f"{s}_kind"), f"{s}_people": F.array(f"{s}_who"), f"{s}_clubs": F.array(f"{s}_club"), f"{s}_relations": none, f"{s}_opponents": none, f"{s}_procedure": text, f"{s}_competition": text})
    g = review.gates(V.family_compatible(F.col("a_family"), F.col("b_family")), F.col("a_family"), F.col("b_family"), review.gate_features("a_", "b_"), F.col("lex"))
    return p.select("a", "b", "hybrid", (F.col("a_label") == F.col("b_label")).alias("same"), *[c.alias(n) for n, c in g.items()])


@query(f"""WITH {PAIRS_SQL}, g AS (SELECT sp.*, x.person = y.person AS person, x.club = y.club AS club, x.salient = y.salient AS anchor, ({_RAW_OK}) AS ok FROM sp JOIN ev x ON x.event_id = a JOIN ev y ON y.event_id = b),
 h AS (SELECT la = lb AS same, hybrid, ok AS family_compat, ok AND anchor AS football_conflicts, ok AND anchor AND person AND club AS football_anchor_v1 FROM g)
 SELECT same, hybrid >= 0.4::DOUBLE AS merged, count(*) AS baseline, count(*) FILTER (family_compat) AS family_compat, count(*) FILTER (football_conflicts) AS football_conflicts, count(*) FILTER (football_anchor_v1) AS football_anchor_v1 FROM h GROUP BY 1, 2""")
def gate_audit(spark, sf_dir):
    """How many scored pairs each gate lets through, by truth and by score."""
    g = _gated(spark, sf_dir)
    return g.groupBy("same", (F.col("hybrid") >= 0.4).alias("merged")).agg(*[F.count_if(n).alias(n) for n in ("baseline", "family_compat", "football_conflicts", "football_anchor_v1")])
