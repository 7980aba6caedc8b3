"""Pairing, scoring and deciding."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import vector as V
from storyloom.operators import blocks as B
from storyloom.operators import pairs as P
from storyloom.operators import queues
from storyloom.operators import sparse as S
from storyloom.plans.registry import ORACLES, query
from storyloom.plans.texts import _TOKENS, _TOPIC
from storyloom.sources.sinks import kept
from storyloom.sources.tables import ARTICLES_SQL, EVENTS_SQL, MATCH_SQL, articles, events, load, match_events, matched


@query(f"""WITH {EVENTS_SQL} SELECT a.event_id AS a, b.event_id AS b, round(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 3600000000, 4) AS hours
 FROM ev a JOIN ev b ON a.person = b.person AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 172800000000""")
def band_pairs_48h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "person", F.unix_micros("ts").alias("us"))
    p = P.band_pairs(e, "event_id", "us", 48 * P.HOUR, ["person"])
    return p.select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), F.round(F.abs(F.col("a_us") - F.col("b_us")) / P.HOUR, 4).alias("hours"))


_POST = f"""{EVENTS_SQL}, post AS (SELECT DISTINCT 'salient' AS kt, salient AS kv, person || '/' || strftime(ts, '%Y-%m-%d') AS story FROM ev WHERE family <> 'error'
  UNION ALL SELECT DISTINCT 'person', person::VARCHAR, person || '/' || strftime(ts, '%Y-%m-%d') FROM ev WHERE family <> 'error'),
 q AS (SELECT event_id, 'salient' AS kt, salient AS kv FROM ev WHERE family = 'error' UNION ALL SELECT event_id, 'person', person::VARCHAR FROM ev WHERE family = 'error')"""


def _postings(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("story_id", F.concat_ws("/", F.col("person").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    none = F.array().cast("array<string>")
    key = P.index_keys(F.array(F.col("person").cast("string")), none, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), none, F.array("salient"))
    keyed = e.select("event_id", "story_id", "family", "person", "salient", F.inline(key))
    return keyed.where("family = 'error'"), keyed.where("family != 'error'")


@query(f"""WITH {_POST}, m AS (SELECT event_id, story, count(*) AS n FROM q JOIN post USING (kt, kv) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, story) AS place FROM m)
 SELECT event_id, story AS story_id, n AS matched_key_count, place FROM r WHERE place <= 16""")
def posting_top_stories(spark, sf_dir):
    """Pending events probe the stories' posting lists."""
    q, members = _postings(spark, sf_dir)
    postings = members.select("key_type", "key_value", "story_id").distinct()
    return P.probe(q.select("event_id", "key_type", "key_value"), postings, "event_id")


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT e.event_id, s.person AS story, s.event_id AS member, max((s.person = e.person)::INT) AS person_hit, count(DISTINCT CASE WHEN s.salient = e.salient THEN s.salient END) AS salient_hits, max(s.ts) AS ts
   FROM ev e JOIN ev s ON e.family = 'error' AND s.family <> 'error' AND s.person = e.person AND s.club = e.club GROUP BY 1, 2, 3),
 r AS (SELECT event_id, story, member, person_hit, salient_hits, count(*) OVER (PARTITION BY event_id, story) AS qualified_count,
   row_number() OVER (PARTITION BY event_id, story ORDER BY person_hit DESC, salient_hits DESC, ts DESC, member) AS member_rank FROM m)
 SELECT event_id, story, member, person_hit, salient_hits, qualified_count, member_rank FROM r WHERE member_rank <= 24""")
def qualified_members_topk(spark, sf_dir):
    """The best 24 members of each candidate story, and how many there were."""
    e = events(spark, sf_dir)
    pending = e.where("family = 'error'").select("event_id", "person", "club", F.col("salient").alias("s"))
    members = e.where("family != 'error'").select(F.col("event_id").alias("member"), "person", "club", "salient", "ts")
    hits = pending.join(members, ["person", "club"]).groupBy("event_id", F.col("person").alias("story"), "member").agg(
        F.lit(1).alias("person_hit"), F.count_distinct(F.when(F.col("salient") == F.col("s"), F.col("salient"))).alias("salient_hits"), F.max("ts").alias("ts")
    )
    order = [F.desc("person_hit"), F.desc("salient_hits"), F.desc("ts"), F.asc("member")]
    return queues.with_rank(hits, ["event_id", "story"], order, 24).drop("ts")


# -- scored pairs of vectors ----------------------------------------------------------------------------------------------
#: Events that have a vector, with the tokens that tell stories apart: in at most three percent of these events.
RECORDS_SQL = f"""{EVENTS_SQL}, {MATCH_SQL}, mv AS (SELECT me.*, label, embedding::DOUBLE[] AS e FROM me JOIN embeddings ON vec_id = event_id),
 sal AS (SELECT event_id, list(token) AS salient FROM (SELECT event_id, unnest(tokens) AS token FROM mv)
   JOIN (SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM mv) GROUP BY 1) USING (token) WHERE df <= (SELECT greatest(3, ceil(count(*) * 0.03)) FROM mv) GROUP BY 1),
 v AS (SELECT mv.*, coalesce(salient, []) AS salient FROM mv LEFT JOIN sal USING (event_id))"""
_FAMILY_OK = "fa = fb OR fa = 'unknown' OR fb = 'unknown' OR concat_ws('|', least(fa, fb), greatest(fa, fb)) IN ('contract|transfer','discipline|transfer','competition|match','discipline|match','contract|staff','finance|institutional')"
PAIRS_SQL = f"""{RECORDS_SQL}, cp AS (SELECT a.event_id AS a, b.event_id AS b, a.label AS la, b.label AS lb, a.family AS fa, b.family AS fb, a.e AS ea, b.e AS eb, a.tokens AS ta, b.tokens AS tb, a.ts AS sa, b.ts AS sb, a.people[1] AS pa,
   len(list_intersect(a.people, b.people)) AS np, len(list_intersect(a.relations, b.relations)) + len(list_intersect(a.relations, b.clubs)) + len(list_intersect(b.relations, a.clubs)) AS nr,
   len(list_intersect(a.clubs, b.clubs)) AS nc, len(list_intersect(a.salient, b.salient)) AS ns, a.family = b.family AND a.family <> 'unknown' AS kin
   FROM v a JOIN v b ON a.event_id < b.event_id AND a.article <> b.article),
 pr AS (SELECT *, list_filter([CASE WHEN np > 0 THEN 'person:' || np END, CASE WHEN nr > 0 THEN 'from_to:' || nr END, CASE WHEN nc >= 2 THEN 'clubs:' || nc END, CASE WHEN kin AND nc > 0 AND ns >= 2 THEN 'family+club+salient2' END,
   CASE WHEN kin AND ns >= 3 THEN 'family+salient3' END, CASE WHEN ns >= 4 THEN 'salient4' END], lambda x: x IS NOT NULL) AS reasons FROM cp),
 sc AS (SELECT *, list_cosine_similarity(ea, eb) AS emb, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS lex, exp(-pow(abs(epoch_us(sa) - epoch_us(sb)) / 86400000000, 2) / 98.0) AS tmp FROM pr WHERE len(reasons) > 0),
 sp AS (SELECT a, b, la, lb, fa, fb, pa, reasons, emb, lex, tmp, round(0.60::DOUBLE * emb + 0.25::DOUBLE * lex + 0.15::DOUBLE * tmp, 9) AS hybrid FROM sc)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have a vector, with it and their salient tokens; a story is the first person's. Few events have one: they
    are found by their ids before anything is worked out about an event, and written once, as they are read several times."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    ends = v.agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).first()
    own = F.col("event_id") == F.col("vec_id")
    near = load(spark, sf_dir, "events").where(F.col("event_id").between(ends["first"], ends["last"]))  # skips what a file says it does not hold
    e = kept(matched(near.join(v.select("vec_id"), own, "left_semi").join(v, own), "label", "embedding"))
    most = e.agg(F.greatest(F.lit(3), F.ceil(F.count("*") * F.lit(0.03))).alias("n")).scalar()
    long = e.select("event_id", F.explode("tokens").alias("token"))
    rare = long.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= most).select("token")
    salient = long.join(rare, "token").groupBy("event_id").agg(F.collect_list("token").alias("salient"))
    return e.join(salient, "event_id", "left").withColumn("salient", F.coalesce("salient", F.array().cast("array<string>"))).withColumn("person", F.col("people")[0])


_COUNTS = ["n_people", "n_relations", "n_clubs", "n_salient", "kin"]


def scored_pairs(spark: SparkSession, sf_dir: str, *columns: str, extra: DataFrame | None = None, **options) -> DataFrame:
    """Every shortlisted pair of events, with the columns asked for: a and b (always), lex, tmp, emb and hybrid (scores),
    the counts of the rules, reasons, label, family or person of a side (a_label), or a column of `extra`, which is joined
    by event_id. hybrid is rounded to nine places, so that every engine puts a pair on the same side of a threshold.
    `options` are those of `blocks.block_pairs`."""
    wanted = [c for c in ["lex", "tmp", "emb", "hybrid", "reasons", *_COUNTS] if c in columns]
    r = records(spark, sf_dir)
    return B.block_pairs(r if extra is None else r.join(extra, "event_id"), "event_id", wanted, [c for c in columns if c[:2] in ("a_", "b_")], **options)


@query(f"WITH {PAIRS_SQL} SELECT a, b, array_to_string(reasons, ',') AS reasons FROM sp")
def shortlist_pairs(spark, sf_dir):
    """Pairs of events of different articles that any of the six rules keeps, and the rules that do."""
    return scored_pairs(spark, sf_dir, "reasons")


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT unnest(reasons) AS reason FROM sp) SELECT regexp_replace(reason, ':.*', '') AS rule, count(*) AS pairs FROM r GROUP BY 1""")
def shortlist_rules(spark, sf_dir):
    """How many pairs each rule of the shortlist keeps."""
    rules = B.reason_columns()
    counts = scored_pairs(spark, sf_dir, *_COUNTS).agg(*[F.count_if(holds).alias(rule) for rule, (holds, _) in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("pairs")) for rule in rules]))).where("pairs > 0")


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(emb, 6) AS cosine FROM sp")
def cosine_pairs(spark, sf_dir):
    return scored_pairs(spark, sf_dir, "emb", digits={"emb": 6}).withColumnRenamed("emb", "cosine")


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(lex, 6) AS lexical, round(tmp, 6) AS temporal, round(hybrid, 6) AS hybrid FROM sp")
def hybrid_scores(spark, sf_dir):
    p = scored_pairs(spark, sf_dir, "lex", "tmp", "hybrid", digits={"lex": 6, "tmp": 6, "hybrid": 6})
    return p.withColumnsRenamed({"lex": "lexical", "tmp": "temporal"})


def _looked_up(events: DataFrame) -> DataFrame:
    """(event_id, story_id): for each event that shares a club with an earlier event of another article and person, some
    such story. Stories that no rule of the shortlist keeps say nothing about the decision but that there was a candidate,
    so one is enough; a club's first events that differ from one another stand for all of its events.

    Whatever earlier event fits, an earlier or equal one of these fits, too: the first (r); the first of another article
    than r's (s) and the first of those that is not of s's person either; the first of another person than r's (p) and the
    first of those that is not of p's article either; the first that differs from r in both."""
    one = events.where("article is not null and person is not null").select(F.explode("clubs").alias("club"), F.struct("event_id", "article", "person").alias("e"))
    first = lambda df, name: df.groupBy("club").agg(F.min("e").alias(name))
    other = lambda x, y, field: F.col(f"{x}.{field}") != F.col(f"{y}.{field}")
    r = first(one, "r")
    rest = one.join(r, "club")
    s = rest.where(other("e", "r", "article"))
    p = rest.where(other("e", "r", "person"))
    firsts = first(s, "s").join(first(p, "p"), "club", "full")
    s2 = s.join(first(s, "s"), "club").where(other("e", "s", "person"))
    p2 = p.join(first(p, "p"), "club").where(other("e", "p", "article"))
    witnesses = [r.select("club", F.col("r").alias("w")), firsts.select("club", F.col("s").alias("w")), firsts.select("club", F.col("p").alias("w"))]
    witnesses += [first(x, "w") for x in (s2, p2, s.where(other("e", "r", "person")))]
    every = functools.reduce(DataFrame.union, witnesses).where("w is not null")  # six at most per club
    met = one.join(every, "club").where((F.col("w.event_id") < F.col("e.event_id")) & other("w", "e", "article") & other("w", "e", "person"))
    return met.groupBy(F.col("e.event_id").alias("event_id")).agg(F.min("w.person").alias("story_id"))


@query(f"""WITH {PAIRS_SQL}, sc2 AS (SELECT b, pa AS story, true AS pass, CASE WHEN a % 7 <> 0 THEN hybrid END AS hybrid, {_FAMILY_OK} AS ok FROM sp),
 lk AS (SELECT b, pa AS story, false AS pass, NULL::DOUBLE AS hybrid, false AS ok FROM cp WHERE nc > 0 AND np = 0),
 g AS (SELECT b AS event_id, story, bool_or(pass) AS pass, max(hybrid) AS hybrid, bool_or(ok AND hybrid IS NOT NULL) AS ok, count(*) FILTER (pass) > 4 AS cut FROM (SELECT * FROM sc2 UNION ALL SELECT * FROM lk) GROUP BY 1, 2),
 e AS (SELECT event_id, bool_or(pass AND hybrid IS NULL) AS broken, bool_or(pass AND hybrid IS NOT NULL AND cut) AS cut FROM g GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ok DESC, hybrid DESC, story) AS rn FROM g WHERE pass AND hybrid IS NOT NULL),
 d AS (SELECT e.event_id, broken, e.cut, story, hybrid, ok FROM e LEFT JOIN r ON r.event_id = e.event_id AND rn = 1)
 SELECT event_id, story AS story_id, round(hybrid, 6) AS hybrid,
  CASE WHEN hybrid IS NULL AND broken THEN 'AMBIGUOUS_AI' WHEN hybrid IS NULL THEN 'AUTO_NEW_STORY' WHEN NOT ok AND hybrid >= 0.2::DOUBLE THEN 'AMBIGUOUS_AI' WHEN NOT ok THEN 'AUTO_NEW_STORY' WHEN cut THEN 'AMBIGUOUS_AI'
   WHEN hybrid >= 0.3::DOUBLE THEN 'AUTO_ATTACH' WHEN hybrid >= 0.2::DOUBLE THEN 'AMBIGUOUS_AI' ELSE 'AUTO_NEW_STORY' END AS decision,
  CASE WHEN hybrid IS NULL AND broken THEN 'candidate_centroid_invalid' WHEN hybrid IS NULL THEN 'no_pairwise_candidate' WHEN NOT ok AND hybrid >= 0.2::DOUBLE THEN 'family_gate' WHEN NOT ok THEN 'family_gate_below_low'
   WHEN cut THEN 'bounded_membership_lower_bound' WHEN hybrid >= 0.3::DOUBLE THEN 'high_score' WHEN hybrid >= 0.2::DOUBLE THEN 'score_ambiguous' ELSE 'below_low' END AS reason FROM d""")
def story_decision(spark, sf_dir):
    """Each event against the stories of earlier events (a story is a person's): those looked up by a club alone pass no
    rule of the shortlist; every seventh event stands for one whose vector is not valid; beyond four members a story's
    score is a lower bound. Thresholds fit the invented vectors' scores."""
    p = scored_pairs(spark, sf_dir, "hybrid", "a_person", "a_family", "b_family")
    passed = p.select(F.col("b").alias("event_id"), F.col("a_person").alias("story_id"), F.lit(True).alias("pass"), F.when(F.col("a") % 7 != 0, F.col("hybrid")).alias("h"), V.family_compatible(F.col("a_family"), F.col("b_family")).alias("ok"))
    looked = _looked_up(records(spark, sf_dir).select("event_id", "article", "person", "clubs"))
    looked = looked.select("event_id", "story_id", F.lit(False).alias("pass"), F.lit(None).cast("double").alias("h"), F.lit(False).alias("ok"))
    scored = passed.unionByName(looked).groupBy("event_id", "story_id").agg(
        F.max("pass").alias("shortlist_pass"), F.max("h").alias("hybrid"), F.max(F.col("ok") & F.col("h").isNotNull()).alias("family_compatible"), (F.count_if("pass") > 4).alias("members_truncated")
    )
    out = P.decide_story(scored, "event_id", 0.2, 0.3)
    return out.select("event_id", "story_id", F.round("hybrid", 6).alias("hybrid"), "decision", "reason")


@query("""WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
 SELECT label, pos::INT AS pos, round(avg(x), 5) AS mean FROM u GROUP BY 1, 2""")
def centroid_mean(spark, sf_dir):
    means = V.mean_vectors(load(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("mean"))


_CTX = lambda: f"list_distinct(list_concat({_TOKENS('title')}, {_TOKENS('excerpt')}))"


@query(f"""WITH {ARTICLES_SQL}, k AS (SELECT id, published_s, {_TOKENS('title')} AS tt, {_CTX()} AS ct FROM art),
 df AS (SELECT token, count(*) AS df FROM (SELECT unnest(ct) AS token FROM k) GROUP BY 1), n AS (SELECT count(*) AS n FROM k), w AS (SELECT token, 1 + ln((n + 1) / (df + 1)) AS w FROM df, n),
 b AS (SELECT a.id AS a, b.id AS b, abs(a.published_s - b.published_s) / 3600 AS hours, a.tt AS a_t, b.tt AS b_t, a.ct AS ac, b.ct AS bc FROM k a JOIN k b ON a.id < b.id AND b.id - a.id <= 48),
 ct AS (SELECT a, b, hours, a_t, b_t, ac, bc FROM b),
 tk AS (SELECT a, b, hours, unnest(list_distinct(list_concat(ac, bc))) AS token, a_t, b_t, ac, bc FROM ct),
 s AS (SELECT a, b, hours, sum(CASE WHEN list_contains(a_t, token) AND list_contains(b_t, token) THEN w ELSE 0 END) AS ti, sum(CASE WHEN list_contains(a_t, token) OR list_contains(b_t, token) THEN w ELSE 0 END) AS tu,
   sum(CASE WHEN list_contains(ac, token) AND list_contains(bc, token) THEN w ELSE 0 END) AS ci, sum(w) AS cu,
   count(*) FILTER (list_contains(a_t, token) AND list_contains(b_t, token)) AS nt, count(*) FILTER (list_contains(ac, token) AND list_contains(bc, token)) AS nc,
   count(*) FILTER (list_contains(ac, token) AND list_contains(bc, token) AND length(token) >= 4 AND w >= 1.35) AS ns FROM tk JOIN w USING (token) GROUP BY 1, 2, 3),
 f AS (SELECT a, b, hours, nt, nc, ns, CASE WHEN tu > 0 THEN ti / tu ELSE 0 END AS t, CASE WHEN cu > 0 THEN ci / cu ELSE 0 END AS c FROM s),
 g AS (SELECT *, round(least(1.0::DOUBLE, 0.6::DOUBLE * t + 0.4::DOUBLE * c + least(0.24::DOUBLE, 0.08::DOUBLE * ns)), 9) AS score FROM f),
 h AS (SELECT *, CASE WHEN hours > 48 THEN 'none' WHEN (score >= 0.62::DOUBLE AND nc >= 2) OR (score >= 0.54::DOUBLE AND nt >= 2) OR (score >= 0.48::DOUBLE AND nt >= 1 AND nc >= 3) THEN 'strong'
   WHEN (score >= 0.38::DOUBLE AND ns >= 2) OR (nt >= 2 AND ns >= 2 AND score >= 0.26::DOUBLE) OR (nt >= 1 AND ns >= 2 AND nc >= 3 AND hours <= 12) OR (ns >= 3 AND nc >= 4 AND hours <= 12) THEN 'candidate' ELSE 'none' END AS confidence FROM g)
 SELECT a, b, confidence, round(score, 4) AS score, round(t, 4) AS title_score, round(c, 4) AS context_score, nt::INT AS shared_title, nc::INT AS shared_context, ns::INT AS shared_salient FROM h WHERE confidence <> 'none'""")
def weighted_jaccard_pairs(spark, sf_dir):
    """Article pairs of a 48-hour band by weighted overlap of title and context."""
    a = articles(spark, sf_dir)
    k = a.select("id", F.unix_micros("published_at").alias("us"), T.tokens(F.col("title")).alias("tt"), T.tokens(F.col("excerpt")).alias("te"))
    k = k.select("id", "us", "tt", F.array_union("tt", "te").alias("ct"))
    n = load(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    df = k.select(F.explode("ct").alias("token")).groupBy("token").agg(F.count("*").alias("df")).withColumn("w", F.lit(1.0) + F.log((n.scalar() + 1) / (F.col("df") + 1)))
    long = k.select("id", "us", F.explode("ct").alias("token"), "tt").join(df, "token")
    entry = F.struct("token", "w", F.array_contains("tt", F.col("token")).alias("t"), ((F.length("token") >= 4) & (F.col("w") >= 1.35)).alias("s"))
    rows = long.groupBy("id", "us").agg(F.collect_list(entry).alias("e"))
    rows = rows.select("id", "us", F.col("e.token").alias("tokens"), F.col("e.w").alias("weights"), F.col("e.t").alias("titled"), F.col("e.s").alias("salient"))
    # Whatever makes a pair strong or a candidate asks for two common tokens of title or context.
    p = S.band_overlaps(rows, 48 * P.HOUR).where("shared_context >= 2").withColumn("hours", F.col("gap") / P.HOUR)
    score = F.least(F.lit(1.0), F.lit(0.6) * F.col("t") + F.lit(0.4) * F.col("c") + F.least(F.lit(0.24), F.lit(0.08) * F.col("shared_salient")))
    p = p.withColumn("score", F.round(score, 9))
    p = p.withColumn("confidence", P.pair_class(F.col("score"), F.col("shared_title"), F.col("shared_context"), F.col("shared_salient"), F.col("hours")))
    return p.where("confidence != 'none'").select("a", "b", "confidence", F.round("score", 4).alias("score"), F.round("t", 4).alias("title_score"), F.round("c", 4).alias("context_score"), "shared_title", "shared_context", "shared_salient")


_TERMS = f"list_filter(string_split({_TOPIC("title || ' ' || excerpt")}, ' '), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\\d+$'))"


@query(f"""WITH {ARTICLES_SQL}, t AS (SELECT id, source_id, unnest({_TERMS}) AS token FROM art), n AS (SELECT count(*) AS n FROM art), c AS (SELECT id, source_id, token, count(*) AS c FROM t GROUP BY 1, 2, 3),
 df AS (SELECT token, count(*) AS df FROM c GROUP BY 1), w AS (SELECT id, source_id, token, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df USING (token), n),
 v AS (SELECT id, source_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w), p AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS score FROM v x JOIN v y ON x.token = y.token AND x.source_id = y.source_id AND x.id < y.id GROUP BY 1, 2)
 SELECT a, b, round(score, 5) AS score FROM p WHERE round(score, 9) >= 0.18::DOUBLE""")
def tfidf_pairs(spark, sf_dir):
    """Articles of one source that share enough vocabulary in title and excerpt: tf 1 + ln(count), smoothed idf, vectors of
    length one, all tokens counted."""
    a = articles(spark, sf_dir).select("id", "source_id", F.explode(T.terms(F.concat_ws(" ", "title", "excerpt"))).alias("token"))
    n = load(spark, sf_dir, "documents").agg(F.count("*").alias("n")).scalar()
    c = a.groupBy("id", "source_id", "token").agg(F.count("*").alias("c"))
    df = c.groupBy("token").agg(F.count("*").alias("df"))
    w = c.join(df, "token").withColumn("w", (F.lit(1.0) + F.log("c")) * (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    v = w.select("id", "source_id", "token", (F.col("w") / norm).alias("w"))
    sizes = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("n"))
    return S.token_pairs(v, "id", "w", 0.18 - 5e-10, "source_id", sizes).select("a", "b", F.round("score", 5).alias("score"))


@query(f"SELECT * FROM ({ORACLES['weighted_jaccard_pairs']}) ORDER BY (confidence = 'strong') DESC, score DESC, a, b LIMIT 30")
def preview_pairs(spark, sf_dir):
    """The thirty best article pairs: strong ones first, then by score, then by id (a report of fixed length)."""
    p = weighted_jaccard_pairs(spark, sf_dir)
    return p.orderBy(F.desc(F.col("confidence") == "strong"), F.desc("score"), "a", "b").limit(30)
