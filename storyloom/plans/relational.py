"""Joins, aggregates, windows, queues and writes on the star-schema tables.

Orders stand for articles (status F done, P to be tried again, O open), line items for assessments (return flag R
relevant, N to be reviewed, A rejected; line status F assessed), customers and nations for sources and clubs,
conversations for stored versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators import queues
from storyloom.plans.registry import query
from storyloom.sources.tables import load

FLAGS = ("A", "N", "R")


@query("""SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
  OR (o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'O'))
  OR (o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM (VALUES ('A'), ('N'), ('R')) f(flag) WHERE NOT EXISTS
     (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = f.flag)))""")
def backlog_any_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with no assessment, or due again, or done with some topic unassessed: one pass of flags per article."""
    flags = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("open"),
        *[F.max((F.col("l_returnflag") == f).cast("int")).alias(f"has_{f}") for f in FLAGS],
    )
    o = load(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    some = F.col("has_A") + F.col("has_N") + F.col("has_R") < 3
    wanted = F.col("l_orderkey").isNull() | ((F.col("o_orderstatus") == "P") & (F.col("open") == 1)) | ((F.col("o_orderstatus") == "F") & some)
    return o.where(wanted).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def semi_relevant(spark, sf_dir):
    good = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").join(good, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND (l_linestatus = 'F' OR l_returnflag = 'A'))")
def anti_done(spark, sf_dir):
    """The status disjunction is applied to the ledger before the anti join, so the join stays an equi-join."""
    done = load(spark, sf_dir, "lineitem").where("l_linestatus = 'F' or l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'N')
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')""")
def review_without_relevant(spark, sf_dir):
    flags = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_returnflag") == "N").cast("int")).alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    return load(spark, sf_dir, "orders").join(flags.where("n = 1 and r = 0"), "o_orderkey", "left_semi").select("o_orderkey")


@query("""SELECT conv_id, turn, role, sha256(text) AS text_hash FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_per_key(spark, sf_dir):
    best = queues.latest_value(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "text"])
    return best.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))


@query("""WITH v AS (SELECT conv_id, turn, sha256(text) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
  SELECT conv_id, count(*) AS versions, count(DISTINCT h) AS distinct_hashes, min(turn) AS first_turn, max(turn) AS last_turn,
         string_agg(CASE WHEN rn <= 5 THEN h END, ',' ORDER BY turn DESC) AS newest
  FROM v GROUP BY conv_id HAVING count(DISTINCT h) > 1""")
def hash_instability(spark, sf_dir):
    """Articles whose content hash changed, with their five newest versions from one window instead of a query each."""
    v = load(spark, sf_dir, "conversations").withColumn("h", F.sha2("text", 256))
    v = v.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    newest = F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "h"))))
    out = v.groupBy("conv_id").agg(F.count("*").alias("versions"), F.count_distinct("h").alias("distinct_hashes"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), newest.alias("n"))
    return out.where("distinct_hashes > 1").withColumn("newest", F.array_join(F.transform("n", lambda x: x["h"]), ",")).drop("n")


@query("""SELECT r_name, n_name, o_orderpriority, count(*) AS articles, count(c_custkey) AS with_source, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL""")
def star_join_left(spark, sf_dir):
    """Dimensions are small and of fixed size (nation, region); the customer side is left to the optimizer."""
    place = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    source = load(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    o = load(spark, sf_dir, "orders").join(source, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.groupBy("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("articles"), F.count("c_custkey").alias("with_source"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("""SELECT n_name, n.n_regionkey, count(s_suppkey) AS suppliers, min(s_name) AS first_name FROM nation n LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0
  GROUP BY 1, 2 ORDER BY min(s_name) NULLS LAST, n_name""")
def sources_of_topic(spark, sf_dir):
    """A left join with a constant condition on its right side, ordered with missing ones last."""
    s = load(spark, sf_dir, "supplier").where("s_acctbal > 0")
    out = load(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "n_regionkey").agg(F.count("s_suppkey").alias("suppliers"), F.min("s_name").alias("first_name"))
    return out.orderBy(F.asc_nulls_last("first_name"), "n_name")


@query("SELECT l_returnflag AS decision, l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def reason_histogram(spark, sf_dir):
    out = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("decision"), F.col("l_linestatus").alias("reason")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "decision", "reason").limit(20)


@query("SELECT s_nationkey AS source, l_returnflag AS reason, count(*) AS n, count(DISTINCT l_orderkey) AS articles FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def source_reason(spark, sf_dir):
    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("s_nationkey").alias("source"), F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("articles"))


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS expected, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_suppkey END) AS assessed
  FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_suppkey END)""")
def distinct_gate_having(spark, sf_dir):
    """Articles of which every expected topic is assessed."""
    out = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("expected"), F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("assessed"))
    return out.where("expected = assessed")


@query("""SELECT count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS retry, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS waiting,
  count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS done_sources FROM orders""")
def distinct_counts(spark, sf_dir):
    when = lambda s, c: F.count_distinct(F.when(F.col("o_orderstatus") == s, F.col(c)))
    return load(spark, sf_dir, "orders").agg(when("P", "o_orderkey").alias("retry"), when("O", "o_orderkey").alias("waiting"), when("F", "o_custkey").alias("done_sources"))


@query("""WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS relevant, count(*) FILTER (l_returnflag = 'N') AS review, count(*) FILTER (l_returnflag = 'A') AS rejected FROM lineitem GROUP BY 1)
  SELECT o_orderkey, coalesce(relevant, 0) AS relevant, coalesce(review, 0) AS review, coalesce(rejected, 0) AS rejected,
  CASE WHEN o_orderstatus = 'P' THEN 'phase_a_retry' WHEN relevant > 0 THEN 'phase_a_ready' WHEN review > 0 THEN 'phase_a_review' WHEN rejected > 0 THEN 'phase_a_rejected' ELSE 'phase_a_processed' END AS status
  FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def status_rollup(spark, sf_dir):
    counts = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == f).alias(n) for f, n in (("R", "relevant"), ("N", "review"), ("A", "rejected"))])
    o = load(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["relevant", "review", "rejected"])
    again = (F.col("o_orderstatus") == "P").cast("int")
    return o.select("o_orderkey", "relevant", "review", "rejected", queues.coarse_status(again, F.lit(0), F.col("relevant"), F.col("review"), F.col("rejected")).alias("status"))


@query("""WITH old AS (SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) AS h FROM orders WHERE o_orderstatus <> 'O'),
  new AS (SELECT o_orderkey, sha256(CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END || '|' || o_orderpriority) AS h FROM orders)
  SELECT CASE WHEN old.o_orderkey IS NULL THEN 'insert' WHEN old.h = new.h THEN 'unchanged' ELSE 'update' END AS action, count(*) AS n, min(new.o_orderkey) AS least, max(new.o_orderkey) AS most
  FROM new LEFT JOIN old USING (o_orderkey) GROUP BY 1""")
def upsert_plan(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    hashed = lambda status: F.sha2(F.concat_ws("|", status, "o_orderpriority"), 256)
    current = o.where("o_orderstatus <> 'O'").select("o_orderkey", hashed(F.col("o_orderstatus")).alias("h"))
    incoming = o.select("o_orderkey", hashed(F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise(F.col("o_orderstatus"))).alias("h"))
    plan = queues.upsert_plan(current, incoming, ["o_orderkey"], "h")
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


@query("""SELECT c.conv_id, c.turn, 'superseded' AS status FROM conversations c WHERE NOT EXISTS
  (SELECT 1 FROM conversations p WHERE p.role <> 'system' AND p.conv_id = c.conv_id AND p.turn = c.turn)""")
def supersede(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return queues.superseded(c.select("conv_id", "turn"), c.where("role <> 'system'"), ["conv_id", "turn"]).withColumn("status", F.lit("superseded"))


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def queue_page(spark, sf_dir):
    """Oldest first, ties by id; the page is the feature."""
    o = load(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return o.orderBy("o_orderdate", "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT doc_id, CASE WHEN length(trim(coalesce(CASE WHEN quality = 1 THEN text END, ''))) > 0 THEN 'enriched'
  WHEN length(trim(coalesce(CASE WHEN quality = 0 THEN text END, ''))) > 0 THEN 'extracted' ELSE 'raw' END AS provenance,
  coalesce(CASE WHEN quality = 1 THEN 1 END, CASE WHEN quality = 0 THEN 2 END, 3) AS preference FROM documents LEFT JOIN labels USING (doc_id)""")
def provenance_coalesce(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    held = lambda q: F.length(F.trim(F.coalesce(F.when(F.col("quality") == q, F.col("text")), F.lit("")))) > 0
    rank = F.coalesce(F.when(F.col("quality") == 1, 1), F.when(F.col("quality") == 0, 2), F.lit(3))
    return d.select("doc_id", F.when(held(1), "enriched").when(held(0), "extracted").otherwise("raw").alias("provenance"), rank.alias("preference"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS qualified_count,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, (l_linestatus = 'F') DESC, l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) AS member_rank FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_returnflag, qualified_count, member_rank FROM q WHERE member_rank <= 3""")
def ranked_members(spark, sf_dir):
    order = [F.desc(F.col("l_returnflag") == "R"), F.desc(F.col("l_linestatus") == "F"), F.desc("l_shipdate"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return queues.with_rank(load(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 3).select("l_orderkey", "l_linenumber", "l_returnflag", "qualified_count", "member_rank")


@query("""SELECT s_suppkey, n_name, CASE WHEN s_acctbal >= 7500 THEN 10 WHEN s_acctbal >= 5000 THEN 20 WHEN s_acctbal >= 2500 THEN 30 ELSE 40 END AS priority,
  CASE WHEN n_regionkey = 0 THEN 'direct' ELSE 'general' END AS relation_type FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def authority_priority(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    tier = F.when(F.col("s_acctbal") >= 7500, 10).when(F.col("s_acctbal") >= 5000, 20).when(F.col("s_acctbal") >= 2500, 30).otherwise(40)
    return s.select("s_suppkey", "n_name", tier.alias("priority"), F.when(F.col("n_regionkey") == 0, "direct").otherwise("general").alias("relation_type"))


@query("""SELECT event_type, count(*) AS candidates, count(*) FILTER (value > 50) AS failed, count(*) FILTER (value <= 50) AS processed,
  CASE WHEN count(*) FILTER (value > 50) = count(*) THEN 'failed' WHEN count(*) FILTER (value > 50) > 0 THEN 'partial' ELSE 'success' END AS run_status,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (value <= 50) / count(*), 6) ELSE 0 END AS rate FROM events GROUP BY 1""")
def run_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("candidates"), F.count_if(F.col("value") > 50).alias("failed"), F.count_if(F.col("value") <= 50).alias("processed"))
    status = F.when(F.col("failed") == F.col("candidates"), "failed").when(F.col("failed") > 0, "partial").otherwise("success")
    return e.withColumn("run_status", status).withColumn("rate", F.round(F.when(F.col("candidates") > 0, F.col("processed") / F.col("candidates")).otherwise(0.0), 6))


@query("""WITH last AS (SELECT max(ts) AS now FROM events), r AS (SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status FROM events)
  SELECT event_id, CASE WHEN status = 'running' AND ts < now - INTERVAL 1 HOUR THEN 'abandoned' ELSE status END AS status FROM r, last""")
def stale_runs(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("started_at"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"))
    now = e.agg(F.max("started_at")).first()[0]
    return queues.abandon_stale(e, F.lit(now)).select("event_id", "status")


@query("""SELECT 'pages' AS kept_of, count(*) AS n FROM pages WHERE NOT (url LIKE 'https://m.%')
  UNION ALL SELECT 'documents', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url LIKE 'https://m.%' AND p.page_id = d.doc_id)""")
def purge_cascade(spark, sf_dir):
    pages, docs = queues.purge(load(spark, sf_dir, "pages"), [(load(spark, sf_dir, "documents"), "doc_id")], "page_id", F.col("url").like("https://m.%"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept_of"), "n")
    return one(pages, "pages").unionByName(one(docs, "documents"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN value <= 50 THEN 'done' WHEN user_id % 5 + 1 >= 5 THEN 'failed' ELSE 'retry' END AS status FROM events) GROUP BY 1""")
def retry_states(spark, sf_dir):
    """Embedding attempts end for good at the fifth."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(queues.next_state(F.col("user_id") % 5, F.col("value") > 50, 5).alias("status")).agg(F.count("*").alias("n"))


# Extensions: categories the engine offers beyond the operators it was asked to match.
@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_hours(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_one, event_id FROM events),
  s AS (SELECT user_id, ts, sum(new_one) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
  SELECT user_id, session::BIGINT AS session, count(*) AS n, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM s GROUP BY 1, 2""")
def ext_sessions(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events")
    fresh = F.when(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by)) < 30 * 60 * 1_000_000, 0).otherwise(1)
    s = e.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(by))
    seconds = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(seconds, 3).alias("seconds"))


@query("SELECT n_regionkey AS region, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def ext_rollup(spark, sf_dir):
    c = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
