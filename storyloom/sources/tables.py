"""The engine's tables, and the driver's tables under their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are taken as UTC (the session's zone)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df`, dealt out by a key of its own for each row, for work that is all computing. How finely a file can be read is up
    to its row groups (a gigabyte may be one) and not to its splits, so the number of splits says nothing."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the title up to the first full stop, the 200 characters after it as excerpt, and a date
    that goes on by an hour per document."""
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    stop = F.instr("text", ".")
    title = F.when(stop > 0, F.substring("text", F.lit(1), stop - 1)).otherwise(F.col("text"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("language"),
        title.alias("title"),
        F.when(stop > 0, F.substring("text", stop + 1, F.lit(200))).otherwise(F.lit("")).alias("excerpt"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("published_at"),  # from 2024-01-01 on
    )


ARTICLES_SQL = """art AS (
  SELECT doc_id AS id, source AS source_id, lang AS language,
         CASE WHEN instr(text, '.') > 0 THEN substr(text, 1, instr(text, '.') - 1) ELSE text END AS title,
         CASE WHEN instr(text, '.') > 0 THEN substr(text, instr(text, '.') + 1, 200) ELSE '' END AS excerpt,
         text AS content, epoch(TIMESTAMP '2024-01-01') + doc_id * 3600 AS published_s
  FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extracted candidates: a family, a person, a club, a salient token, a date."""
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("family"),
        F.col("user_id").alias("person"),
        F.concat(F.lit("club"), (F.col("user_id") % 7).cast("string")).alias("club"),
        F.concat(F.lit("tok"), F.get_json_object("props", "$.k")).alias("salient"),
        "ts",
        "value",
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, event_type AS family, user_id AS person, 'club' || (user_id % 7) AS club,
         'tok' || json_extract_string(props, '$.k') AS salient, ts, value FROM events)"""


#: Families that the event types stand for.
FAMILY_OF = {"signup": "transfer", "view": "contract", "click": "match", "purchase": "discipline"}


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are matched: two to an article, a known or unknown family, people, one or two clubs, now and then a
    relation to a club, and lexical tokens."""
    return matched(load(spark, sf_dir, "events"))


def matched(e: DataFrame, *others: str) -> DataFrame:
    """Rows of the events table as `match_events` gives them, with `others` of their columns."""
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    family = F.coalesce(F.create_map(*[F.lit(x) for p in FAMILY_OF.items() for x in p])[F.col("event_type")], F.lit("unknown"))
    name = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    none = F.array().cast("array<string>")
    return e.select(
        "event_id", F.floor(F.col("event_id") / 2).alias("article"), family.alias("family"), "ts", F.array(name("u", F.col("user_id"))).alias("people"),
        F.array_distinct(F.array(name("club", F.col("user_id") % 23), name("club", F.col("k") % 29))).alias("clubs"),
        F.when(F.col("value") > 60, F.array(name("club", F.col("k") % 31))).otherwise(none).alias("relations"),
        F.array(name("tok", F.col("k")), name("tak", F.col("k") % 50), name("tek", F.col("event_id") % 37), name("tik", F.col("event_id") % 74)).alias("tokens"),
        *others,
    )


MATCH_SQL = """me AS (
  SELECT event_id, event_id // 2 AS article, CASE event_type WHEN 'signup' THEN 'transfer' WHEN 'view' THEN 'contract' WHEN 'click' THEN 'match' WHEN 'purchase' THEN 'discipline' ELSE 'unknown' END AS family, ts,
    ['u' || user_id] AS people, list_distinct(['club' || (user_id % 23), 'club' || (k % 29)]) AS clubs, CASE WHEN value > 60 THEN ['club' || (k % 31)] ELSE [] END AS relations,
    ['tok' || k, 'tak' || (k % 50), 'tek' || (event_id % 37), 'tik' || (event_id % 74)] AS tokens
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""
