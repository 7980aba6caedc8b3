"""Repairs of stored rows as set-based steps: each takes tables and gives the rows to write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import vector as V
from storyloom.operators import queues as Q
from storyloom.operators import relevance as R
from storyloom.sources import pages as P


def gone_pages(extractions: DataFrame, topics_of_source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extractions (article_id, source_id, content_hash, status, error_detail) that failed with 404 or 410 are over:
    their rows as completed, and a rejected assessment for each topic of their source."""
    gone = extractions.where((F.col("status") == "retry") & F.col("error_detail").isin("HTTP 404", "HTTP 410"))
    done = gone.withColumn("status", F.lit("completed")).withColumn("error_code", F.lit("source_unavailable"))
    rejected = gone.join(topics_of_source, "source_id").select("article_id", "topic", "content_hash", F.lit("rejected").alias("decision"), F.lit("source_unavailable").alias("reason_code"), F.to_json(F.struct(F.col("error_detail").alias("http_error"))).alias("reason_detail"))
    return done, rejected


def direct_promotions(assessments: DataFrame, direct: DataFrame) -> DataFrame:
    """Assessments (article_id, topic, source_id, decision, reason_code) of a topic's own sources become relevant."""
    own = assessments.join(direct.select("topic", "source_id").distinct(), ["topic", "source_id"], "left_semi")
    return own.where("decision != 'relevant'").withColumn("decision", F.lit("relevant")).withColumn("reason_code", F.lit("direct_club_source"))


def other_sports(assessments: DataFrame, articles: DataFrame) -> DataFrame:
    """Reviews of articles (article_id, title, url) on another sport are rejected."""
    off = articles.where(R.is_other_sport(F.col("title"), F.col("url"))).select("article_id")
    found = assessments.where("decision = 'needs_review'").join(off, "article_id", "left_semi")
    return found.withColumn("decision", F.lit("rejected")).withColumn("reason_code", F.lit("obvious_non_football"))


def reconcile_status(articles: DataFrame, expected: DataFrame, assessments: DataFrame, extracted: DataFrame) -> DataFrame:
    """(article_id, status) to write: waiting articles (article_id, content_hash, source_id, status), extracted in their
    current revision, of which every topic of their source (source_id, topic) is assessed, and whose status differs."""
    waiting = articles.where(F.col("status").isin("raw", "phase_a_retry")).join(extracted.where("status = 'completed'").select("article_id", "content_hash"), ["article_id", "content_hash"], "left_semi")
    a = assessments.select("article_id", "topic", "content_hash", "decision", F.lit(1).alias("there"))
    j = waiting.join(expected, "source_id").join(a, ["article_id", "topic", "content_hash"], "left")
    count = lambda d: F.count_if(F.col("decision") == d)
    g = j.groupBy("article_id", F.col("status").alias("was")).agg(F.count_distinct("topic").alias("expected"), F.count_distinct(F.when(F.col("there") == 1, F.col("topic"))).alias("assessed"), Q.status_from_counts(count("relevant"), count("needs_review"), count("rejected")).alias("status"))
    return g.where("expected = assessed and status != was").select("article_id", "status")


def clean_texts(extractions: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns hold stored noise, cleaned by their source's rules; rows that stay the same are left out."""
    noisy = extractions.where(T.contains_any(T.NOISE, *[F.col(c) for c in columns]))
    cleaned = noisy.withColumns({f"__{c}": T.clean_editorial(P.decode_entities(F.col(c)), F.col("source_id")) for c in columns})
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return cleaned.where(changed).withColumns({c: F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def content_hash(title, excerpt, published):
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (title, excerpt, published)]), 256)


def normalize_entities(articles: DataFrame) -> DataFrame:
    """Articles (title, excerpt, published_at, content_hash) with stored entities decoded and hashed anew; unchanged ones
    are left out."""
    held = articles.where(T.contains_any(T.STORED_ENTITIES, F.col("title"), F.col("excerpt"), fold=True))
    fixed = held.withColumn("title", T.compact(P.decode_entities("title"))).withColumn("excerpt", T.compact(P.decode_entities("excerpt")))
    fixed = fixed.withColumn("__hash", content_hash(F.col("title"), F.col("excerpt"), F.col("published_at")))
    return fixed.where(~F.col("__hash").eqNullSafe(F.col("content_hash"))).withColumn("content_hash", F.col("__hash")).drop("__hash")


def embedding_plan(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events (event_id, representation_hash) with `action`: ready (embedded already), reuse (another event's vector has
    the same representation) or embed."""
    own = stored.select("event_id", "representation_hash", F.lit(1).alias("own")).distinct()
    any_ = stored.groupBy("representation_hash").agg(F.min("event_id").alias("reuse_of"))
    j = events.join(own, ["event_id", "representation_hash"], "left").join(any_, "representation_hash", "left")
    return j.withColumn("action", F.when(F.col("own") == 1, "ready").when(F.col("reuse_of").isNotNull(), "reuse").otherwise("embed")).drop("own")


def repair_vectors(stored: DataFrame, dimension: int) -> DataFrame:
    """Vectors kept as text (event_id, text) as arrays; what cannot be read has status failed."""
    parsed = stored.withColumn("embedding", V.parse_vector(F.col("text"), dimension))
    return parsed.withColumn("status", F.when(F.col("embedding").isNull(), "failed").otherwise("ready")).drop("text")
