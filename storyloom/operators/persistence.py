"""Selecting articles for extraction and keeping what it gave, so that a repeated run writes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["article_id", "content_hash", "version"]


def waiting(enriched: DataFrame, articles: DataFrame, assessed: DataFrame, ledger: DataFrame, version: str, now: Column, hours: int = 72, most: int = 12) -> DataFrame:
    """Articles to extract, oldest first: enriched (article_id, source_hash, content_hash, text, status, updated_at) in the
    article's current revision (article_id, source_hash) within `hours`, relevant to some topic (article_id, source_hash,
    decision), and with no ledger row (article_id, content_hash, version, status, until) for this content that is done,
    failed, or still holds or waits at `now`. The ledger's states are sorted out before the anti join."""
    fresh = enriched.where((F.col("status") == "completed") & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.col("updated_at") >= now - F.make_dt_interval(hours=F.lit(hours))))
    current = fresh.join(articles.select("article_id", "source_hash"), ["article_id", "source_hash"], "left_semi")
    wanted = current.join(assessed.where("decision = 'relevant'"), ["article_id", "source_hash"], "left_semi")
    held = F.col("status").isin("completed", "failed") | (F.col("status").isin("processing", "retry") & (F.col("until") > now))
    blocked = ledger.where((F.col("version") == version) & held).select("article_id", "content_hash")
    return wanted.join(blocked, ["article_id", "content_hash"], "left_anti").orderBy("updated_at", "article_id").limit(most)


def persist_plan(produced: DataFrame, stored: DataFrame, compared: list[str]) -> DataFrame:
    """What to do with each event (article_id, event_id, ...) of the articles extracted: insert, refresh (a compared column
    differs), keep, or supersede (stored, no longer produced)."""
    old = stored.where("status = 'active'").select("article_id", "event_id", *[F.col(c).alias(f"__{c}") for c in compared], F.lit(1).alias("__old"))
    new = produced.select("article_id", "event_id", *compared, F.lit(1).alias("__new"))
    j = new.join(old, ["article_id", "event_id"], "full")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "supersede").when(same, "keep").otherwise("refresh")
    return j.select("article_id", "event_id", action.alias("action"))


def ledger_rows(articles: DataFrame, produced: DataFrame, version: str) -> DataFrame:
    """One ledger row per article extracted, those that gave no event included."""
    n = produced.groupBy("article_id").agg(F.count("*").alias("events"))
    return articles.join(n, "article_id", "left").select("article_id", "content_hash", F.lit(version).alias("version"), F.lit("completed").alias("status"), F.coalesce("events", F.lit(0)).alias("events"))


def topic_links(events: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (event_id, topic) and names that several topics share; from (event_id, clubs) and (topic, alias), both in
    normal form."""
    named = events.select("event_id", F.explode("clubs").alias("alias"))
    hits = named.join(dictionary.select("alias", "topic").distinct(), "alias").groupBy("event_id", "alias").agg(F.count_distinct("topic").alias("n"), F.min("topic").alias("topic"))
    return hits.where("n = 1").select("event_id", "topic").distinct(), hits.where("n > 1").select("event_id", "alias").distinct()


def topic_context(topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """(topic, name, aliases) with the aliases in order; a topic without any keeps an empty list."""
    by = aliases.groupBy("topic").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return topics.join(by, "topic", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def merge_topics(previews: DataFrame) -> DataFrame:
    """One row per event found under several topics, with all of them."""
    return previews.groupBy("event_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"))


def given(df: DataFrame, **equal) -> DataFrame:
    """Filters of the parameters that are set."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value) if value is not None else df
    return df
