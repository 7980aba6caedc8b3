"""Work queues and change-detecting writes as DataFrame steps.

Status lives in tables; a step reads a snapshot and gives back the rows to write. A micro-batch has one writer; where jobs
outlive their batch, `claim` leases them to a holder and `settle` takes results from that holder only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under `order`; ties must be broken by the caller's last ordering column."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def latest_value(df: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """Like `latest` for a unique descending `by`, by aggregation that combines before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(by, *columns), by).alias("__b"))
    return best.select(*keys, "__b.*")


def with_rank(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, with their rank and how many the key has in all (`qualified_count`)."""
    counted = df.withColumn("qualified_count", F.count("*").over(Window.partitionBy(*keys)))
    ranked = counted.withColumn("member_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("member_rank") <= most)


def upsert_plan(current: DataFrame, incoming: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """`incoming` with `action`: insert (key not there), update (fingerprint differs, nulls compared safely) or unchanged."""
    old = current.select(*keys, F.col(fingerprint).alias("__old"), F.lit(1).alias("__there"))
    joined = incoming.join(old, keys, "left")
    action = F.when(F.col("__there").isNull(), "insert").when(F.col(fingerprint).eqNullSafe(F.col("__old")), "unchanged").otherwise("update")
    return joined.withColumn("action", action).drop("__old", "__there")


def apply_upsert(current: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the plan: changed and new rows from the plan, the rest as it was."""
    moved = planned.where("action != 'unchanged'").drop("action")
    return current.join(moved.select(*keys), keys, "left_anti").unionByName(moved.select(current.columns))


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `incoming`, once per key, whose key is not there yet."""
    return incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def superseded(stored: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the latest run no longer produced."""
    return stored.join(produced.select(*keys).distinct(), keys, "left_anti")


def next_state(attempts: Column, failed: Column, most: int) -> Column:
    """Status after an attempt: done, to be tried again, or failed for good after `most` attempts."""
    return F.when(~failed, "done").when(attempts + 1 >= most, "failed").otherwise("retry")


def due(status: Column, next_retry_at: Column, now: Column) -> Column:
    return (status == "pending") | ((status == "retry") & (next_retry_at.isNull() | (next_retry_at <= now)))


def abandon_stale(runs: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Runs that have been going for longer than `hours` are marked as abandoned."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(hours=F.lit(hours)))
    return runs.withColumn("status", F.when(stale, "abandoned").otherwise(F.col("status")))


def purge(parents: DataFrame, children: list[tuple[DataFrame, str]], key: str, doomed: Column) -> list[DataFrame]:
    """Parents without the doomed ones, and each child table without the rows that refer to those."""
    gone = parents.where(doomed).select(F.col(key).alias("__gone"))
    kept = parents.where(~F.coalesce(doomed, F.lit(False)))
    return [kept, *[c.join(gone, c[ref] == F.col("__gone"), "left_anti") for c, ref in children]]


def status_from_counts(relevant: Column, review: Column, rejected: Column) -> Column:
    return F.when(relevant > 0, "phase_a_ready").when(review > 0, "phase_a_review").when(rejected > 0, "phase_a_rejected").otherwise("phase_a_processed")


def coarse_status(retry: Column, failed: Column, ready: Column, review: Column, rejected: Column) -> Column:
    return F.when((retry > 0) | (failed > 0), "phase_a_retry").otherwise(status_from_counts(ready, review, rejected))


def claim(jobs: DataFrame, now: Column, holder: str, seconds: int, most: int, order: list[str]) -> DataFrame:
    """The first `most` jobs that are due, or whose lease ran out, as they are after `holder` took them: (…, status,
    attempts, holder, lease_until), one attempt more each."""
    free = due(F.col("status"), F.col("next_retry_at"), now) | ((F.col("status") == "processing") & (F.col("lease_until") <= now))
    taken = jobs.where(free).orderBy(*order).limit(most)
    return taken.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "holder": F.lit(holder), "lease_until": now + F.make_dt_interval(secs=F.lit(seconds))})


def settle(jobs: DataFrame, results: DataFrame, key: str, now: Column, most: int, wait: int) -> DataFrame:
    """`jobs` after `results` (key, by, failed) of those who held them: done, to be tried again after `wait` seconds, or
    failed for good after `most` attempts. A result of anyone but the job's holder, or past its lease, changes nothing."""
    r = results.select(F.col(key).alias("__key"), F.col("by").alias("__by"), F.col("failed").alias("__failed"))
    j = jobs.join(r, F.col(key) == F.col("__key"), "left")
    held = F.coalesce((F.col("status") == "processing") & (F.col("holder") == F.col("__by")) & (F.col("lease_until") > now), F.lit(False))
    j, holds = j.withColumn("__holds", held), F.col("__holds")
    state = next_state(F.col("attempts") - 1, F.col("__failed"), most)
    again = F.when(holds & (state == "retry"), now + F.make_dt_interval(secs=F.lit(wait))).when(~holds, F.col("next_retry_at"))
    out = j.withColumn("next_retry_at", again).withColumn("status", F.when(holds, state).otherwise(F.col("status")))
    freed = {c: F.when(~holds, F.col(c)) for c in ("holder", "lease_until")}
    return out.withColumns(freed).drop("__key", "__by", "__failed", "__holds")


def paced(claimed: DataFrame, order: list[str], now: Column, seconds: int) -> DataFrame:
    """Claimed jobs (a batch of bounded size) with `start_at`: one every `seconds`, in order."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return claimed.withColumn("start_at", now + F.make_dt_interval(secs=(place * seconds).cast("decimal(18,6)")))
