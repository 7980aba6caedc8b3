"""Best-fit-decreasing packing of token sequences, over all pieces at once.

Best fit decreasing looks at pieces by length only, and lengths are few (1 to the capacity). So the plan is made once,
for the whole table, from the count of pieces of each length: lengths go down, and for each the tightest open bins that
it fits are found through a segment tree over remaining capacities (which capacities have open bins), in logarithmic
time. A bin just filled is tighter than it was, so it takes pieces of the same length until none fits any more, and only
then does the next bin get one; bins of one remaining capacity are alike, so a whole run of them is filled in one step.
The plan is a table of runs (length, rank from, rank to, first bin, offset, pieces a bin), and each piece finds its place
by its rank among the pieces of its length. The outcome is that of placing every piece of the table, longest first, one
by one.

What meets in one place is the count per length (at most the capacity's number of rows) and the plan. Ranks come from
per-task counts and a running sum per length over tasks, so no length's pieces are ever gathered.

Defined results: a null or empty text is its end id alone (one piece); documents longer than the capacity are cut into
pieces, the last may be shorter; an empty table packs to no rows; equal lengths are ranked by task, then by the order
read there; repeated doc_ids are packed like any other rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_map, spill_table, table
from storyloom.llm.tokens import encoder, vocabulary_path

CAPACITY = 4096
END_ID = 1
PLAN_ROWS = 1_000_000  # runs sent to the workers at a time


class OpenCapacities:
    """A segment tree over 0..capacity: which remaining capacities have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, r: int, there: bool) -> None:
        i = r + self.leaves
        self.any[i] = there
        i >>= 1
        while i:
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least r >= need that has open bins."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, from rank, to rank, first bin, offset, pieces a bin) and the number of bins, for `counts` pieces of
    each length."""
    tree, open_bins = OpenCapacities(capacity), {}
    plan, bins = [], 0

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            if not open_bins.get(r):
                tree.set(r, True)
            runs = open_bins.setdefault(r, [])
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1][1] += n
            else:
                runs.append([first, n])

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            per = (capacity if r is None else r) // length
            if r is None:  # new bins for all that is left
                first, n = bins, -(-left // per)
                r, bins = capacity, bins + n
            else:
                runs = open_bins[r]
                first, n = runs.pop()
                if n * per > left:  # the run's other bins stay as they are
                    n, whole = -(-left // per), n
                    if whole > n:
                        runs.append([first + n, whole - n])
                if not runs:
                    tree.set(r, False)
            take = min(left, n * per)
            full, rest = divmod(take, per)
            if full:
                plan.append((length, rank, rank + full * per, first, capacity - r, per))
                put(r - per * length, first, full)
            if rest:  # the last bin, with room for more of this length
                plan.append((length, rank + full * per, rank + take, first + full, capacity - r, rest))
                put(r - rest * length, first + full, 1)
            rank, left = rank + take, left - take
    return plan, bins


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, with the task that made each and its rank there among pieces of its length."""

    def run(blocks):
        from pyspark import TaskContext

        task, enc, seen = TaskContext.get().partitionId(), encoder(path), {}
        end = np.array([end_id], "<u4").tobytes()
        for ids, texts in blocks:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")}
            for i, raw in zip(ids, enc.block(texts)):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    for name, v in zip(out, (i, k, at // 4, n, zlib.crc32(part), task, rank)):
                        out[name].append(v)
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, 256)


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`made` (from `pieces`, kept) with sequence_id and offset, without task and rank."""
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_decreasing(counts, capacity)
    ranked = made.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")
    # The plan goes out in slices of whole lengths; one slice unless the plan is very large.
    out = None
    for part in _slices(plan):
        placed = _place(ranked.where(F.col("length").between(part[-1][0], part[0][0])), part)
        out = placed if out is None else out.unionByName(placed)
    return out if out is not None else _place(ranked, [])


def _slices(plan: list) -> list[list]:
    out: list[list] = []
    for row in plan:
        if not out or len(out[-1]) >= PLAN_ROWS and out[-1][-1][0] != row[0]:
            out.append([])
        out[-1].append(row)
    return out


def _place(ranked: DataFrame, plan: list) -> DataFrame:
    """The plan's rows are by falling length, then rising rank: a piece's row is found by binary search."""
    table_ = np.array(plan, np.int64).reshape(-1, 6)
    sent = ranked.sparkSession.sparkContext.broadcast(table_)

    def run(batches):
        import pyarrow as pa

        plan_ = sent.value
        key = -plan_[:, 0] * (1 << 44) + plan_[:, 1]
        for b in batches:
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank")}
            at = np.searchsorted(key, -cols["length"] * (1 << 44) + cols["rank"], side="right") - 1
            row = plan_[at] if len(plan_) else plan_[:0]
            bins, within = np.divmod(cols["rank"] - row[:, 1], row[:, 5])
            offset = row[:, 4] + within * cols["length"]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(row[:, 3] + bins), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(spill_table(pieces(docs, path, capacity, end_id)), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
