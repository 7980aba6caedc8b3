"""Threshold sweeps, calibration samples, gates and bridge audits over scored pairs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTRE = 0.65
#: Upper bounds of the score bins of a calibration sample.
BINS = (0.64, 0.65, 0.675, 0.70, 0.725, 0.75)


def ratio(n: Column, of: Column, empty: float) -> Column:
    return F.when(of > 0, n / of).otherwise(F.lit(empty))


def threshold_metrics(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts and rates at each threshold; `pairs` is (same: boolean, hybrid). Pairs are counted once, in the
    interval between thresholds they fall into, and the counts are summed up along the handful of thresholds."""
    level = sum((F.col("hybrid") >= t).cast("int") for t in thresholds)
    return threshold_rates(pairs.groupBy(level.alias("level")).agg(F.count_if("same").alias("s"), F.count_if(~F.col("same")).alias("d")), thresholds)


def threshold_rates(counts: DataFrame, thresholds: list[float]) -> DataFrame:
    """The same from (level, s, d): how many pairs of either truth reach `level` of the thresholds and no more."""
    ts = sorted(thresholds)
    grid = counts.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "at int, threshold double")
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    over = F.col("level") >= F.col("at")
    joined = grid.join(F.broadcast(counts))  # a row per threshold on either side
    out = joined.groupBy("at", "threshold").agg(total("s", over).alias("tp"), total("d", over).alias("fp"), total("d", ~over).alias("tn"), total("s", ~over).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumn("precision", ratio(tp, tp + fp, 1.0)).withColumn("recall", ratio(tp, tp + fn, 1.0))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r, 0.0)).withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn, 0.0)).drop("at")


def zone_sweep(pairs: DataFrame, lows: tuple[int, int], highs: tuple[int, int], gap: int = 3, per: int = 200) -> DataFrame:
    """Two-threshold zones on a grid of integers over `per` (so no step drifts): merge at or above high, new below low."""
    level = F.least(F.greatest(F.floor(F.col("hybrid") * per + F.lit(1e-9)), F.lit(lows[0] - 1)), F.lit(highs[1]))
    return zone_rates(pairs.groupBy(level.cast("int").alias("level")).agg(F.count_if("same").alias("s"), F.count_if(~F.col("same")).alias("d")), lows, highs, gap)


def zone_rates(counts: DataFrame, lows: tuple[int, int], highs: tuple[int, int], gap: int = 3) -> DataFrame:
    """The same from (level, s, d): how many pairs of either truth are on each step of the grid."""
    zones = [(lo, hi) for lo in range(lows[0], lows[1] + 1) for hi in range(max(lo + gap, highs[0]), highs[1] + 1)]
    grid = counts.sparkSession.createDataFrame(zones, "low int, high int")
    total = lambda what, cond: F.coalesce(F.sum(F.when(cond, what)), F.lit(0))
    merge, new = F.col("level") >= F.col("high"), F.col("level") < F.col("low")
    n = F.col("s") + F.col("d")
    out = grid.join(F.broadcast(counts)).groupBy("low", "high").agg(  # at most a few hundred levels
        total(n, merge).alias("merged"), total(F.col("s"), merge).alias("merged_right"), total(n, new).alias("fresh"), total(F.col("d"), new).alias("fresh_right"), F.sum(n).alias("n")
    )
    out = out.withColumn("merge_precision", ratio(F.col("merged_right"), F.col("merged"), 1.0)).withColumn("new_precision", ratio(F.col("fresh_right"), F.col("fresh"), 1.0))
    out = out.withColumn("coverage", ratio(F.col("merged") + F.col("fresh"), F.col("n"), 0.0))
    safe = (F.col("merge_precision") >= 0.97) & (F.col("new_precision") >= 0.97)
    return out.withColumn("safe", safe).withColumn("support_ok", (F.col("merged") >= 5) & (F.col("fresh") >= 5))


def score_bin(x: Column) -> Column:
    out = F.lit(len(BINS))
    for i, b in reversed(list(enumerate(BINS))):
        out = F.when(x < b, i).otherwise(out)
    return out


def stable_rank(pair_id: Column) -> Column:
    return F.substring(F.sha2(pair_id, 256), 1, 12)


def labelled_ids(sample: DataFrame) -> DataFrame:
    order = Window.orderBy(F.desc("hybrid"), "pair_id")  # a sample, so a few hundred rows
    return sample.withColumn("review_id", F.format_string("M%03d", F.row_number().over(order)))


def stratified_sample(pairs: DataFrame, size: int = 120) -> DataFrame:
    """(review_id, pair_id, hybrid, bin): as many of each bin by stable rank, the rest nearest to the centre. Ranks are
    counted by their first digits, so only rows that may be taken are put in order."""
    each = size // (len(BINS) + 1)
    p = pairs.withColumn("bin", score_bin(F.col("hybrid"))).withColumn("rank", stable_rank(F.col("pair_id")))
    head = F.substring("rank", 1, 4)
    heads = p.groupBy("bin", head.alias("head")).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("bin").orderBy("head")) - F.col("c")  # 65 536 heads at most
    cut = heads.withColumn("before", before).where(F.col("before") < each).groupBy("bin").agg(F.max("head").alias("cut"))
    early = p.join(F.broadcast(cut), "bin").where(head <= F.col("cut")).drop("cut")
    first = early.withColumn("n", F.row_number().over(Window.partitionBy("bin").orderBy("rank", "pair_id"))).where(F.col("n") <= each).drop("n")
    near = [F.abs(F.col("hybrid") - CENTRE), F.col("rank"), F.col("pair_id")]
    rest = p.orderBy(*near).limit(2 * size).join(first.select("pair_id"), "pair_id", "left_anti")  # at most `size` are taken already
    room = F.lit(size) - first.agg(F.count("*").alias("n")).scalar()
    rest = rest.withColumn("n", F.row_number().over(Window.orderBy(*near))).where(F.col("n") <= room).drop("n")
    return labelled_ids(first.unionByName(rest.select(first.columns))).select("review_id", "pair_id", "hybrid", "bin")


_CELL = 5000


def cell_places(pairs: DataFrame) -> DataFrame:
    """(cell, n, before, total): how many pairs each narrow cell of scores holds, how many come before it, and all."""
    sizes = pairs.groupBy(F.floor(F.col("hybrid") * _CELL).alias("cell")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("cell"))  # a row per cell
    return sizes.withColumn("before", upto - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))


def with_rank(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs of some `cells` with their `place` among all, in order of (hybrid, pair_id), from 0."""
    within = F.row_number().over(Window.partitionBy("cell").orderBy("hybrid", "pair_id"))
    p = pairs.withColumn("cell", F.floor(F.col("hybrid") * _CELL)).join(F.broadcast(cells.select("cell", "before")), "cell")  # a few hundred cells
    return p.withColumn("place", F.col("before") + within - 1).drop("cell", "before")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], keys: list[str] = (), per: float = 5000, nearest: bool = False) -> DataFrame:
    """(keys, n, a column per share): quantiles of `value` by rank, interpolated between two ranks or, with `nearest`, at
    the nearest one (halves up). Rows are counted in cells of 1 / `per`, and only those of cells that hold a wanted rank
    are put in order, equal values as one, so no task sees all values of a key, however many rows it has."""
    cell = F.floor(F.col(value) * per).alias("cell")
    there = rows.where(F.col(value).isNotNull())
    cells = there.groupBy(*keys, cell).agg(F.count("*").alias("c"))
    along = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.select(*keys, "cell", (F.sum("c").over(along) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"), "c")
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ends = [w for p in at.values() for w in ([F.floor(p + 0.5)] if nearest else [F.floor(p), F.ceil(p)])]
    hit = functools.reduce(Column.__or__, [(w >= F.col("before")) & (w < F.col("before") + F.col("c")) for w in ends])
    cells = cells.where(hit).drop("c")
    some = there.select(*keys, cell, F.col(value).alias("v")).join(cells, [*keys, "cell"])
    counts = some.groupBy(*keys, "cell", "before", "n", "v").agg(F.count("*").alias("c"))
    placed = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "cell").orderBy("v")))
    start, end = F.col("before") + F.col("upto") - F.col("c"), F.col("before") + F.col("upto")
    inside = lambda p: F.max(F.when((p >= start) & (p < end), F.col("v")))
    parts = {}
    for name, place in at.items():
        whole = F.floor(place + 0.5) if nearest else F.floor(place)
        parts |= {f"lo_{name}": inside(whole), f"hi_{name}": inside(whole if nearest else F.ceil(place)), f"at_{name}": F.max(place - F.floor(place))}
    got = placed.groupBy(*keys, "n").agg(*[c.alias(k) for k, c in parts.items()])
    between = lambda k: F.col(f"lo_{k}") + (F.col(f"hi_{k}") - F.col(f"lo_{k}")) * F.col(f"at_{k}")
    return got.select(*keys, "n", *[(F.col(f"lo_{k}") if nearest else between(k)).alias(k) for k in shares])


def spectrum_sample(pairs: DataFrame, size: int = 150) -> DataFrame:
    """(review_id, pair_id, hybrid, bucket, decile): two thirds evenly spaced over the ranks, one third nearest to the
    centre. Wanted ranks do not collide as there are at least `size` pairs. Only pairs of score cells that hold a wanted
    rank or one of the `size` pairs nearest to the centre are put in order."""
    broad = round(size * 2 / 3)
    cells = cell_places(pairs)
    steps = cells.select("cell", "before", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(broad - 1))).alias("i"))
    place = F.floor(F.col("i") * (F.col("total") - 1) / (broad - 1) + 0.5).cast("bigint")
    grid = steps.withColumn("place", place).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))).select("cell", "before", "total", "place").distinct()
    near = [F.abs(F.col("hybrid") - CENTRE), stable_rank(F.col("pair_id")), F.col("pair_id")]
    close = pairs.orderBy(*near).limit(size)
    some = cells.join(close.select(F.floor(F.col("hybrid") * _CELL).alias("cell")).union(grid.select("cell")).distinct(), "cell", "left_semi")
    ranked = with_rank(pairs, some)
    n = cells.agg(F.sum("n").alias("n")).scalar()
    spread = ranked.join(F.broadcast(grid.select("place")), "place", "left_semi").withColumn("bucket", F.lit("spectrum"))
    focus = ranked.join(F.broadcast(grid.select("place")), "place", "left_anti").orderBy(*near).limit(size - broad).withColumn("bucket", F.lit("decision_focus"))
    out = spread.unionByName(focus.select(spread.columns)).withColumn("decile", F.least(F.lit(9), F.floor(F.col("place") * 10 / n)).cast("int"))
    return labelled_ids(out).select("review_id", "pair_id", "hybrid", "bucket", "decile")


def gap_class(direct: Column, compatible: Column, label: Column, low: float, high: float) -> Column:
    """How the two ends of a triad stand to one another."""
    return (
        F.when(label == "exclude", "excluded").when(label == "same", "labeled_same").when(label == "different", "ground_truth_different")
        .when(direct.isNull(), "not_shortlisted").when(~compatible, "family_block").when(direct < low, "below_low").when(direct < high, "ambiguous_gap").otherwise("high_connected")
    )


SUSPICIOUS = ("ground_truth_different", "not_shortlisted", "family_block", "below_low", "ambiguous_gap")
#: What a gap weighs.
WEIGHTS = {"ground_truth_different": 1000, "family_block": 220, "below_low": 150, "ambiguous_gap": 80, "not_shortlisted": 40}


def severity(gap: Column, endpoint: Column, left: Column, right: Column, high: float) -> Column:
    base = F.lit(0.0)
    for name, w in WEIGHTS.items():
        base = F.when(gap == name, float(w)).otherwise(base)
    return base + F.coalesce(F.greatest(F.lit(0.0), F.lit(high) - endpoint) * 100, F.lit(0.0)) + F.least(left, right) * 10


def triads(strong: DataFrame) -> DataFrame:
    """(center, x, y, hx, hy): two of the edges (a, b, hybrid) that meet in a center, their outer ends x below y."""
    edges = strong.select(F.col("a").alias("center"), F.col("b").alias("end"), "hybrid").unionByName(strong.select(F.col("b").alias("center"), F.col("a").alias("end"), "hybrid"))
    left = edges.select("center", F.col("end").alias("x"), F.col("hybrid").alias("hx"))
    right = edges.select("center", F.col("end").alias("y"), F.col("hybrid").alias("hy"))
    return left.join(right, "center").where("x < y")


def suspicious(triads: DataFrame, pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Those of the triads whose outer ends do not hold together; `pairs` (a, b, hybrid, compatible, label) holds at least
    every scored pair of such ends."""
    direct = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("hybrid").alias("direct"), "compatible", "label")
    t = triads.join(direct, ["x", "y"], "left")
    t = t.withColumn("gap", gap_class(F.col("direct"), F.coalesce("compatible", F.lit(True)), F.col("label"), low, high)).where(F.col("gap").isin(*SUSPICIOUS))
    return t.withColumn("severity", severity(F.col("gap"), F.col("direct"), F.col("hx"), F.col("hy"), high))


def bridge_triads(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Suspicious triads: two strong edges that meet, whose outer ends do not hold together. `pairs` is (a, b, hybrid,
    compatible, label)."""
    return suspicious(triads(pairs.where((F.col("hybrid") >= high) & F.col("compatible"))), pairs, low, high)


def bridge_candidates(triads: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("gap") == g).alias(g) for g in WEIGHTS]
    out = triads.groupBy("center").agg(F.count("*").alias("triads"), *counts, F.max("severity").alias("max_severity"))
    risk = F.when(F.col("ground_truth_different") > 0, "confirmed").when((F.col("family_block") > 0) | (F.col("below_low") > 0), "high").when(F.col("ambiguous_gap") > 0, "medium").otherwise("review")
    return out.withColumn("risk", risk)


def cluster_evaluation(assigned: DataFrame, labels: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row (per `keys` of `assigned`): recall of same pairs, separation of different ones, precision of joint clusters, accuracy. `assigned` is
    (event_id, story_id), `labels` is (a, b, same)."""
    one = lambda side: assigned.select(*keys, F.col("event_id").alias(side), F.col("story_id").alias(f"story_{side}"))
    return cluster_rates(labels.join(one("a"), "a").join(one("b"), ["b", *keys]).withColumn("together", F.col("story_a") == F.col("story_b")), keys)


def cluster_rates(j: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The same from pairs that hold both the truth and the outcome: (same, together)."""
    c = j.groupBy(*keys).agg(*[F.count_if(cond).alias(n) for n, cond in {
        "same": F.col("same"), "same_kept": F.col("same") & F.col("together"), "different": ~F.col("same"),
        "different_kept": ~F.col("same") & ~F.col("together"), "together": F.col("together")}.items()], F.count("*").alias("n"))
    return c.select(
        *keys, "n", ratio(F.col("same_kept"), F.col("same"), 1.0).alias("same_recall"), ratio(F.col("different_kept"), F.col("different"), 1.0).alias("different_separation"),
        ratio(F.col("same_kept"), F.col("together"), 1.0).alias("co_cluster_precision"), ratio(F.col("same_kept") + F.col("different_kept"), F.col("n"), 0.0).alias("pair_accuracy"),
    )
