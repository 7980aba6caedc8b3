"""SimHash near-duplicates: fingerprints joined by walking a binary trie against itself.

Fingerprints are cut into six blocks of bits. Two that differ in at most four bits agree in at least two whole blocks,
so for each of the 15 pairs of blocks the fingerprints that agree there form a bucket, and every link lies in some
bucket. Within buckets a binary trie (a sorted array of fingerprints, its nodes ranges) is joined with itself: node
pairs go down together, differing bits add up, and a pair is dropped once they exceed the budget. A pair of nodes that
already lie in one component has nothing to add and is dropped too, so a dense group of thousands of near copies costs
about its size and not its square; so that such groups are known early, neighbours in sorted and rotated order are
compared before the walk (an aid to pruning: each link it makes is within the budget, and the walk finds all others).
A bucket gives back links to its components' least fingerprints only, at most one per member.

Equal fingerprints are one node from the start (partial aggregation), so a group of copies, however large, is one row
here. A bucket with more than LARGE different fingerprints is not gathered: its members go to the 70 finer buckets of
four in eight blocks (32 bits), in which any two within the budget agree as well, so nothing is lost.

Nodes are fingerprints and not ids, so rows that share a doc_id link no texts but their own. The blocks are complete up
to a budget of four bits; a larger one is refused.

Defined results: null, empty and all-blank texts have fingerprint zero and are linked like any other; a text of fewer
than four words is one shingle; a component's id is the least doc_id in it (null if all of its rows lack one); rows that
repeat a doc_id each have the component of their own text; a null doc_id has a null component id. `keep_one` keeps exactly
one row of every component: that of the least doc_id (rows without one last), then of the least text hash; of equal rows one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_map, cut, spill_table, table
from storyloom.llm.graph import components

WORDS = 4
SEED = 42
BUDGET = 4
BLOCKS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))  # (shift, bits)
PAIRS = [(i, j) for i in range(len(BLOCKS)) for j in range(i + 1, len(BLOCKS))]
FINE = tuple((8 * k, 8) for k in range(8))
FOURS = list(combinations(range(8), 4))
LARGE = 1 << 20  # fingerprints; a larger bucket is split into finer ones
WIDE = 1 << 19  # node pairs expanded at a time


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles; unsigned."""
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: ASCII lower case and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    line, h = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(words, len(w)) - 1 :][:n] - 1).tolist()
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp as a signed long) of every whole text."""

    def run(blocks):
        for ids, texts in blocks:
            yield {"doc_id": ids, "fp": np.array([fingerprint(t, words) for t in texts], "<u8").view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _keys(fp: str, blocks: tuple, groups: list) -> F.Column:
    part = [F.shiftrightunsigned(F.col(fp), s).bitwiseAND(F.lit((1 << b) - 1).cast("long")) for s, b in blocks]

    def key(k: int, group: tuple):
        bits = part[group[0]]
        for i in group[1:]:
            bits = F.shiftleft(bits, blocks[i][1]).bitwiseOR(part[i])
        return F.lit(k << 40).cast("long").bitwiseOR(bits)

    return F.array(*[key(k, g) for k, g in enumerate(groups)])


def bucket_keys(fp: str = "fp"):
    """An array of the 15 keys of a fingerprint: which pair of blocks, and their bits."""
    return _keys(fp, BLOCKS, PAIRS)


def buckets(nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """(key, fp): every fingerprint in each of its buckets; those of too large buckets in finer ones."""
    keyed = nodes.select(F.explode(bucket_keys()).alias("key"), "fp")
    crowded = keyed.groupBy("key").count().where(F.col("count") > large).select("key")  # few: each stands for `large` rows
    fine = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    fine = fine.select(F.explode(_keys("fp", FINE, FOURS)).alias("key"), "fp").select((F.col("key") + F.lit(1 << 50)).alias("key"), "fp")
    return keyed.join(crowded, "key", "left_anti").unionByName(fine)


def _labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Least index reachable, for each of n nodes, over edges u-v and what `labels` has joined already."""
    labels = np.arange(n) if labels is None else labels
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def trie_self_join(run: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Component label (an index) of each fingerprint; `run` (bucket numbers) and within it `fp` (uint64) ascend."""
    n = len(fp)
    labels = np.arange(n)
    # Neighbours in sorted and rotated order first: cheap links that let the walk below drop most pairs of a dense group.
    for turn in (0, 16, 32, 48):
        turned = (fp << np.uint64(turn)) | (fp >> np.uint64(64 - turn)) if turn else fp
        order = np.lexsort((turned, run)) if turn else labels.copy()
        u, v = order[:-1], order[1:]
        near = (run[u] == run[v]) & (_distance(fp[u], fp[v]) <= budget)
        labels = _labels(n, u[near], v[near], labels)
    ones = np.zeros((64, n + 1), np.int32) if n < 1 << 16 else None

    def zeros_between(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of fp[lo:hi] have a 0 at `bit`."""
        if ones is None:
            count = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        else:
            count = ones[bit]
            if not count[-1]:
                np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), out=count[1:])
        return (hi - lo) - (count[hi] - count[lo])

    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    last = np.r_[first[1:], n]
    many = last - first > 1
    start = (first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int8))
    todo = [(63, start)]
    while todo:
        bit, (al, ah, bl, bh, errors) = todo.pop()
        if len(al) > WIDE:
            half = len(al) // 2
            todo += [(bit, tuple(x[half:] for x in (al, ah, bl, bh, errors))), (bit, tuple(x[:half] for x in (al, ah, bl, bh, errors)))]
            continue
        # Drop pairs whose members are in one component already.
        change = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
        one = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (labels[al] == labels[bl])
        al, ah, bl, bh, errors = (x[~one] for x in (al, ah, bl, bh, errors))
        if not len(al):
            continue
        # Two leaves: compare. (A node joined with itself that is one leaf is in one component, and gone.)
        leaf = (ah - al == 1) & (bh - bl == 1)
        u, v = al[leaf], bl[leaf]
        near = _distance(fp[u], fp[v]) <= budget
        if near.any():
            labels = _labels(n, u[near], v[near], labels)
        al, ah, bl, bh, errors = (x[~leaf] for x in (al, ah, bl, bh, errors))
        if not len(al) or bit < 0:
            continue
        am, bm = al + zeros_between(bit, al, ah), bl + zeros_between(bit, bl, bh)
        other = al != bl  # of a node with itself, (0, 1) stands for (1, 0) too
        e = errors
        children = [
            (al, am, bl, bm, e, None), (am, ah, bm, bh, e, None),
            (al, am, bm, bh, e + 1, None), (am, ah, bl, bm, e + 1, other),
        ]
        parts = []
        for cal, cah, cbl, cbh, ce, also in children:
            keep = (cal < cah) & (cbl < cbh) & (ce <= budget)
            keep = keep & also if also is not None else keep
            parts.append([x[keep] for x in (cal, cah, cbl, cbh, ce)])
        todo.append((bit - 1, tuple(np.concatenate(x) for x in zip(*parts))))
    return labels


def bucket_links(keyed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): links from each fingerprint to the least of its component within a bucket; `keyed` is (key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows of the key that may go on in the next batch

        def links(key, fp):
            if len(key) < 2:
                return None
            start = np.r_[True, key[1:] != key[:-1]]
            runs = np.cumsum(start)
            size = np.bincount(runs)[runs]
            some = size > 1
            if not some.any():
                return None
            runs, fp = runs[some], fp[some]
            v = fp[trie_self_join(runs, fp, budget)]
            off = fp != v
            return pa.RecordBatch.from_arrays([pa.array(fp[off].view(np.int64)), pa.array(v[off].view(np.int64))], ["u", "v"])

        def ready(parts):
            key, fp = (np.concatenate(x) for x in zip(*parts))
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, key))
            return key[order], fp[order]

        for b in batches:
            key, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(key):
                continue
            same = np.searchsorted(key, key[-1])  # keys ascend within the partition
            if same == 0 and held and held[-1][0][-1] == key[-1]:
                held.append((key, fp))
                continue
            if out := links(*ready([*held, (key[:same], fp[:same])])) if held or same else None:
                yield out
            held = [(key[same:], fp[same:])]
        if held and (out := links(*ready(held))):
            yield out

    return keyed.mapInArrow(run, "u long, v long")


def roots(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(node, root) of every fingerprint that is not its component's root; `nodes` holds each `fp` once."""
    if budget > BUDGET:
        raise ValueError(f"the blocks find all links of at most {BUDGET} bits, not of {budget}")
    keyed = buckets(nodes)
    keyed = keyed.repartition(max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key").sortWithinPartitions("key")
    return components(bucket_links(keyed, budget))


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`."""
    own = cut(fingerprints(docs, words))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = nodes.join(roots(nodes.select("fp"), budget), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root").select("fp", "least")
    out = own.join(named, "fp")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """`docs` without the near copies: one row of each component stays (see above which), with its columns as they were.

    Rows get a number when they are written beside their fingerprints, so a decision is about a row and not about an id."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("n"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["row", "n", "fp"])

    held = spill_table(rows.mapInArrow(run, rows.select("row", "n", F.lit(0).cast("long").alias("fp")).schema))
    doc, text = F.col("row.doc_id"), F.col("row.text")
    order = F.struct(doc.isNull().alias("a"), doc.alias("b"), F.xxhash64(text).alias("c"), F.col("n").alias("d"))
    nodes = held.groupBy("fp").agg(F.min(order).alias("first"))
    named = nodes.join(roots(nodes.select("fp"), budget), F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.d").alias("n"))
    return held.join(kept, "n", "left_semi").select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
