"""Token-id archives: an adaptive context-mixing range coder over independent blocks.

Coding. A block of at most BLOCK ids is coded by itself: its models start afresh, so any block can be read alone, and a
damaged one spoils no other (each has a CRC-32 of its ids). At each place three orders predict the id. Order 2 names the
id that followed the last two ids before, order 1 the one that followed the last id. Order 0 is a distribution over the
ids of the block so far, whatever came before them: an id's share falls with the distance to where it last stood, in four
depths whose shares are learnt, with ids that are new to the block as a fifth. Which prediction holds (order 2, order 1,
a depth of order 0, new) is one of seven symbols. Its probability mixes two adaptive distributions, one seeing how far
the orders agree and what was right last, the other the last id, with a weight that moves towards whichever gave the
symbol more. The symbol's share, cut into equal parts for the place within the depth (or the new id's bits), drives a
range coder with 48-bit state; carries are added up when a block ends. All arithmetic is on integers (divisions go
through doubles that hold them exactly), so every machine decodes alike. Blocks are coded side by side, one step for all
of them at a time (numpy).

Files. An archive is a Parquet table with a row per shard (the documents of one range of ids, in ascending order): the
shard's number, its documents' ids and lengths, and its blocks in one binary value. Spark writes and reads it, so it
lives wherever the cluster's tables do.

Defined results: a null or empty text is its end id alone; equal doc_ids stand side by side, ordered by text; rows with
a null doc_id come first; an empty table is an archive without rows; a damaged block raises an error.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_map, shared_dir, table
from storyloom.llm.tokens import encoder, vocabulary_path

MAGIC = b"SLA2"
BLOCK = 2048
LANES = 3072
END_ID = 2
NEW = 6  # symbols: order 2, order 1, depths 0 to 3 of order 0, new
DEPTHS = np.array([1, 17, 81, 337])  # least distance of each depth of order 0
DEPTH_BITS = np.array([4, 6, 8, 11])
SLOT_BITS = 8
SHARES = 12  # bits of a symbol's share
PARTS = 16  # bits of what a share is cut into
_TOTAL = SHARES + PARTS
_LEAST, _LOW = 1 << 32, (1 << 32) - 1

# By symbol: bits of its value, least distance (0: none), what the next step remembers of it.
_BITS = np.array([0, 0, *DEPTH_BITS, 16])
_BASE = np.array([0, 0, *DEPTHS, 0])
_SYMBOL = np.searchsorted(DEPTHS, np.arange(BLOCK), side="right").astype(np.uint8) + 1  # by distance
_SYMBOL[0] = NEW
_LAST = np.array([0, 1, 2, 2, 2, 2, 3], np.uint8)
# Distributions are held as where each symbol's share starts, and its end; every symbol has one part in 4096 for good.
_FULL = (1 << SHARES) - 7
_GOAL = np.where(np.arange(8) <= np.arange(7)[:, None], 0, _FULL).astype(np.int16).view(np.complex128).ravel()
_FIRST = (np.cumsum([0, 2, 2, 3, 4, 7, 10, 28]) * _FULL // 56).astype(np.int16)
_EIGHTHS = np.repeat(np.arange(9, dtype=np.int16), 8).view(np.complex128)  # a weight, eight times over
_WEIGHT = np.clip(np.repeat(np.arange(9), 2) + np.tile([-1, 1], 9), 1, 7).astype(np.uint8)  # of weight * 2 + (first was better)


class Models:
    """The state of all lanes' models at one place of their blocks. A distribution is eight 16-bit numbers, moved about
    as one 16-byte value."""

    def __init__(self, lanes: int, length: int):
        at = np.arange(lanes)
        self.lanes, self.flat = lanes, np.zeros(length * lanes, np.int32)  # ids by place, then lane
        self.slots1, self.slots2 = np.full(lanes << SLOT_BITS, -1, np.int32), np.full(lanes << SLOT_BITS, -1, np.int32)
        self.mixed1, self.mixed2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # of the last id and the one before
        self.row_b = at * 32
        self.agree, self.after = np.tile(_FIRST, lanes * 32).view(np.complex128), np.tile(_FIRST, lanes * 32).view(np.complex128)
        self.at, self.at_slot, self.at_row, self.at_pick = at, at << SLOT_BITS, at * 32, at * 8
        self.weight, self.last = np.full(lanes, 4, np.uint8), np.full(lanes, 3, np.uint8)
        self.stairs = np.tile(np.arange(8, dtype=np.int16), lanes)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of order 2 and 1 (-1: none) for the first n lanes; leaves in `mix` where the symbols' shares start."""
        mixed1, shift = self.mixed1[:n], np.uint32(32 - SLOT_BITS)
        self.h1 = (mixed1 >> shift) + self.at_slot[:n]
        self.h2 = ((mixed1 ^ self.mixed2[:n]) >> shift) + self.at_slot[:n]
        guess1, guess2 = self.slots1[self.h1], self.slots2[self.h2]
        kind = (guess1 >= 0).view(np.uint8) << 2
        kind |= (guess2 >= 0).view(np.uint8) << 3
        kind |= (guess1 == guess2).view(np.uint8) << 4
        kind |= self.last[:n]
        self.row_a = self.at_row[:n] + kind
        self.a, self.b = self.agree[self.row_a].view(np.int16), self.after[self.row_b[:n]].view(np.int16)
        self.mix = self.a - self.b
        self.mix *= _EIGHTHS[self.weight[:n]].view(np.int16)  # at most 8 * 4096
        self.mix >>= 3
        self.mix += self.b
        self.mix += self.stairs[: 8 * n]
        return guess2, guess1

    def share(self, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the symbols' shares."""
        self.pick = self.at_pick[:n] + symbol
        self.next = self.pick + 1
        start, end = self.mix[self.pick], self.mix[self.next]
        return start.astype(np.int64), (end - start).astype(np.int64)

    def update(self, t: int, n: int, symbol: np.ndarray, ids: np.ndarray) -> None:
        """After `share`: the ids (int32) and symbols that came."""
        self.flat[t * self.lanes : t * self.lanes + n] = ids
        self.slots1[self.h1] = ids
        self.slots2[self.h2] = ids
        unsigned = ids.view(np.uint32)
        mixed1 = unsigned * np.uint32(2654435761)
        self.mixed2[:n] = self.mixed1[:n] * np.uint32(2246822519)
        self.mixed1[:n] = mixed1
        if t & 1:  # weights move at every other place
            better = self.a[self.next] - self.a[self.pick] > self.b[self.next] - self.b[self.pick]
            self.weight[:n] = _WEIGHT[self.weight[:n] * 2 + better]
        goal, rate = _GOAL[symbol].view(np.int16), 3 if t < 64 else 4 if t < 512 else 5
        for table_, rows, now in ((self.agree, self.row_a, self.a), (self.after, self.row_b[:n], self.b)):
            step = goal - now
            step >>= rate
            now += step
            table_[rows] = now.view(np.complex128)
        self.row_b[:n] = self.at_row[:n] + (unsigned & 31)
        self.last[:n] = _LAST[symbol]


class Writer:
    def __init__(self, lanes: int, length: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1)
        self.out = np.zeros((length + 8, lanes), np.uint32)  # words of 16 bits, and carries into the word before
        self.n, self.lanes, self.most = np.zeros(lanes, np.int64), np.arange(lanes), 0

    def put(self, lanes, start: np.ndarray, size: np.ndarray, bits: int = _TOTAL) -> None:
        """Codes start .. start + size of 2**bits for some lanes (a slice or an index)."""
        r = self.range[lanes] >> bits
        self.low[lanes] += start * r
        self.range[lanes] = size * r
        self.most += 2
        if self.most > len(self.out) - 8:
            self.most = int(self.n.max()) + 2
            if self.most > len(self.out) - 8:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)])
        short = np.flatnonzero(self.range < _LEAST)
        while len(short):
            low, n = self.low[short], self.n[short]
            self.out[n, short] = low >> 32
            self.n[short] = n + 1
            self.low[short] = (low & _LOW) << 16
            longer = self.range[short] << 16
            self.range[short] = longer
            short = short[longer < _LEAST]

    def finish(self) -> list[bytes]:
        if int(self.n.max()) + 3 > len(self.out):
            self.out = np.concatenate([self.out, np.zeros_like(self.out[:8])])
        for k in (32, 16, 0):
            self.out[self.n, self.lanes] = self.low >> k if k == 32 else self.low >> k & 0xFFFF
            self.n += 1
        most = self.n.max()
        carry = np.zeros(len(self.n), np.uint32)
        for row in self.out[:most][::-1]:
            row += carry
            carry = row >> 16
        words = np.ascontiguousarray(self.out[:most].T.astype(">u2"))
        return [row[:k].tobytes() for row, k in zip(words, self.n)]


class Reader:
    def __init__(self, coded: list[bytes]):
        lanes = len(coded)
        self.words = np.zeros((max(map(len, coded)) // 2 + 4, lanes), np.uint16)
        for i, c in enumerate(coded):
            self.words[: len(c) // 2, i] = np.frombuffer(c, ">u2")
        self.flat, self.lanes = self.words.ravel(), lanes
        self.code, self.range = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1)
        for k in range(3):
            self.code = self.code << 16 | self.words[k]
        self.next = np.arange(lanes) + 3 * lanes  # where each lane's next word is

    def at(self, lanes, bits: int = _TOTAL) -> np.ndarray:
        """Which of 2**bits equal shares the code lies in. Both numbers are below 2**48 and the quotient below 2**28, so
        the double is never rounded up to a whole number that it does not reach."""
        self.r = self.range[lanes] >> bits
        return np.minimum((self.code[lanes] / self.r).astype(np.int64), (1 << bits) - 1)

    def take(self, lanes, start: np.ndarray, size: np.ndarray) -> None:
        self.code[lanes] -= start * self.r
        self.range[lanes] = size * self.r
        short = np.flatnonzero(self.range < _LEAST)
        while len(short):
            at = self.next[short]
            self.code[short] = self.code[short] << 16 | self.flat.take(at, mode="clip")
            self.next[short] = at + self.lanes
            longer = self.range[short] << 16
            self.range[short] = longer
            short = short[longer < _LEAST]


def _distances(ids: np.ndarray) -> np.ndarray:
    """How far back each lane's id occurred last, by place, then lane; 0: not before."""
    lanes, length = ids.shape
    small = int(ids.max()) < 1 << 19  # id and place fit 31 bits
    keyed = ids.astype(np.int32 if small else np.int64) << 12 | np.arange(length, dtype=np.int32)
    keyed.sort(axis=1)
    place = (keyed & 0xFFF).astype(np.int16)
    keyed >>= 12
    far = np.zeros((lanes, length), np.int16)
    np.subtract(place[:, 1:], place[:, :-1], out=far[:, 1:], where=keyed[:, 1:] == keyed[:, :-1])
    out = np.empty((length, lanes), np.int16)
    out[place, np.arange(lanes)[:, None]] = far
    return out


def _encode_lanes(blocks: list[np.ndarray], wide: bool) -> list[bytes]:
    """Blocks ordered by falling length."""
    lengths = np.array([len(b) for b in blocks])
    lanes, length = len(blocks), int(lengths[0])
    ids = np.zeros((lanes, length), np.int32)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    # What a place has to say if neither prediction holds: by place, then lane.
    far, ids = _distances(ids), np.ascontiguousarray(ids.T)
    other = _SYMBOL[far]
    value = np.where(far, far - _BASE.astype(np.int32)[other], ids & 0xFFFF)
    models, out = Models(lanes, length), Writer(lanes, length)
    active = np.searchsorted(-lengths, -np.arange(length), side="left")
    for t in range(length):
        n = int(active[t])
        now, symbol = ids[t, :n], other[t, :n]
        guess2, guess1 = models.predict(n)
        symbol[now == guess1] = 1
        symbol[now == guess2] = 0
        start, size = models.share(symbol, n)
        # One coding step for both: the symbol's share of the range is cut into 2**bits equal parts.
        size <<= PARTS - _BITS[symbol]
        start <<= PARTS
        start += value[t, :n] * size * (symbol > 1)
        out.put(slice(n), start, size)
        if wide:
            new = np.flatnonzero(symbol == NEW)
            out.put(new, now[new].astype(np.int64) >> 16, 1, 16)
        models.update(t, n, symbol, now)
    return out.finish()


def _decode_lanes(coded: list[bytes], lengths: np.ndarray, wide: bool) -> np.ndarray:
    lanes, length = len(coded), int(lengths[0])
    models, inp = Models(lanes, length), Reader(coded)
    active = np.searchsorted(-lengths, -np.arange(length), side="left")
    for t in range(length):
        n = int(active[t])
        guess2, guess1 = models.predict(n)
        place = inp.at(slice(n))
        eightfold = np.repeat((place >> PARTS) * 0x0001000100010001, 2).view(np.int16)
        symbol = np.bitwise_count((models.mix <= eightfold).view(np.uint64)) - np.uint8(1)
        start, size = models.share(symbol, n)
        size <<= PARTS - _BITS[symbol]
        start <<= PARTS
        value = ((place - start) / size).astype(np.int64)  # both below 2**28
        start += value * size
        inp.take(slice(n), start, size)
        back = (t - value - _BASE[symbol]) * models.lanes + models.at[:n]
        now = np.where(symbol == NEW, value, models.flat.take(back, mode="clip")).astype(np.int32)
        np.copyto(now, guess1, where=symbol == 1)
        np.copyto(now, guess2, where=symbol == 0)
        if wide:
            new = np.flatnonzero(symbol == NEW)
            high = inp.at(new, 16)
            inp.take(new, high, 1)
            now[new] |= (high << 16).astype(np.int32)
        models.update(t, n, symbol, now)
    return np.ascontiguousarray(models.flat.reshape(length, lanes).T)


_HEAD = struct.Struct("<4sBIQ")  # magic, wide, blocks, ids
_BLOCK = struct.Struct("<III")  # ids, coded bytes, crc32 of the ids as little-endian unsigned 32-bit integers


def encode(ids: np.ndarray) -> bytes:
    """A shard's ids (below 2**31) as coded blocks."""
    ids = np.asarray(ids, np.int64)
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]  # only the last may be shorter
    parts = [_HEAD.pack(MAGIC, wide, len(blocks), len(ids))]
    for at in range(0, len(blocks), LANES):
        group = blocks[at : at + LANES]
        for b, c in zip(group, _encode_lanes(group, wide)):
            parts += [_BLOCK.pack(len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())), c]
    return b"".join(parts)


def decode(data: bytes) -> np.ndarray:
    """The ids of a shard (uint32); raises ValueError if a block does not match its checksum."""
    magic, wide, n, total = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not an id archive")
    at, heads, coded = _HEAD.size, [], []
    for _ in range(n):
        head = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        heads.append(head)
        coded.append(data[at : at + head[1]])
        at += head[1]
    out = np.empty(total, "<u4")
    done = 0
    for k in range(0, n, LANES):
        group = heads[k : k + LANES]
        lengths = np.array([h[0] for h in group])
        ids = _decode_lanes(coded[k : k + LANES], lengths, bool(wide))
        for i, (size, _, crc) in enumerate(group):
            part = ids[i, :size].view("<u4")
            if zlib.crc32(part.tobytes()) != crc:
                raise ValueError(f"block {k + i} is damaged")
            out[done : done + size] = part
            done += size
    return out


def write_archive(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encodes every document, shard by shard in ascending doc_id order, and writes the archive to `path`."""

    def run(blocks):
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        shard, part = TaskContext.get().partitionId(), 0
        ids, sizes, held, n = [], [], [], 0

        def row():
            flat = np.frombuffer(b"".join(held), "<u4")
            return {"shard": [shard], "part": [part], "doc_ids": [ids], "sizes": [sizes], "n_ids": [len(flat)], "data": [encode(flat)]}

        for doc_ids, texts in blocks:
            for i, raw in zip(doc_ids, enc.block(texts)):
                ids.append(i)
                sizes.append(len(raw) // 4 + 1)
                held += [raw, end]
                n += len(raw) // 4 + 1
                if n >= BLOCK * LANES:
                    yield row()
                    ids, sizes, held, n, part = [], [], [], 0, part + 1
        if ids:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, run, "shard int, part int, doc_ids array<long>, sizes array<long>, n_ids long, data binary", 256).write.parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the archive's files alone."""
    shards = spark.read.parquet(path)

    def run(blocks):
        for shard, part, ids, sizes, data in blocks:
            for s, p, docs, lens, coded in zip(shard, part, ids, sizes, data):
                flat = decode(coded)
                ends = np.cumsum(lens)
                starts = ends - lens
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield {"shard": [s] * len(docs), "part": [p] * len(docs), "doc_id": docs, "within": starts, "n_tokens": lens, "ids_crc32": crc}

    docs = arrow_map(shards.select("shard", "part", "doc_ids", "sizes", "data"), run, "shard int, part int, doc_id long, within long, n_tokens long, ids_crc32 long", 1)
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per some million ids
    firsts = shards.select("shard", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    return docs.join(firsts, ["shard", "part"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op2_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return read_archive(spark, path)
