"""Repeated passages: runs of consecutive sentences hashed, joined over all documents, non-first ones removed.

A text is cut into sentences: after a terminator (. ! ? and their kin) that white space follows, at line breaks, and
before a capitalised word inside a line, which is where a passage pasted into the middle of a sentence begins. Long
sentences are cut further after words chosen by the hashes around them, so that a passage gives the same pieces wherever
it stands; a passage of over 50 words without any sentence end always has a span of its own. A span is a run of consecutive sentences: from each sentence the shortest run forward, and to each sentence the
shortest run backward, of at least two sentences and at least MIN_WORDS words (inside a long sentence, backward runs that
the forward run from the same piece covers but for less than a piece are left out). Every span is hashed (128 bits of its
words); spans of equal hash are copies, the first is the one of the least (doc_id, position), and every sentence that
some non-first copy covers is removed. What is shorter than a span (common words, headings, stock lines) stays.

The shortest runs stand for all: a longer run that repeats is covered by the shortest runs from its sentences that end in
it and those to its sentences that begin in it, each of which repeats with it, and whatever these cover repeats itself.
Departures from sentences as such are the cuts before capitalised words and within sentences of more than LONG words.

Spans are shuffled once. Of a hash's copies within a chunk of spans only the first goes to where the hash's first copy
is decided, the others are known as repeats and spread by keys of their own; so a passage that a third of all documents
share meets as one row per chunk. Only repeats go on to the rebuilding of their documents.

Defined results: a null text stays null, an empty or blank one unchanged; rows that repeat
a doc_id and its text are one document, rows that share a doc_id alone are ordered by their text's CRC-32; rows with a null doc_id are left alone and are nobody's first. A very long text without
sentence ends is cut like any long sentence.
"""

from __future__ import annotations

import re
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_map, table

MIN_SENTENCES = 2
MIN_WORDS = 25
LONG = 24  # words; a longer sentence is cut further
WINDOW = 6  # words, of which one is cut after; 51 words less 2 * WINDOW - 2 at either edge leave MIN_WORDS and a piece
CHUNK = 1_000_000  # spans, 40 bytes each
_REPEAT = 128  # marks a span that is a repeat for sure

_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def cuts(words: list[str]) -> list[int]:
    """After which words a long run is cut: in every WINDOW words the last of least hash (winnowing). Which of a window's
    words that is hangs on the window alone, so two copies of a passage are cut alike but for WINDOW - 1 words at either
    edge, and no piece but the first and last is longer than WINDOW. One word over and over is cut after each."""
    hashes = [zlib.crc32(w.encode()) for w in words]
    out, best = [], -1
    for i in range(WINDOW - 1, len(words)):
        if best <= i - WINDOW:
            lo = i - WINDOW + 1
            best = max(range(lo, i + 1), key=lambda k: (-hashes[k], k))
        elif hashes[i] <= hashes[best]:
            best = i
        if not out or out[-1] != best:
            out.append(best)
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, normal words) of each sentence; code points, end after its last word."""
    return pieces(text)[0]


def pieces(text: str) -> tuple[list[tuple[int, int, list[str]]], set[int]]:
    """The text's sentences, and which of them end at a cut inside a long one."""
    raw: list[list[tuple[int, int, str]]] = []
    for line in re.finditer(r"[^\n]+", text):
        now: list[tuple[int, int, str]] = []
        base = line.start()
        for m in _WORD.finditer(line.group()):
            w = m.group()
            if now and w[0].isupper() and not w.isupper() and not now[-1][2][0].isupper():
                raw.append(now)
                now = []
            now.append((base + m.start(), base + m.end(), w))
            if _END.search(w):
                raw.append(now)
                now = []
        if now:
            raw.append(now)
    out: list[tuple[int, int, list[str]]] = []
    inner: set[int] = set()
    for words in raw:
        normal, at = [w.lower() for _, _, w in words], 0
        for i in cuts(normal) if len(words) > LONG else ():
            if i + 1 < len(words):
                inner.add(len(out))
                out.append((words[at][0], words[i][1], normal[at : i + 1]))
                at = i + 1
        out.append((words[at][0], words[-1][1], normal[at:]))
    return out, inner


def spans(found: list[tuple[int, int, list[str]]], inner: set[int] = frozenset()) -> list[tuple[int, int]]:
    """(first, last) sentence of each span, without repeats: shortest runs forward from, and backward to, each sentence. To
    one of `inner`, from a piece of at most WINDOW words, the forward run falls short by less than that piece and stands
    for both."""
    n, out = len(found), {}
    size = [0]
    for _, _, w in found:
        size.append(size[-1] + len(w))
    j = 0
    for i in range(n):
        j = max(j, i + MIN_SENTENCES - 1)
        while j < n and size[j + 1] - size[i] < MIN_WORDS:
            j += 1
        if j >= n:
            break
        out[i, j] = True
    i = n - 1
    for j in range(n - 1, -1, -1):
        i = min(i, j - MIN_SENTENCES + 1)
        while i >= 0 and size[j + 1] - size[i] < MIN_WORDS:
            i -= 1
        if i < 0:
            break
        if j not in inner or len(found[i][2]) > WINDOW:
            out[i, j] = True
    return list(out)


def hashed_spans(docs: DataFrame) -> DataFrame:
    """(key, rest, doc_id, place) of every span: 64 bits of the hash; 56 more, a bit for known repeats and the number of
    sentences (at most MIN_WORDS); the document; the place (which row of that doc_id, which sentence; ascending in reading
    order). Four numbers and no more, as these rows are most of what is shuffled.

    Spans are gathered CHUNK at a time, and of a hash's copies within a chunk only the first competes for being the first
    of all; the others are repeats already. They are marked and get a key of their own, so that they spread."""

    def run(blocks):
        import numpy as np
        import xxhash

        held, digests = array("q"), bytearray()

        def chunk():
            h = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
            doc, place, size = np.array(held, np.int64).reshape(-1, 3).T.copy()
            key, rest = h[:, 0].copy(), (h[:, 1] & ~0xFF)
            order = np.lexsort((place, doc, rest, key))
            like = lambda *cols: np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in cols])
            order = order[np.r_[True, ~like(key, rest, doc, place)]]  # a repeated row is the same document
            repeat = order[np.r_[False, like(key, rest)]]
            rest |= size
            rest[repeat] |= _REPEAT
            key[repeat] ^= (doc[repeat] * 0x9E3779B1) ^ (place[repeat] * 0x85EBCA6B)
            return {"key": key[order], "rest": rest[order], "doc_id": doc[order], "place": place[order]}

        for ids, texts in blocks:
            for i, text in zip(ids, texts):
                if i is None or not text:
                    continue
                found, inner = pieces(text)
                row = zlib.crc32(text.encode()) << 31
                lines = [" ".join(w) for _, _, w in found]
                for a, b in spans(found, inner):
                    digests += xxhash.xxh3_128_digest(" ".join(lines[a : b + 1]))
                    held.extend((i, row + a, b - a + 1))
            if len(held) >= 3 * CHUNK:
                yield chunk()
                held, digests = array("q"), bytearray()
        if held:
            yield chunk()

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "key long, rest long, doc_id long, place long", 256)


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, covered): the sentence ranges of each document that non-first copies cover, as an array of structs."""
    # A hash has one competing row per chunk, so its group is small; repeats known as such stand alone.
    known, size = F.col("rest").bitwiseAND(F.lit(_REPEAT)) != 0, F.col("rest").bitwiseAND(F.lit(_REPEAT - 1))
    every = hashed_spans(docs).repartition("key")
    rank = F.rank().over(Window.partitionBy("key", F.shiftright("rest", 8), known).orderBy("doc_id", "place"))
    later = every.withColumn("rank", rank).where((F.col("rank") > 1) | known)
    first = F.col("place").bitwiseAND(F.lit((1 << 31) - 1))
    later = later.select("doc_id", F.shiftright("place", 31).alias("row"), F.struct(first.cast("int").alias("first"), (first + size - 1).cast("int").alias("last")).alias("span"))
    return later.groupBy("doc_id", "row").agg(F.collect_set("span").alias("covered"))


def _without(text: str, covered: list[dict]) -> tuple[str, int, str]:
    """The text without the sentences covered, how many are gone, and the removed ranges."""
    found = sentences(text)
    gone = [False] * len(found)
    for c in covered:
        for k in range(c["first"], min(c["last"] + 1, len(found))):
            gone[k] = True
    out, at, ranges = [], 0, []
    k = 0
    while k < len(found):
        if gone[k]:
            start = found[k][0]
            while k + 1 < len(found) and gone[k + 1]:
                k += 1
            end = found[k][1]
            ranges.append(f"{start}:{end}")
            out.append(text[at:start])
            at = end
            while at < len(text) and text[at] in " \t" and (not out[-1] or out[-1][-1] in " \t\n"):
                at += 1
        k += 1
    out.append(text[at:])
    return "".join(out), sum(gone), ",".join(ranges)


def remove_repeats(docs: DataFrame, report: bool = True) -> DataFrame:
    """`docs` with repeated spans removed from `text` and `n_chars` (where present) brought up to date; with `report` also
    n_removed and removed (sentences, and ranges start:end of the text as it was), in place of columns so called."""
    docs = docs.drop("n_removed", "removed") if report else docs
    names = docs.columns
    repeats = repeated_sentences(docs).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("covered").alias("__covered"))
    row = F.crc32(F.encode("text", "UTF-8"))
    joined = docs.join(repeats, (docs.doc_id.cast("long") == F.col("__doc")) & (row == F.col("__row")), "left").select(*names, "__covered")

    def run(blocks):
        for cols in blocks:
            out = dict(zip([*names, "__covered"], cols))
            covered = out.pop("__covered")
            done = [_without(t, c) if c and t else (t, 0, "") for t, c in zip(out["text"], covered)]
            out["text"] = [d[0] for d in done]
            if "n_chars" in out:
                out["n_chars"] = [n if d[0] is None else len(d[0]) for n, d in zip(out["n_chars"], done)]
            yield out | ({"n_removed": [d[1] for d in done], "removed": [d[2] for d in done]} if report else {})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(joined, run, f"{ddl}, n_removed int, removed string" if report else ddl, 256)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs)
