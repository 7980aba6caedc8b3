"""The incremental clusterer: events in order of date join the best story that holds, or found a new one.

The fold depends on order, so a partition key (language, topic: whatever keeps stories apart) is taken in order by one
task. Its events pass through one at a time in sorted partitions and are not gathered; what is held is the stories
(centroid, distinct token sets, dates) and the posting lists that find them. In a stream each story and each posting
list is a state entry of its own, and a batch reads and writes only those that its events touch.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyloom.functions.vector import COMPATIBLE, HIGH, LOW, SIGMA_DAYS

DAY_US = 86_400_000_000


def compatible(a: str | None, b: str | None) -> bool:
    a, b = a or "unknown", b or "unknown"
    return a == b or "unknown" in (a, b) or "|".join(sorted((a, b))) in COMPATIBLE


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b):
        return 0.0
    norm = float(a @ a) * float(b @ b)
    return float(a @ b) / math.sqrt(norm) if norm else 0.0


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


class Story:
    def __init__(self, id_: int, vector: np.ndarray, family: str, tokens: frozenset, us: int):
        self.id, self.family, self.anchor = id_, family, vector
        self.centroid, self.members, self.last, self.n = vector.astype(np.float32), {tokens}, us, 1

    def add(self, vector: np.ndarray, tokens: frozenset, us: int) -> None:
        self.centroid = ((self.centroid.astype(np.float64) * self.n + vector) / (self.n + 1)).astype(np.float32)
        self.members.add(tokens)  # equal sets score alike
        self.n += 1
        self.last = max(self.last, us)

    def score(self, vector: np.ndarray, tokens: frozenset, us: int) -> float:
        days = abs(us - self.last) / DAY_US
        lexical = max(jaccard(tokens, m) for m in self.members)
        return 0.60 * cosine(vector, self.centroid.astype(np.float64)) + 0.25 * lexical + 0.15 * math.exp(-days * days / (2 * SIGMA_DAYS**2))


class Fold:
    """Stories so far, and the posting lists that find them; `step` takes the next events in order."""

    def __init__(self, low: float = LOW, high: float = HIGH, anchor: float | None = None, stress: bool = False, stories=None, postings=None):
        self.low, self.high, self.anchor, self.stress = low, high, anchor, stress
        self.stories = {} if stories is None else stories  # id -> Story
        self.postings = {} if postings is None else postings  # token -> ids

    def place(self, id_: int, us: int, family: str, tokens: Iterable[str], vector) -> tuple:
        tokens, vector = frozenset(tokens), np.asarray(vector, np.float64)
        names = set().union(*(self.postings.get(t, ()) for t in tokens)) if tokens else set()
        scored = [(-self.stories[n].score(vector, tokens, us), n) for n in names]
        close = lambda n: self.anchor is None or cosine(vector, self.stories[n].anchor) >= self.anchor
        best = min((s for s in scored if compatible(family, self.stories[s[1]].family) and close(s[1])), default=None)
        score = -(best or min(scored))[0] if scored else None
        if best and (score >= self.high or self.stress and score >= self.low):
            home, decision = best[1], "attach" if score >= self.high else "stress_attach"
            story = self.stories[home]
            story.add(vector, tokens, us)
            self.stories[home] = story
        else:
            home = id_
            decision = "new_no_candidate" if not scored else "new_below_low" if score < self.low else "new_ambiguous"
            self.stories[home] = Story(home, vector, family, tokens, us)
        for t in tokens:
            found = self.postings.get(t) or set()
            if home not in found:
                found.add(home)
                self.postings[t] = found
        return id_, home, decision, score

    def step(self, events: Iterable[tuple]) -> list[tuple]:
        return [self.place(*e) for e in sorted(events, key=lambda e: (e[1], e[0]))]


class ArrayFold:
    """What `Fold` decides, for a batch: stories are rows of arrays, so an event meets all its candidates at once.

    Token sets are kept once, each with the stories that have a member of that set; an event looks at the sets that share a
    token with its own, which gives the candidates and their lexical score."""

    def __init__(self, low: float = LOW, high: float = HIGH, anchor: float | None = None, stress: bool = False):
        self.low, self.high, self.anchor, self.stress = low, high, anchor, stress
        self.n = 0  # how many stories
        self.ids, self.last, self.size, self.length, self.family = (np.zeros(64, np.int64) for _ in range(5))
        self.norm, self.first_norm = np.zeros(64), np.zeros(64)
        self.centroid, self.first = np.zeros((64, 0)), np.zeros((64, 0))  # centroids hold single-precision values
        self.families, self.fits = {}, {}  # family -> number; family -> which of the numbers are compatible with it
        self.sets, self.rows, self.used = {}, [], []  # token set -> number; its stories, in an array that is filled so far
        self.members, self.by_token = [], {}  # per set the stories as a set; token -> sets

    def _room(self, width: int) -> None:
        if self.n == len(self.ids):
            for name in ("ids", "last", "size", "length", "family", "norm", "first_norm", "centroid", "first"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.zeros_like(a)]))
        if width > self.centroid.shape[1]:
            for name in ("centroid", "first"):
                a = getattr(self, name)
                setattr(self, name, np.pad(a, ((0, 0), (0, width - a.shape[1]))))

    def _join(self, tokens: frozenset, row: int) -> None:
        at = self.sets.get(tokens)
        if at is None:
            at = self.sets[tokens] = len(self.rows)
            self.rows.append(np.zeros(4, np.int64))
            self.used.append(0)
            self.members.append(set())
            for t in tokens:
                self.by_token.setdefault(t, []).append((at, tokens))
        if row not in self.members[at]:
            self.members[at].add(row)
            if self.used[at] == len(self.rows[at]):
                self.rows[at] = np.concatenate([self.rows[at], np.zeros_like(self.rows[at])])
            self.rows[at][self.used[at]] = row
            self.used[at] += 1

    def _fits(self, family: str | None) -> np.ndarray:
        known = self.fits.get(family)
        if known is None or len(known) < len(self.families):
            known = self.fits[family] = np.array([compatible(family, f) for f in self.families], bool)
        return known

    def _cosine(self, vector: np.ndarray, to: np.ndarray, norms: np.ndarray, rows: np.ndarray) -> np.ndarray:
        norm = norms[rows] * np.einsum("i,i->", vector, vector)
        ok = (self.length[rows] == len(vector)) & (norm != 0)
        dots = np.einsum("ij,j->i", to[rows, : len(vector)], vector)
        return np.where(ok, dots / np.sqrt(np.where(norm != 0, norm, 1.0)), 0.0)

    def place(self, id_: int, us: int, family: str, tokens: Iterable[str], vector) -> tuple:
        tokens, vector = frozenset(tokens), np.asarray(vector, np.float64)
        self._room(len(vector))
        near = {at: len(tokens & m) / len(tokens | m) for t in tokens for at, m in self.by_token.get(t, ())}
        lexical = np.zeros(self.n)
        for at, share in sorted(near.items(), key=lambda x: x[1]):
            lexical[self.rows[at][: self.used[at]]] = share
        rows = np.flatnonzero(lexical)
        best, score = None, None
        if len(rows):
            days = np.abs(us - self.last[rows]) / DAY_US
            scores = 0.60 * self._cosine(vector, self.centroid, self.norm, rows) + 0.25 * lexical[rows] + 0.15 * np.exp(-days * days / (2 * SIGMA_DAYS**2))
            may = self._fits(family)[self.family[rows]]
            if self.anchor is not None:
                may &= self._cosine(vector, self.first, self.first_norm, rows) >= self.anchor
            if may.any():
                score = scores[may].max()
                ties = rows[may & (scores == score)]
                best = ties[np.argmin(self.ids[ties])]
            else:
                score = scores.max()
            score = float(score)
        if best is not None and (score >= self.high or self.stress and score >= self.low):
            row, decision = int(best), "attach" if score >= self.high else "stress_attach"
            n = self.size[row]
            moved = ((self.centroid[row, : len(vector)] * n + vector) / (n + 1)).astype(np.float32)
            self.size[row] = n + 1
            self.last[row] = max(self.last[row], us)
        else:
            decision = "new_no_candidate" if score is None else "new_below_low" if score < self.low else "new_ambiguous"
            row, self.n = self.n, self.n + 1
            self.ids[row], self.last[row], self.size[row], self.length[row] = id_, us, 1, len(vector)
            self.family[row] = self.families.setdefault(family, len(self.families))
            self.first[row, : len(vector)], self.first_norm[row] = vector, np.einsum("i,i->", vector, vector)
            moved = vector.astype(np.float32)
        self.centroid[row, : len(vector)] = moved
        kept = self.centroid[row, : len(vector)]
        self.norm[row] = np.einsum("i,i->", kept, kept)
        self._join(tokens, row)
        return id_, int(self.ids[row]), decision, score


def fold(events: Iterable[tuple], **options) -> list[tuple]:
    """(event_id, story_id, decision, score) of events (event_id, us, family, tokens, vector) in order of (us, event_id).
    A candidate story shares a token with one of its members; posting lists find it. With `anchor`, an event also needs
    that cosine to the story's founder; `stress` attaches ambiguous events, too."""
    return Fold(**options).step(events)


SCHEMA = "key string, event_id long, story_id long, decision string, score double"


def cluster_runs(events: DataFrame, options: dict[str, dict]) -> DataFrame:
    """Batch form over (key, event_id, us, family, tokens, vector), with options by what stands before the first slash of
    the key. A key's events come sorted and pass through; only its stories are held, until the next key begins."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        key, now = None, None
        for pdf in batches:
            rows = []
            for k, *event in zip(pdf.key, pdf.event_id, pdf.us, pdf.family, pdf.tokens, pdf.vector):
                if now is None or k != key:
                    key, now = k, ArrayFold(**options.get(str(k).split("/", 1)[0], options.get("", {})))
                rows.append((k, *now.place(*event)))
            yield pd.DataFrame(rows, columns=["key", "event_id", "story_id", "decision", "score"])

    ordered = events.select("key", "event_id", "us", "family", "tokens", "vector").repartition("key").sortWithinPartitions("key", "us", "event_id")
    return ordered.mapInPandas(run, SCHEMA)


def cluster(events: DataFrame, **options) -> DataFrame:
    return cluster_runs(events, {"": options})


def summary(assigned: DataFrame, events: DataFrame) -> DataFrame:
    """Per key: stories, singletons, largest story, longest span in days."""
    s = assigned.join(events.select("event_id", "us"), "event_id").groupBy("key", "story_id").agg(F.count("*").alias("n"), ((F.max("us") - F.min("us")) / DAY_US).alias("span"))
    return s.groupBy("key").agg(F.count("*").alias("stories"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.round(F.max("span"), 6).alias("longest_days"))


_OUT = S.StructType([S.StructField("key", S.StringType()), S.StructField("event_id", S.LongType()), S.StructField("story_id", S.LongType()), S.StructField("decision", S.StringType()), S.StructField("score", S.DoubleType())])


class _Kept:
    """A map state behind a dictionary's face: entries are read when asked for and written back once, at the end."""

    def __init__(self, state):
        self.state, self.held, self.changed = state, {}, set()

    def get(self, k, default=None):
        if k not in self.held:
            self.held[k] = pickle.loads(self.state.getValue((k,))[0]) if self.state.containsKey((k,)) else None
        found = self.held[k]
        return default if found is None else found

    __getitem__ = get

    def __setitem__(self, k, v):
        self.held[k] = v
        self.changed.add(k)

    def flush(self) -> None:
        for k in self.changed:
            self.state.updateValue((k,), (pickle.dumps(self.held[k]),))


class StoryProcessor(StatefulProcessor):
    """The fold as a stateful streaming operator: each story and each posting list of a key is an entry of its state."""

    def __init__(self, **options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = lambda n, t: S.StructType([S.StructField(n, t)])
        self.stories = handle.getMapState("stories", one("id", S.LongType()), one("story", S.BinaryType()))
        self.postings = handle.getMapState("postings", one("token", S.StringType()), one("ids", S.BinaryType()))

    def handleInputRows(self, key, rows, timerValues):
        stories, postings = _Kept(self.stories), _Kept(self.postings)
        now = Fold(**self.options, stories=stories, postings=postings)
        events = [(int(i), int(us), f, t, v) for pdf in rows for i, us, f, t, v in zip(pdf.event_id, pdf.us, pdf.family, pdf.tokens, pdf.vector)]
        placed = now.step(events)
        stories.flush()
        postings.flush()
        yield pd.DataFrame([(key[0], *r) for r in placed], columns=["key", "event_id", "story_id", "decision", "score"])

    def close(self) -> None:
        pass


def cluster_stream(events: DataFrame, **options) -> DataFrame:
    """Streaming form over (key, event_id, us, family, tokens, vector); a batch is taken in order of date. Needs the
    RocksDB state store (`spark.sql.streaming.stateStore.providerClass`)."""
    return events.groupBy("key").transformWithStateInPandas(StoryProcessor(**options), outputStructType=_OUT, outputMode="Append", timeMode="None")
