"""Operators over the whole corpus, held against brute force on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storyloom.llm import graph, packing, quality, simhash, sketches, substrings
from storyloom.llm.tokens import vocabulary_path
from tests.llm import fixtures


def plain_components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    pairs = {tuple(sorted(e)) for e in edges}
    want = plain_components(nodes, lambda a, b: (a, b) in pairs)
    assert {n: got.get(n, n) for n in nodes} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_trie_join_finds_every_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 6), replace=False)))
    dense = int(base[0])
    for i in range(64):
        for j in range(i):
            fps.add(dense ^ (1 << i) ^ (1 << j))
    fp = np.array(sorted(fps), np.uint64)
    label = simhash.trie_self_join(np.zeros(len(fp), np.int64), fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = np.arange(len(fp))
    while True:  # least reachable index
        now = np.array([want[n].min() for n in near])
        if (now == want).all():
            break
        want = now
    assert (label == want).all()


def test_simhash_on_a_table(spark):
    rows = fixtures.documents()
    base = rows[40][1]
    words = base.split()
    for i in range(40):  # a group of near copies
        w = list(words)
        w[i % len(w)] = "other"
        rows.append((100 + i, " ".join(w), "en", "s", 0, "", "", 0))
    rows += [(500 + i, base, "en", "s", 0, "", "", 0) for i in range(30)] + [(40, base, "en", "s", 0, "", "", 0), (None, base, "en", "s", 0, "", "", 0)]
    got = simhash.near_duplicates(fixtures.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {i: plain_fingerprint(t) for i, t, *_ in rows if i is not None}
    want = plain_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == fp[r.doc_id] and r.component_id == want[r.doc_id]
        else:
            assert r.component_id is None
    kept = simhash.keep_one(fixtures.frame(spark, rows))
    assert kept.columns == fixtures.frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(fixtures.frame(spark, [])).count() == 0 and simhash.keep_one(fixtures.frame(spark, [])).count() == 0


def test_one_row_of_every_component_stays(spark):
    rng = random.Random(12)
    a, b, c, d, e = (fixtures.text(rng, 12) for _ in range(5))
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (None, a), (None, d), (None, d), (3, e), (3, None), (4, None)]
    df = spark.createDataFrame([(i, t, "fp", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp string, n int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and all(r.fp == "fp" for r in kept.collect())
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (9, c), (None, d), (3, e), (3, None)], key=str)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(df.select("doc_id", "text")).collect()}
    signed = lambda t: plain_fingerprint(t) - ((1 << 64) if plain_fingerprint(t) >> 63 else 0)
    assert [got[i, signed(t)] for i, t in ((1, a), (5, a), (5, b), (7, b), (9, c), (3, None), (None, d))] == [1, 1, 5, 5, 9, 3, None]


def test_large_buckets_split_without_loss(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {x ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for x in base for _ in range(10)}
    fps |= {(0xABC << 52) | rng.getrandbits(40) for _ in range(300)}
    fps |= {x ^ sum(1 << i for i in rng.sample(range(40), 4)) for x in sorted(fps)[-40:]}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(signed, lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 4)
    for large in (simhash.LARGE, 3):
        found = graph.components(simhash.bucket_links(simhash.buckets(nodes, large).repartition(4, "key").sortWithinPartitions("key")))
        got = {r.node: r.root for r in found.collect()}
        assert {x: got.get(x, x) for x in signed} == want
    with pytest.raises(ValueError):
        simhash.roots(nodes, 5)


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def check_plan(lengths, capacity):
    counts = Counter(lengths)
    plan, bins = packing.best_fit_decreasing(counts, capacity)
    assert bins == plain_best_fit(lengths, capacity), (capacity, sorted(lengths, reverse=True))
    held, ranks = defaultdict(list), defaultdict(list)
    for n, a, b, first, offset, per in plan:
        ranks[n] += range(a, b)
        for k in range(b - a):
            held[first + k // per].append((offset + k % per * n, n))
    assert {n: sorted(r) == list(range(counts[n])) for n, r in ranks.items()} == {n: True for n in counts} and set(held) == set(range(bins))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= capacity


def test_plan_is_best_fit_decreasing():
    check_plan([60, 60, 20, 20, 13, 13, 13], 100)
    for seed in range(5000):
        rng = random.Random(seed)
        capacity = rng.choice([7, 20, 64, 100])
        few = [rng.randint(1, capacity) for _ in range(4)]
        check_plan([rng.randint(1, capacity) if rng.random() < 0.5 else rng.choice(few) for _ in range(rng.randint(0, 40))], capacity)
    for seed in range(30):
        rng = random.Random(seed)
        check_plan([rng.randint(1, 64) if rng.random() < 0.7 else 21 for _ in range(300)], 64)


def test_packing_on_a_table(spark, monkeypatch):
    rows = fixtures.documents() + fixtures.documents()[:3]
    for plan_rows in (packing.PLAN_ROWS, 5):
        monkeypatch.setattr(packing, "PLAN_ROWS", plan_rows)
        got = packing.pack_documents(fixtures.frame(spark, rows), vocabulary_path(), 512).collect()
        seqs = defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append((r.offset, r.length))
        for parts in seqs.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 512
        assert len(seqs) == plain_best_fit([r.length for r in got], 512)
        assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
        assert next(r for r in got if r.doc_id == 3).length == 1
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(vocabulary_path()), defaultdict(list)
    for r in got:
        at[r.doc_id].append(r)
    for i, t, *_ in fixtures.documents()[3:]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(at[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, k * 512, len(ids[k * 512 : (k + 1) * 512])) for k in range(-(-len(ids) // 512))]
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(np.array(ids[k * 512 : (k + 1) * 512], "<u4").tobytes()) for k in range(len(parts))]
    assert packing.pack_documents(fixtures.frame(spark, []), vocabulary_path()).count() == 0


def plain_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def plain_ratio(texts, trusted):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h

    def buckets(text):
        import re

        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        long = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed & (1 << 64) - 1)
        pairs = [signed(long(b, long(a, 42))) for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h] + [x % quality.BUCKETS + quality.BUCKETS for x in pairs]

    raw, target, per = Counter(), Counter(), []
    for i, t in texts:
        b = buckets(t)
        per.append(b)
        raw.update(b)
        if i in trusted:
            target.update(b)
    total = lambda c, o: sum(n for k, n in c.items() if (k >= quality.BUCKETS) == o)
    sums = {o: (total(raw, o), total(target, o)) for o in (False, True)}

    def ratio(k):
        r, t = sums[k >= quality.BUCKETS]
        prior = (1 + raw[k] / r * quality.BUCKETS) / 2
        return np.log((target[k] + prior) / (t + quality.BUCKETS)) - np.log((raw[k] + prior) / (r + quality.BUCKETS))

    return [sum(map(ratio, b)) / max(1, len(b)) for b in per]


def test_quality_on_a_table(spark):
    rows = fixtures.documents()
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 60, 3)] + [(None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(fixtures.frame(spark, rows), labels).collect()}
    for i, t, *_ in rows:
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == plain_base(t), i
    want = plain_ratio([(r[0], r[1]) for r in rows], {i for i in range(0, 60, 6)})
    for (i, *_), w in zip(rows, want):
        assert abs(got[i].ratio - w) < 1e-9, i
        assert got[i].kept == (not got[i].base_failed and w >= quality.THRESHOLD)
    kept = quality.keep_good(fixtures.frame(spark, rows), labels)
    assert kept.columns == fixtures.frame(spark, rows).columns and all(r.kept == "kept?" for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}
    none = quality.assess(fixtures.frame(spark, rows), labels.limit(0)).collect()
    assert all(r.ratio == 0 and r.kept != r.base_failed for r in none)
    assert quality.assess(fixtures.frame(spark, []), labels).count() == 0


def shingles(text):
    w = [x for x in __import__("re").split(r"[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_on_a_table(spark, tmp_path, monkeypatch):
    rows = fixtures.documents()
    fixtures.save(fixtures.frame(spark, rows), tmp_path, "documents")
    import hashlib

    for docs_per_range in (sketches.RANGE_DOCS, 7):
        monkeypatch.setattr(sketches, "RANGE_DOCS", docs_per_range)
        got = {r.doc_id: r for r in sketches.op7_fingerprints(spark, str(tmp_path)).collect()}
        assert len(got) == len(rows)
        for k, (i, t, *_) in enumerate(rows):
            t, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
            edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t), i
            a, b, c = shingles(t), shingles(edited), shingles(follow)
            if len(a | b) <= sketches.K:
                assert abs(got[i].near_edited - likeness(a, b)) < 1e-9
            if len(a | c) <= sketches.K:
                assert abs(got[i].near_next - likeness(a, c)) < 1e-9
            if len(a) < sketches.K:
                assert got[i].n_shingles == len(a)
        assert got[10].fingerprint == got[20].fingerprint and got[4].fingerprint == got[3].fingerprint == ""
    fixtures.save(fixtures.frame(spark, []), tmp_path, "documents")
    assert sketches.op7_fingerprints(spark, str(tmp_path)).count() == 0
    fixtures.save(fixtures.frame(spark, [rows[0], (None, "x y", "en", "s", 0, "", "", 0)]), tmp_path, "documents")
    alone = {r.doc_id: r for r in sketches.op7_fingerprints(spark, str(tmp_path)).collect()}
    assert alone[0].near_next == 1.0 and alone[None].near_next == 0.0


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    parts = spark.createDataFrame([("a", "one two three four five six"), ("a", "seven eight nine ten eleven twelve"), ("b", "")], "source string, text string")
    made = parts.select("source", sketches.sketch(sketches.shingle_hashes(F.col("text"))).alias("s"))
    merged = {r.source: r.s for r in sketches.merge_sketches(made, ["source"], "s").collect()}
    every = sorted(h for r in made.where("source = 'a'").collect() for h in r.s)
    assert merged["a"] == every and len(every) == 4


def test_sentences_and_spans():
    t = "One two three. Four five six seven! alpha beta Gamma delta.\nnew line here"
    assert [t[s:e] for s, e, _ in substrings.sentences(t)] == ["One two three.", "Four five six seven!", "alpha beta", "Gamma delta.", "new line here"]
    found = [(0, 0, ["w"] * n) for n in (10, 10, 10, 30, 1)]
    assert sorted(substrings.spans(found)) == [(0, 2), (1, 3), (2, 3), (3, 4)]


def test_substrings_on_a_table(spark):
    rng = random.Random(9)
    passage = " ".join(fixtures.sentence(rng, n) for n in (14, 13, 15, 12, 11))  # over 50 words
    rows = [(i, fixtures.text(rng, 14), "en", "s", 1, "mine", "", 0) for i in range(40)]
    put = lambda i, at: (i, rows[i][1][:at].rsplit(" ", 1)[0] + " " + passage + " " + rows[i][1][at:], "en", "s", 1, "mine", "", 0)
    for i in (4, 9, 17, 30):
        rows[i] = put(i, 200)
    rows += [(60 + i, rows[20][1], "en", "s", 1, "mine", "", 0) for i in range(25)]  # copies
    rows += [rows[21], (90, None, "en", "s", 1, "mine", "", 0), (91, "", "en", "s", 1, "mine", "", 0), (92, "x " * 20_000, "en", "s", 1, "mine", "", 0), (None, rows[22][1], "en", "s", 1, "mine", "", 0)]
    df = fixtures.frame(spark, rows)
    got = defaultdict(list)
    for r in substrings.remove_repeats(df).collect():
        got[r.doc_id].append(r)
    assert len(rows) == sum(map(len, got.values()))
    inner = passage.split(". ", 1)[1][:-1]
    assert inner in got[4][0].text and all(inner not in got[i][0].text and got[i][0].n_removed >= 4 for i in (9, 17, 30))
    assert all(len(got[60 + i][0].text) < 0.3 * len(rows[20][1]) for i in range(25)) and got[20][0].text == rows[20][1]
    for i in (0, 1, 2, 3, 5, 21, 22, None):
        assert all(r.n_removed == 0 and r.text == next(x[1] for x in rows if x[0] == i) for r in got[i]), i
    assert len(got[21]) == 2 and got[90][0].text is None and got[91][0].text == ""
    plain = substrings.remove_repeats(df, report=False)
    assert plain.columns == df.columns and all(r.removed == "mine" for r in plain.collect())
    assert substrings.remove_repeats(fixtures.frame(spark, [])).count() == 0


def running(rng, n):
    return [rng.choice(fixtures.WORDS) + rng.choice(["", "re", "th", "an", "on"]) for _ in range(n)]


@pytest.mark.parametrize("n", [51, 52, 55, 60, 70])
def test_lower_case_passages_without_sentence_ends_share_a_span(n):
    rng = random.Random(n)
    for _ in range(400):
        passage = running(rng, n)
        seen = []
        for _ in range(2):
            words = running(rng, rng.randint(0, 60)) + passage + running(rng, rng.randint(0, 60))
            found, inner = substrings.pieces(" ".join(words))
            seen.append({" ".join(w for _, _, ws in found[a : b + 1] for w in ws) for a, b in substrings.spans(found, inner)})
        assert any(s in " ".join(passage) for s in seen[0] & seen[1])


def test_lower_case_passages_are_removed(spark):
    rng = random.Random(8)
    rows, passages = [], [running(rng, 51) for _ in range(60)]
    for i, p in enumerate(passages):
        for k in (0, 100):
            rows.append((i + k, " ".join(running(rng, 40) + p + running(rng, 40)), "en", "s", 1, "", "", 0))
    got = {r.doc_id: r for r in substrings.remove_repeats(fixtures.frame(spark, rows)).collect()}
    assert all(got[i].n_removed == 0 and got[i].text == rows[2 * i][1] for i in range(60))
    gone = [131 - len(got[100 + i].text.split()) for i in range(60)]
    assert min(gone) >= substrings.MIN_WORDS and max(gone) <= 51 and sum(gone) / 60 > 35
    one = [(i, "x " * 51 + " ".join(running(rng, 40)), "en", "s", 1, "", "", 0) for i in range(2)]
    assert {r.doc_id: r.n_removed > 0 for r in substrings.remove_repeats(fixtures.frame(spark, one)).collect()}[1]


def brute_removed(rows):
    """Sentences covered by any non-first repeated span, by comparing all spans."""
    first, out = {}, defaultdict(set)
    spans = []
    for i, t in rows:
        found = substrings.sentences(t)
        for a, b in substrings.spans(found):
            spans.append((i, a, b, tuple(w for _, _, ws in found[a : b + 1] for w in ws)))
    for i, a, b, words in sorted(spans):
        if words in first:
            out[i].update(range(a, b + 1))
        first.setdefault(words, (i, a))
    return out


def test_substrings_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    pool = [fixtures.sentence(rng, rng.randint(3, 16)) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(50)]
    monkeypatch.setattr(substrings, "CHUNK", 40)
    df = fixtures.frame(spark, [(i, t, "en", "s", 1, "", "", 0) for i, t in rows])
    want = brute_removed(rows)
    for r in substrings.remove_repeats(df).collect():
        assert r.n_removed == len(want[r.doc_id]), r.doc_id


def test_shortest_runs_cover_what_all_runs_cover(spark):
    """Every run of two or more sentences and 25 or more words, of known sentences; nothing of the operator is called."""
    rng = random.Random(13)
    pool = [fixtures.sentence(rng, rng.randint(3, 16)) for _ in range(22)]
    texts = {i: [rng.randrange(22) for _ in range(rng.randint(0, 18))] for i in range(60)}
    first, runs, want = {}, [], defaultdict(set)
    for i, parts in texts.items():
        for a in range(len(parts)):
            for b in range(a + 1, len(parts)):
                if sum(len(pool[p].split()) for p in parts[a : b + 1]) >= 25:
                    runs.append((i, a, b, tuple(parts[a : b + 1])))
    for i, a, b, run in sorted(runs):
        if first.setdefault(run, (i, a)) != (i, a):
            want[i].update(range(a, b + 1))
    rows = [(i, " ".join(pool[p] for p in parts), "en", "s", 1, "", "", 0) for i, parts in texts.items()]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(fixtures.frame(spark, rows)).collect()}
    assert got == {i: len(want[i]) for i in texts}


def test_plan_does_not_grow_with_the_table():
    rng = random.Random(1)
    shape = {n: rng.randint(1, 50) for n in range(1, 4097)}
    sizes = []
    for scale in (1_000, 1_000_000, 1_000_000_000):
        counts = {n: c * scale for n, c in shape.items()}
        plan, bins = packing.best_fit_decreasing(counts)
        least = -(-sum(n * c for n, c in counts.items()) // 4096)
        assert least <= bins <= 1.005 * least and sum(b - a for _, a, b, *_ in plan) == sum(counts.values())
        sizes.append(len(plan))
    assert max(sizes) < 100_000 and max(sizes) < 1.2 * min(sizes)
