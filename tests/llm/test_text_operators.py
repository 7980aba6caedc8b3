"""Operators that work a document at a time: personal data, BPE, archives, chat, toxicity."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from storyloom.llm import archive, bpe, chat, pii, toxicity
from storyloom.llm.tokens import encoder, vocabulary_path
from tests.llm import fixtures

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if k == "ip" else None, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[k]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    for _ in range(400):
        t = "".join(rng.choice("aB9.@-+ ()%_ 0125é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_scored_spans():
    kinds = lambda t: [k for _, _, k in pii.all_spans(t)[1]]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("iban GB82 WEST 1234 5698 7654 33") == []  # the checksum fails
    assert kinds('token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"') == ["secret"]
    assert kinds("commit 9c8b45435718dcc700c184a7e303cdc64c6a8f7f") == []  # context speaks against it
    assert kinds("card 154 4111111111111111") == ["card"]  # the base pattern takes 19 digits, which fail Luhn
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert pii.redact("mail a@b.co now") == "mail [EMAIL] now"


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+" * 200_000, "A1" * 100_000):
        pii.all_spans(t)


def test_pii_on_a_table(spark):
    df = fixtures.frame(spark)
    found = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert found[3].spans == "" and found[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [found[13][f"n_{k}"] for k in pii.BASE_KINDS] == [1, 1, 1, 1] and "iban" in found[13].spans
    red = pii.redact_documents(df)
    assert red.columns == df.columns and {r.doc_id for r in red.collect()} == set(range(60))
    row = red.where("doc_id = 13").first()
    assert "mail.example" not in row.text and row.n_chars == len(row.text) and row.removed == "as it was"
    assert red.where("doc_id = 3").first().text is None
    assert pii.find_pii(fixtures.frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def odd_texts():
    rng = random.Random(1)
    odd = ["", None, " ", "Hello <|endoftext|>World!! été x 😀 don't ﬁ 日本 12345", "ΣΑΣ ς İ \x85 a\xa0b \x1cq\x00z", "a" * 3000, "²½ ³x ªº _a_ 'S 'LL it's", "ǅ ŉ ß ẞ", "<|startoftext|><|endoftext|>", "\r\n\t x\x0by", "'''s ''re'", "é combining é"]
    return odd + ["".join(rng.choice("abz AZ'.,é1 2_日\n\t") for _ in range(rng.randint(1, 80))) for _ in range(300)] + [r[1] for r in fixtures.documents() if r[1] and len(r[1]) < 5000]


def test_trie_bpe_matches_the_library(library):
    texts = odd_texts()
    own = bpe.TrieBpe(vocabulary_path())
    for t, (groups, n) in zip(texts, own.block(texts)):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert " ".join(groups) == " ".join(map(str, want)) and n == len(want), t
        assert own.decode_groups(groups) == own.decode(want) == library.decode(want, skip_special_tokens=False), t


def test_decoding_reads_the_ids(library):
    own = bpe.TrieBpe(vocabulary_path())
    (groups, n), *_ = own.block(["the thing"])
    wrong = [str(int(groups[0].split()[0]) + 1), *groups[1:]]
    assert own.decode_groups(wrong) == library.decode([int(x) for g in wrong for x in g.split()], skip_special_tokens=False) != own.decode_groups(groups)


def test_trie_memory_is_the_longest_path():
    own = bpe.TrieBpe(vocabulary_path())
    words = ["thion", "thionre", "the", "a", "thionre"]
    assert own.encode_words(words) == {w: own.encode_words([w])[w] for w in set(words)}


def test_encoder_matches_the_library(library):
    texts = odd_texts()
    for t, raw in zip(texts, encoder(vocabulary_path()).block(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_bpe_on_a_table(spark):
    got = {r.doc_id: r for r in bpe.digest_documents(fixtures.frame(spark), vocabulary_path()).collect()}
    assert got[3].n_tokens == got[4].n_tokens == got[5].n_tokens == 0 and got[10].ids_sha256 == got[20].ids_sha256
    one = bpe.encode_documents(fixtures.frame(spark).where("doc_id = 6"), vocabulary_path()).first()
    assert len(one.ids) == got[6].n_tokens and hashlib.sha256(one.decoded.encode()).hexdigest() == got[6].decoded_sha256


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 5000])
@pytest.mark.parametrize("top", [1, 3, 300, 49408, 1 << 16, 1 << 20, 1 << 31])
def test_coder_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    data = archive.encode(ids)
    assert (archive.decode(data) == ids).all()
    if n and top > 3:
        broken = bytearray(data)
        broken[-3 - (n % 7)] ^= 0x41
        try:
            assert (archive.decode(bytes(broken)) == ids).all()  # the last bytes may not matter
        except ValueError:
            pass


def test_coder_learns_repeats():
    ids = np.tile(np.arange(50) * 977 % 49408, 40)
    assert len(archive.encode(ids)) < 0.35 * 2 * len(ids)


def test_archive_on_a_table(spark, tmp_path, library):
    rows = fixtures.documents()
    archive.write_archive(fixtures.frame(spark, rows), str(tmp_path / "a"), vocabulary_path())
    got = {r.doc_id: r for r in archive.read_archive(spark, str(tmp_path / "a")).collect()}
    start = 0
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    archive.write_archive(fixtures.frame(spark, []), str(tmp_path / "b"), vocabulary_path())
    assert archive.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(2)
    for _ in range(500):
        turns = [("".join(rng.choice("us\\<|>") for _ in range(3)), "".join(rng.choice("a\\<>|[]/s\nINST") for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 4))]
        assert list(chat.parse_turns("".join(chat.format_turn(*t) for t in turns))) == turns


def conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s><|user|>"), (1, 2, "user", None), (1, 3, "assistant", "b"), (1, 4, "user", "end"), (2, 0, "system", "only"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 0, None, "x")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, example string")


def test_chat(spark):
    made = chat.examples(conversations(spark))
    assert made.where("conv_id = 1 and target is not null").count() == 2
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert got[1].n_turns == 5 and got[1].loss_chars == len("</s><|user|>b") and got[1].loss_sha256 == hashlib.sha256("</s><|user|>b".encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\n</s><|user|>\nuser\n\nassistant\nb\nuser\nend\n".encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[3].n_turns == 2 and got[None].n_turns == 1
    whole = {(r.conv_id, r.example): r for r in chat.expand(made).collect()}
    second = whole[1, 1]
    assert chat.unescape(second.text[second.loss_start : second.loss_end]) == "b" and [t for _, t in chat.parse_turns(second.text)] == ["hi", "</s><|user|>", "", "b"]
    assert chat.read_back(chat.examples(conversations(spark).limit(0))).count() == 0


@pytest.mark.parametrize("part_chars", [40, chat.PART_CHARS])
def test_examples_against_brute_force(spark, part_chars):
    rng = random.Random(6)
    turns = [(c, k, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a<|b", "\\x[/INST]", "word " * rng.randint(1, 30)])) for c in range(25) for k in range(rng.randint(0, 14))]
    turns += [(99, k, "user", f"long wait {k}") for k in range(2000)] + [(100, 0, "user", "y" * 500), (100, 1, "assistant", "z" * 500)]
    made = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), part_chars=part_chars)
    want = {}
    for c in {t[0] for t in turns}:
        said, n = "", 0
        for _, _, role, text in sorted((t for t in turns if t[0] == c), key=lambda t: t[1]):
            now = chat.format_turn(role or "", text or "")
            if role == "assistant":
                want[c, n] = (said + now, text or "")
                n += 1
            said += now
    got = {(r.conv_id, r.example): (r.text, chat.unescape(r.text[r.loss_start : r.loss_end])) for r in chat.expand(made).collect()}
    assert got == want
    longest = max(len(chat.format_turn(r or "", t or "")) for *_, r, t in turns)
    assert all(len(r.context_delta) <= max(part_chars, longest) for r in made.collect())
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert {c: r.n_turns for c, r in back.items()} == {c: sum(t[0] == c for t in turns) for c in back} and back[99].loss_chars == 0
    assert all(back[c].expanded_chars == sum(len(t) for (i, _), (t, _) in want.items() if i == c) for c in back)


def test_restoring_disguised_words():
    counts = np.zeros(toxicity.SIDE**3, np.int64)
    for w in ("idiot", "stupid", "moron", "clown", "loser", "trash", "worthless", "the and of that"):
        for _ in range(50):
            toxicity.count_trigrams(f"the {w} and {w} of", counts)
    r = toxicity.Restorer(toxicity.Channel(toxicity.trigram_costs(counts)))
    for disguised, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("st*pid", "stupid"), ("i d i o t", "idiot"), ("t.r.a.s.h", "trash"), ("l0$er", "loser"), ("idiooooot", "idiot"), ("tr@sh!!", "trash")]:
        assert word in r.words(f"of {disguised} the"), disguised
    assert r.words("oueand$$$ the") == ["oueand", "the"]


def test_restoring_combined_disguises():
    counts = np.zeros(toxicity.SIDE**3, np.int64)
    for w in ("idiot", "stupid", "trash", "scum", "ass", "worthless", "the and of that"):
        for _ in range(50):
            toxicity.count_trigrams(f"the {w} and {w} of", counts)
    r = toxicity.Restorer(toxicity.Channel(toxicity.trigram_costs(counts)))
    for disguised, word in [
        ("i d ! o t", "idiot"), ("t r @ s h", "trash"), ("$ c u m", "scum"), ("a s s", "ass"), ("t\tr\ta\ts\th", "trash"), ("i\nd\ni\no\nt", "idiot"), ("s , c , u , m", "scum"), ("t / r / a / s / h", "trash"),
        ("i*d*i*o*t", "idiot"), ("stuupid", "stupid"), ("iddiott", "idiot"), ("a$$", "ass"), ("a55", "ass"), ("s t u u p i d", "stupid"), ("t  r  @  $  h", "trash"), ("1 d 1 0 t", "idiot"), ("a$$!", "ass"),
    ]:
        assert word in r.words(f"worthless {disguised} worthless"), disguised
    assert r.spaced("1 2 3 of") == [] and r.words("the and") == ["the", "and"]
    r.words("! " * 20_000 + "* " * 20_000 + "a " * 300 + "$*" * 20_000)


@pytest.mark.parametrize("breaks", [False, True])
def test_decoding_is_the_cheapest_of_all_readings(breaks):
    rng = random.Random(5)
    counts = np.zeros(toxicity.SIDE**3, np.int64)
    for w in ("idiot", "sass", "toss", "stst", "oo"):
        toxicity.count_trigrams(f"a {w} " * rng.randint(3, 30), counts)
    costs = toxicity.trigram_costs(counts)
    channel, index = toxicity.Channel(costs), {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}

    def cost(letters):
        x, y, total = 0, 0, 0.0
        for c in letters:
            i = index.get(c, 0)
            total += float(costs[x, y, i])
            x, y = (0, 0) if c == " " else (y, i)
        return total + (float(costs[x, y, 0]) if y else 0.0)

    for _ in range(150):
        text = "".join(rng.choice("iost10$!*@d") for _ in range(rng.randint(1, 5)))
        readings = channel.lattice(text, breaks)
        every = [("".join(r for r, _ in way), sum(k for _, k in way)) for way in itertools.product(*readings)]
        least = min(cost(r) + k for r, k in every)
        best = {r for r, k in every if cost(r) + k < least + 1e-4}
        assert channel.decode(text, breaks) in best, text


def test_looking_for_lone_characters_misses_none():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1 .*$!-_é\n") for _ in range(rng.randint(0, 14)))
        if toxicity._SPACED.search(text):
            assert toxicity.may_be_spaced(text), text


def test_toxicity_on_a_table(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = fixtures.text(rng, 5)
        words = t.split()
        for w in rng.sample(["idiot", "moron", "trash"], 2) if bad else []:
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 0, "", "", 0))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, "en", "s", 0, "", "", 0), (5001, "", "en", "s", 0, "", "", 0), (5002, "such a m0r0n " + fixtures.text(rng, 3), "en", "s", 0, "", "", 0)]
    docs, labels = fixtures.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    wrong = sum((got[i] >= 0.7) != (i % 6 == 0) for i in range(900))
    assert wrong <= 9 and got[5000] == got[5001] < 0.5 and got[5002] >= 0.7
    none = toxicity.learn(docs, labels.where("toxic = 0"))
    assert all(r.score < 1e-9 for r in toxicity.score_documents(docs.limit(5), none).collect())
