"""BPE encoding and decoding by walking the trie of distinct words once.

The words of a block, sorted, are the leaves of their trie in depth-first order. While the walk goes down, each node
(a prefix) gets one value: the last token of the prefix's encoding. It follows from the nodes above alone: a token t
that ends the prefix is the last one exactly if the rest is empty, or t stands its ground beside the last token of the
rest (encoding the two side by side gives the two again). A node is visited once, however many words share it; only the
path from the root to the current node is held, so memory is bounded by the longest word. A word's ids are read off
backwards from its leaf, whose final symbol is the end-of-word form.

Decoding reads ids alone: a group of ids (those of a chunk) is looked up by its ids in what the worker has decoded
before, else id by id in the vocabulary; nothing of the encoder's strings goes into it.

Defined results: null and empty texts have no ids, the digest of nothing and an empty decoded text; strings that are
control tokens of the vocabulary become those tokens; texts are read whole whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_map, table
from storyloom.llm.tokens import MEMO, ChunkCodes, byte_alphabet, plain, vocabulary_path, word_pattern

END = "</w>"


class TrieBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.vocab = path, model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.control.items()}
        self.longest = max(len(s.removesuffix(END)) for s in self.vocab)
        self.inner = {s for s in self.vocab if not s.endswith(END)}
        self.final = {s.removesuffix(END) for s in self.vocab if s.endswith(END)}
        self.words = word_pattern()
        alphabet = byte_alphabet()
        self.alphabet = {b: s for b, s in alphabet.items()}
        self.stands: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.memo: dict[str, tuple[str, ...]] = {}
        self.chunks = ChunkCodes(self._new)
        self.decoded = _Decoded(self.strings)
        self._lib = None

    # -- the pair test -------------------------------------------------------------------------------------------
    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE over few symbols: join the pair of least rank, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranked = [(self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            best, _ = min(ranked)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and self.rank.get((symbols[i], symbols[i + 1])) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def stable(self, token: str) -> bool:
        """The token is what encoding its own symbols gives."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merge(self.symbols(token)) == [token]
        return found

    def side_by_side(self, left: str, right: str) -> bool:
        found = self.stands.get((left, right))
        if found is None:
            if len(self.stands) > 4 * MEMO:
                self.stands.clear()
            found = (left, right) not in self.rank and self.merge(self.symbols(left) + self.symbols(right)) == [left, right]
            self.stands[left, right] = found
        return found

    # -- the walk ------------------------------------------------------------------------------------------------
    def _last(self, word: str, depth: int, last: list[str], tokens: set[str], suffix: str) -> str:
        """The last token of word[:depth], given those of all shorter prefixes."""
        for size in range(min(depth, self.longest), 0, -1):
            part = word[depth - size : depth]
            if part in tokens:
                token = part + suffix
                if self.stable(token) and (size == depth or last[depth - size] is not None and self.side_by_side(last[depth - size], token)):
                    return token
        return None

    def encode_words(self, words: list[str]) -> dict[str, tuple[str, ...]]:
        """Byte-alphabet words to token strings."""
        out, path, last = {}, "", [""]
        for word in sorted(set(words)):
            body = len(word) - 1
            keep, most = 0, min(len(path), body)
            while keep < most and path[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :]
            for depth in range(keep + 1, body + 1):
                last.append(self._last(word, depth, last, self.inner, ""))
            path = word[:body]
            token = self._last(word, len(word), last, self.final, END)
            found, at = [], len(word)
            while token:
                found.append(token)
                at -= len(token) - len(END) * (at == len(word))
                token = last[at]
            out[word] = tuple(reversed(found))
        return out

    def to_bytes_alphabet(self, word: str) -> str:
        return word if word.isascii() else "".join(self.alphabet[b] for b in word.encode())

    # -- texts ---------------------------------------------------------------------------------------------------
    def _new(self, chunks: list[str]) -> list[tuple[str, int]]:
        """For each chunk: its ids, space-joined, and how many there are."""
        split = [[self.to_bytes_alphabet(w) for w in self.words.findall(c)] for c in chunks]
        return self._codes(split)

    def _codes(self, split: list[list[str]]) -> list[tuple[str, int]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, vocab = self.memo, self.vocab
        memo.update(self.encode_words([w for ws in split for w in ws if w not in memo]))
        ids = [[str(vocab[t]) for w in ws for t in memo[w]] for ws in split]
        return [(" ".join(x), len(x)) for x in ids]

    def _whole(self, text: str) -> list[tuple[str, int]]:
        """A text outside the plain range: control strings split off, the library's normaliser and pre-tokenizer."""
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        parts = re.split("(" + "|".join(map(re.escape, self.control)) + ")", text) if self.control else [text]
        out = []
        for part in parts:
            if part in self.control:
                out.append((str(self.control[part]), 1))
            elif part:
                pieces = self._lib.pre_tokenizer.pre_tokenize_str(self._lib.normalizer.normalize_str(part))
                out += self._codes([[w for w, _ in pieces]])
        return out

    def block(self, texts: list[str | None]) -> list[tuple[list[str], int]]:
        """For each text its ids, as groups of space-joined ids in order, and the number of ids."""
        texts = [t or "" for t in texts]
        easy = [plain(t) for t in texts]
        fast = iter(self.chunks.block([t for t, e in zip(texts, easy) if e]))
        codes = [next(fast) if e else self._whole(t) for t, e in zip(texts, easy)]
        return [([c[0] for c in found if c[1]], sum([c[1] for c in found])) for found in codes]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder, so tokens are joined by spaces; ids outside it are skipped."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def decode_groups(self, groups: list[str]) -> str:
        """`decode` of all the groups' ids in a row."""
        if len(self.decoded) > MEMO:
            self.decoded.clear()
        return " ".join(map(self.decoded.__getitem__, groups))


class _Decoded(dict):
    """Space-joined ids -> decoded text."""

    def __init__(self, strings: dict[int, str]):
        self.strings = strings

    def __missing__(self, group: str) -> str:
        found = self[group] = " ".join([self.strings[int(i)] for i in group.split()])
        return found


_WORKER: dict[str, TrieBpe] = {}


def worker(path: str) -> TrieBpe:
    if path not in _WORKER:
        _WORKER[path] = TrieBpe(path)
    return _WORKER[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded text of every whole text."""

    def run(blocks):
        bpe = worker(path)
        for ids, texts in blocks:
            codes = bpe.block(texts)
            yield {"doc_id": ids, "ids": [[int(x) for g in groups for x in g.split()] for groups, _ in codes], "decoded": [bpe.decode_groups(groups) for groups, _ in codes]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, decoded string", 256)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text: `encode_documents` without carrying either."""

    def run(blocks):
        bpe, hexed = worker(path), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for ids, texts in blocks:
            codes = bpe.block(texts)
            yield {
                "doc_id": ids,
                "n_tokens": [n for _, n in codes],
                "ids_sha256": [hexed(" ".join(groups)) for groups, _ in codes],
                "decoded_sha256": [hexed(bpe.decode_groups(groups)) for groups, _ in codes],
            }

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 256)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary_path())
