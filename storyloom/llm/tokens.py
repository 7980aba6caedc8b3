"""Text to token ids, word by word.

Encoding is local to a pre-token, and a pre-token never spans white space, so a text's ids are those of its
white-space-delimited chunks in a row. Chunks repeat, so each worker keeps the codes of recent chunks and encodes only
new ones. Texts outside the plain range (characters from U+0250 on, the few below that
whose lower-casing or white-space class depends on more than the character, and texts that hold the tokenizer's own
control strings) go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

DEFAULT = "word_bpe_49k.json"
MEMO = 400_000  # chunks kept by a worker; when full it starts anew
IDS_MEMO = 1_250_000  # the same where a chunk is kept with its ids alone: about 150 bytes each

#: Not plain: separators that only some libraries call white space, dotted capital I, all from U+0250 on.
_NOT_PLAIN = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")
_ODD_ASCII = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path(name or DEFAULT)


def plain(text: str) -> bool:
    return (text.isascii() and not _ODD_ASCII.search(text) or not text.isascii() and not _NOT_PLAIN.search(text)) and "<|" not in text


def byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return out


def word_pattern(top: int = 0x250) -> re.Pattern:
    """The vocabulary's pre-token pattern over lower-cased chunks without white space, for code points below `top`."""
    cls = lambda c: "".join(re.escape(chr(i)) for i in range(top) if unicodedata.category(chr(i))[0] == c)
    letters, numbers = cls("L"), cls("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")


class ChunkCodes:
    """A bounded memo of chunk -> code, filled a block at a time by `encode_new(list of chunks) -> list of codes`."""

    def __init__(self, encode_new: Callable[[list[str]], Iterable]):
        self.encode_new, self.memo = encode_new, {}

    def block(self, texts: list[str]) -> list[list]:
        """For each plain text the codes of its chunks, in order."""
        split = [t.lower().split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set(chain.from_iterable(split)).difference(self.memo))
        self.memo.update(zip(new, self.encode_new(new)))
        of = self.memo.__getitem__
        return [list(map(of, chunks)) for chunks in split]


class _Chunks(dict):
    """Chunk -> ids, as bytes; a missing one is encoded word by word. A word is a chunk, too."""

    def __init__(self, words: re.Pattern, model):
        self.find, self.tokenize, self.alphabet = words.findall, model.tokenize, byte_alphabet()
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(65)]

    def __missing__(self, chunk: str) -> bytes:
        words = (chunk,) if chunk.isalpha() else self.find(chunk)
        if len(words) == 1 and words[0] == chunk:
            mapped = chunk if chunk.isascii() else "".join([self.alphabet[b] for b in chunk.encode()])
            found = [t.id for t in self.tokenize(mapped)]
            ids = self.pack[len(found)](*found) if len(found) < 65 else np.array(found, "<u4").tobytes()
        else:
            ids = b"".join([self[w] for w in words])
        self[chunk] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, by the tokenizers library.

    The library's model encodes each new pre-token of plain texts; its whole pipeline encodes the other texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.chunks = _Chunks(word_pattern(), self.lib.model)

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str | None) -> bytes:
        """The ids of a text, as bytes; a null text has none."""
        if not text:
            return b""
        return b"".join(map(self.chunks.__getitem__, text.lower().split())) if plain(text) else self._whole(text)

    def block(self, texts: list[str | None]) -> list[bytes]:
        if len(self.chunks) > IDS_MEMO:
            self.chunks.clear()
        return [self.text(t) for t in texts]


_WORKER: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]
