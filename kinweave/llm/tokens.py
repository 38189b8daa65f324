"""Token ids of whole texts by a word-level BPE tokenizer file, with words encoded once and remembered; token counts by that
or a file of byte-level ranks."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

import regex
import tiktoken
from tokenizers import Tokenizer

from kinweave.llm.arrow import held

#: Fixed values of the tokenizer format: its word pattern, and the characters that stand for bytes.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = [chr(b) if b in _SHOWN else chr(256 + n) for b, n in zip(range(256), (sum(x not in _SHOWN for x in range(b)) for b in range(256)), strict=True)]

#: Entries in the younger of a cache's two generations; each takes some 150 bytes.
REMEMBERED = 250_000


class Remembered:
    """A cache of two generations: when the younger is full it becomes the older, whose unused entries go with the next turn."""

    def __init__(self):
        self.younger: dict = {}
        self.older: dict = {}

    def turn(self) -> dict:
        if len(self.younger) > REMEMBERED:
            self.older, self.younger = self.younger, {}
        return self.younger


class WordEncoder:
    """Little-endian unsigned 32-bit ids of a text, as the library's encode(add_special_tokens=False) has them: none is added,
    and the name of a special token inside a text is that token.

    White space never joins tokens here, so a text's ids are those of its parts between ASCII white space. A part is encoded
    once while it is remembered. Plain words, with a full stop or comma after them or not, go straight to the model; other
    parts of Latin-1 characters are lower-cased and split by the pattern; any other part goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)), regex.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.parts, self.words = Remembered(), Remembered()

    def _word(self, word: str) -> bytes:
        known = self.words.younger
        if (ids := known.get(word)) is None:
            if (ids := self.words.older.get(word)) is None:
                shown = word if word.isascii() else "".join([BYTE_CHARS[b] for b in word.encode()])
                tokens = self.model.tokenize(shown)
                ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            known[word] = ids
        return ids

    def _part(self, part: bytes) -> bytes:
        if part.isalpha():  # ASCII letters alone
            return self._word(part.lower().decode())
        if part[-1] in b".," and part[:-1].isalpha():
            return self._word(part[:-1].lower().decode()) + self._word(chr(part[-1]))
        text = part.decode()
        plain = self.added is None or not self.added.search(text)
        if plain and max(text) <= "\xff" and min(text) > " " and "\x7f" not in text and not any("\x80" <= c <= "\xa0" for c in text):
            return b"".join([self._word(w) for w in PATTERN.findall(text.lower())])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        parts, known = text.split(), self.parts.turn()
        self.words.turn()
        older = self.parts.older
        for part in set(parts).difference(known):
            known[part] = ids if (ids := older.get(part)) is not None else self._part(part)
        return b"".join(map(known.__getitem__, parts))


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and worker process, kept while tasks ask for it."""
    return held((WordEncoder, path), lambda: WordEncoder(path))


def _ranked(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str) -> Callable[[bytes | None], int]:
    """How many tokens a text has by a tokenizer file: .json as WordEncoder reads it, .tiktoken as ranks of byte strings
    within the parts that `pattern` finds. Names of special tokens are ordinary text for ranks. No text has no tokens."""
    if not path.endswith(".tiktoken"):
        words = encoder(path)
        return lambda text: len(words.encode(text)) // 4
    ranked = held((tiktoken.Encoding, path, pattern), lambda: _ranked(path, pattern))
    return lambda text: len(ranked.encode_ordinary(text.decode())) if text else 0
