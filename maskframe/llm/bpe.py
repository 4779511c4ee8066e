"""Byte-level BPE ids of whole texts, tokenising each different word once.

The vocabulary's pre-tokeniser never joins a non-space character with white space after it, except that one space may lead a
word. So a text may be cut before any space that follows a non-space, and each part tokenised by itself: the ids are those of
the whole text. Parts are cached in the worker. A text that holds one of the vocabulary's special strings is tokenised as a whole.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain, islice

from maskframe.llm.common import held

#: Parts held in a worker's cache: up to so many new ones, and as many that were new before. 300k parts are about 70 MB.
CACHE_PARTS = 600_000

_AFTER_SPACE = re.compile(r"\s ")
_ASCII_PAIRS = [c + " " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
_CUT = re.compile(r"(?<=\S)(?= )")
#: Longer parts aren't cached.
_LONG_PART = 4096
#: Letters (checked further), then ASCII signs other than an apostrophe.
_SIMPLE = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


def _space_after_space(text: str) -> bool:
    if not text.isascii():
        return _AFTER_SPACE.search(text) is not None
    return any(pair in text for pair in _ASCII_PAIRS)


def parts_of(text: str) -> list[str]:
    """The text before its first cut (maybe empty), then the parts that follow, each without the space that leads it."""
    if not _space_after_space(text):
        return text.split(" ")
    first, *rest = _CUT.split(text)
    return [first, *(p[1:] for p in rest)]


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Parts(dict):
    """Ids by part, found when first asked for. When it is full it starts anew, and what is asked for again is taken over from before, so
    frequent parts stay."""

    def __init__(self, find, limit: int):
        self.find, self.limit, self.before = find, limit, {}

    def __missing__(self, part: str) -> bytes:
        got = self.before.pop(part, None) or self.find(part)
        if len(part) <= _LONG_PART:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[part] = got
        return got


class CachedBPE:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.tokenize = self.tok.model.tokenize
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.line = self._word("", "\n")
        self.bare = _Parts(lambda word: self._word("", word), cache_parts // 10)  # pre-tokens without a space before them, which are few
        self.cache = _Parts(self._part, cache_parts)  # parts after a space

    def _word(self, space: str, word: str) -> bytes:
        """The ids of one pre-token: letters or signs, with at most one space before them."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(self.space + word if space else word)]).tobytes()

    def _part(self, part: str, space: str = " ") -> bytes:
        """Parts made of letters, a run of signs after them, and single line ends are pre-tokens at sight and go straight to the model;
        all others go through the whole tokeniser."""
        if len(part) <= _LONG_PART:
            if part.isalpha():
                if space and part.isascii():
                    return array("I", [t.id for t in self.tokenize(self.space + part)]).tobytes()
                return self._word(space, part)
            found = []
            for i, line in enumerate(part.split("\n")):
                m = _SIMPLE.fullmatch(line)
                if m is None or not m[1].isalpha():
                    break
                if i:
                    found.append(self.line)
                found.append(self.bare[m[1]] if i or not space else self.cache[m[1]])
                if m[2]:
                    found.append(self.bare[m[2]])
            else:
                return b"".join(found)
        return self._whole(space + part)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: none) as 32-bit integers in the machine's order."""
        if not text:
            return b""
        text = _clean(text)
        for s in self.special:
            if s in text:
                return self._whole(text)
        parts = parts_of(text)
        first = self._part(parts[0], "") if parts[0] else b""
        return b"".join(chain((first,), map(self.cache.__getitem__, islice(parts, 1, None))))


def _clean(text: str) -> str:
    """Lone surrogates can't be encoded; they become question marks."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
    return text


def bpe(path: str, cache_parts: int = CACHE_PARTS) -> CachedBPE:
    return held(("bpe", path, cache_parts), lambda: CachedBPE(path, cache_parts))
