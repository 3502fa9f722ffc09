"""Token ids of a public word-level BPE vocabulary, with a cache of ids by word.

The vocabulary normalises (NFC, white space runs to one space, lower case), drops
white space and splits into words before the merges, so the ids of a text are the ids
of its words in order. Texts made only of characters whose normalisation is certain
are cut into words here and looked up; all other texts go to the tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np

from .common import held

#: ASCII without control characters (but tab, line feed, carriage return), Latin-1 and
#: Latin Extended-A without the dotted capital I, and common punctuation.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž‐-‧‰-⁞€]*")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ž"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t\n\r \\u2028{_LETTER}{_NUMBER}]+")
CACHE_WORDS = 700_000
#: Longer words are not held.
CACHE_LENGTH = 64


class Encoder(dict):
    """Maps a word to its ids as little-endian 32-bit bytes; grows as words come, up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = np.asarray(ids, "<u4").tobytes()
        if len(word) <= CACHE_LENGTH:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit bytes."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _WORD.findall(text.lower())))


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    return held(("encoder", path), lambda: Encoder(path))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
