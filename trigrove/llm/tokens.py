"""Token ids of whole texts with a word cache, equal to the tokenizer's own."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Characters for which cutting into words here is the same as in the tokenizer: no white space but blank, tab
#: and line ends, no digits but 0-9, nothing that normalisation or lower-casing changes in more than one way.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffā-įı-ž"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ž]*\Z")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_CACHE_WORDS = 800_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """Little-endian unsigned 32-bit ids, as bytes, of the lower-casing word BPE; words are encoded once and kept.

    The cache holds at most ``_CACHE_WORDS`` words and is emptied when it is full. Texts with other than plain
    characters, or with the string of a special token, go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        self.inner, self.cache = _tokenizer(path), {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.match(text) or "<|" in text:
            return self._whole(text)
        words = _WORDS.findall(text.lower())
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        new = [w for w in set(words) if w not in cache]
        for w, e in zip(new, self.inner.encode_batch_fast(new, add_special_tokens=False), strict=True):
            cache[w] = np.array(e.ids, dtype="<u4").tobytes()
        return b"".join([cache[w] for w in words])


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its cache outlives a task."""
    return WordTokenizer(path)
