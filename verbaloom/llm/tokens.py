"""Word-level BPE ids with a bounded cache of pre-tokens (one per worker process)."""

from __future__ import annotations

import re

#: Characters whose lower-casing and normalisation are plain, and which the tokenizer splits as ``_SPLIT`` does.
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*", re.ASCII)
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
_SLOT = re.compile(r"[\t-\r ]*(?:'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+)")
_SPACED = re.compile(r"[\t-\r ]*[^\t-\r ]+")
_SPACE = re.compile(r"[\t-\r ]+")
#: Entries of the cache; it is emptied beyond that.
CACHE_ENTRIES = 400_000

_LOADED: dict[str, "WordBpe"] = {}


def word_bpe(path: str) -> "WordBpe":
    """The tokenizer at ``path``, loaded once for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


class WordBpe:
    """Ids of a lower-casing word BPE file, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    White space always separates pre-tokens there, so ids of a text are those of its pre-tokens in order. Only
    pre-tokens that are not in the cache reach the tokenizer; words with unusual characters reach it whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens, lower-cased; a word with unusual characters or a special token stays one, as it is."""
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _SPLIT.findall(text.lower())
        out: list[str] = []
        for word in _SPACE.split(text):
            if word and ("<|" in word or not _PLAIN.fullmatch(word)):
                out.append(word)
            else:
                out.extend(_SPLIT.findall(word.lower()))
        return out

    def slots(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens as ``split`` gives them, and the characters of each with the white space before it.

        White space at the end is left out.
        """
        if "<|" not in text and _PLAIN.fullmatch(text):
            low = text.lower()
            return _SPLIT.findall(low), list(map(len, _SLOT.findall(low)))
        keys: list[str] = []
        sizes: list[int] = []
        for spaced in _SPACED.findall(text):
            word = spaced.lstrip("\t\n\v\f\r ")
            if "<|" in word or not _PLAIN.fullmatch(word):
                keys.append(word)
                sizes.append(len(spaced))
            else:
                own = _SPLIT.findall(word.lower())
                keys.extend(own)
                sizes.extend(map(len, own))
                sizes[-len(own)] += len(spaced) - len(word)
        return keys, sizes

    def learn(self, lists: list[list[str]]) -> dict[str, bytes]:
        """The cache, with every pre-token of the lists in it."""
        new = set().union(*lists).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE_ENTRIES:
                self.cache.clear()
                new = set().union(*lists)
            words = list(new)
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.cache[w] = b"".join([x.to_bytes(4, "little") for x in e.ids])
        return self.cache

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text (null: empty) its ids as little-endian unsigned 32-bit integers."""
        lists = [self.split(t) if t else [] for t in texts]
        get = self.learn(lists).__getitem__
        return [b"".join(map(get, x)) for x in lists]
