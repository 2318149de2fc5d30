"""Splitting text into pre-tokens as the public tokenizer files define it, and a bounded cache of what was computed for each."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

#: Entries that a worker keeps, and their bytes, pre-tokens and values together; beyond that it starts anew. About 200 bytes an entry besides.
CACHE_ENTRIES, CACHE_BYTES = 500_000, 64 << 20
#: Characters of the longest pre-token that is kept.
CACHE_WORD = 1 << 12


class Cache(dict):
    """pre-token -> value (bytes). ``fill`` computes missing ones together, ``trim`` starts anew where there are too many; what is asked for alone is computed alone."""

    def __init__(self, compute: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE_ENTRIES, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self.compute, self.limit, self.most_bytes, self.bytes = compute, limit, most_bytes, 0

    def __missing__(self, word: str) -> bytes:
        (value,) = self.compute([word])
        if len(word) <= CACHE_WORD:
            self[word] = value
            self.bytes += len(word) + len(value)
        return value

    def trim(self) -> None:
        """An empty cache if it has grown beyond a bound."""
        if len(self) > self.limit or self.bytes > self.most_bytes:
            self.clear()
            self.bytes = 0

    def fill(self, wanted: set[str]) -> None:
        """Has all of ``wanted`` but the longest."""
        self.trim()
        if missing := [w for w in wanted.difference(self) if len(w) <= CACHE_WORD]:
            values = list(self.compute(missing))
            self.update(zip(missing, values, strict=True))
            self.bytes += sum(map(len, missing)) + sum(map(len, values))


@functools.lru_cache
def byte_pattern():
    """The byte-level pre-token pattern, compiled."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@functools.lru_cache
def word_finder() -> Callable[[str], list[str]]:
    """Text -> its byte-level pre-tokens. ASCII text takes the same pattern with its classes spelt out, which is twice as fast."""
    import re

    full = byte_pattern().findall
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+").findall
    return lambda text: plain(text) if text.isascii() else full(text)


@functools.lru_cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@functools.lru_cache
def byte_table() -> dict[int, str]:
    """For str.translate on text decoded as Latin-1."""
    return dict(enumerate(byte_letters()))


def lettered(word: str) -> str:
    """A pre-token's UTF-8 bytes as byte-level letters."""
    return word.encode().decode("latin-1").translate(byte_table())
