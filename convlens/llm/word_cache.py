"""Tokenizing word by word with a bounded cache.

Both tokenizers here never form a token across a space that follows a
non-space, so a text falls into units, each one leading space (except the
first) and the characters up to the next such place.  Natural text repeats its
units, so each distinct unit is given to the tokenizer library once per worker
and the text's ids are joined from the cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: Characters of texts whose units are held at once.
GROUP_CHARS = 1_000_000
#: Units at which a worker begins its cache anew (a group's units come on top), and the longest one kept.
CACHE_UNITS, CACHE_UNIT_CHARS = 750_000, 40

_ASCII_SPACES = [c + " " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"]
_OTHER_SPACE = re.compile("[\x85\xa0  -     　] ")
_CUT = re.compile(r"(?<=\S) ")


def split_units(text: str) -> list[str]:
    """The units, each without the one space at which the text was cut."""
    if any(s in text for s in _ASCII_SPACES) or (not text.isascii() and _OTHER_SPACE.search(text)):
        return _CUT.split(text)
    return text.split(" ")


class UnitEncoder:
    """``encode(units)`` gives the packed ids (``bytes``) of strings; it must be a pure function."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], first: str, rest: str,
                 split: Callable[[str], list[str]] = split_units, most: int = CACHE_UNITS):
        """``first``/``rest``: what to put before the first and before each later unit; ``most``: units kept."""
        self._encode, self._prefix, self._split, self._most = encode, (first, rest), split, most
        self._kept: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {}) if first != rest else ((d := {}), d)

    def _learn(self, k: int, units: set[str]) -> list[str]:
        """Put the ids of all ``units`` into the cache; those too long to stay are returned."""
        kept = self._kept[k]
        missing = list(units.difference(kept))
        if missing:
            kept.update(zip(missing, self._encode([self._prefix[k] + u for u in missing])))
        return [u for u in missing if len(u) > CACHE_UNIT_CHARS]

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self._split(text))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[bytes]:
        if not group:
            return
        for kept in self._kept:
            if len(kept) >= self._most:
                kept.clear()
        rest: set[str] = set()
        for units in group:
            rest.update(units[1:])
        # a group's units are all in the cache while its texts are joined, so that the lookups run in C
        long = [self._learn(0, {units[0] for units in group}), self._learn(1, rest)]
        del rest
        head, tail = (kept.__getitem__ for kept in self._kept)
        for units in group:
            first = head(units[0])
            yield first if len(units) == 1 else first + b"".join(map(tail, units[1:]))
        for kept, gone in zip(self._kept, long):
            for u in gone:
                kept.pop(u, None)
