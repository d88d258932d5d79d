"""Encoding by parts: a text is cut where no token can cross, and each different part is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Generic, TypeVar

V = TypeVar("V")
_SPACE = re.compile(r"[ \t\n\r]")


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in slices of about ``size`` characters that end before white space, so that memory stays bounded."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


class SpanCache(Generic[V]):
    """Values of parts, made by ``encode`` for those not seen lately.

    At most ``limit`` parts are held, in two generations: when the younger is full the older is forgotten, and what is
    used again moves back to the younger.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[V]], limit: int = 500_000, longest: int = 64):
        self.encode, self.half, self.longest = encode, limit // 2, longest
        self.known: dict[str, V] = {}
        self.older: dict[str, V] = {}

    def values(self, texts: list[list[str]]) -> list[list[V]]:
        """The values of each list of parts; those not known are made in one call."""
        new: set[str] = set()
        for parts in texts:
            new.update(set(parts).difference(self.known))
        if new:
            if len(self.known) + len(new) > self.half:
                self.older, self.known = self.known, {}
                new = set().union(*texts)
            older = self.older
            self.known.update((p, older[p]) for p in new if p in older)
            if todo := sorted(new.difference(self.known)):
                self.known.update(zip(todo, self.encode(todo)))
        known = self.known
        out = [list(map(known.__getitem__, parts)) for parts in texts]
        for part in new:
            if len(part) > self.longest:
                del known[part]
        return out


def groups(texts: Sequence[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of ``texts`` of about ``size`` characters in all."""
    run: list[str] = []
    n = 0
    for text in texts:
        if run and n + len(text) > size:
            yield run
            run, n = [], 0
        run.append(text)
        n += len(text)
    if run:
        yield run


class Memo(dict):
    """``make(key)`` by key, remembered for short keys in two generations of at most ``limit`` keys in all."""

    def __init__(self, make: Callable[[str], V], limit: int, longest: int = 64, older: Memo | None = None):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, older

    def __missing__(self, key: str) -> V:
        value = self.older.get(key) if self.older is not None else None
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def rotated(self) -> Memo:
        """This one, or its successor where it is full."""
        if 2 * len(self) < self.limit:
            return self
        self.older = None
        return Memo(self.make, self.limit, self.longest, self)
