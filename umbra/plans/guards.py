"""What a text must hold for a pattern to match in it at all: literals that are looked for before the pattern is tried.

Every match of a pattern holds at least one literal of its set, without regard to case. Most lines hold none of a rule's
literals, so most rules are never tried on them, and the result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

import numpy as np

#: Letters that match an ASCII letter without regard to case, but aren't lower-cased to it.
ODD = "ſİı"


def _least(items) -> frozenset[str] | None:
    """The most telling set that a sequence of parsed items asks for: its shortest literal is the longest."""
    offers, run = [], ""
    for kind, arg in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(arg).lower()
            continue
        offers, run = [*offers, frozenset([run])] if run else offers, ""
        inner = None
        if kind is op.SUBPATTERN:
            inner = _least(arg[3])
        elif kind is op.ATOMIC_GROUP:
            inner = _least(arg)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0]:
            inner = _least(arg[2])
        elif kind is op.BRANCH:
            parts = [_least(b) for b in arg[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        offers += [inner] if inner else []
    return max(offers, key=lambda s: (min(map(len, s)), -len(s)), default=None)


@lru_cache(None)
def needs(pattern: re.Pattern) -> frozenset[str] | None:
    """Lower-case literals of which every match holds one; None if nothing can be told."""
    return _least(parser.parse(pattern.pattern, pattern.flags))


class Literals:
    """All literals of all groups, looked for in a text at once: in a longer text, only those whose triples it holds."""

    LONG = 400

    def __init__(self) -> None:
        self.known: dict[str, None] = {}
        self.built = 0

    def add(self, literals: Iterable[str]) -> None:
        self.known.update(dict.fromkeys(literals))

    @staticmethod
    def _triples(data: np.ndarray) -> np.ndarray:
        """A 16-bit number for each three bytes in a row; equal ones have equal numbers."""
        wide = data.astype(np.uint16)
        return wide[:-2] * np.uint16(40503) ^ wide[1:-1] * np.uint16(257) ^ wide[2:]

    def _build(self) -> None:
        self.short = [x for x in self.known if len(x.encode()) < 3]
        self.long = [x for x in self.known if len(x.encode()) >= 3]
        numbers = [self._triples(np.frombuffer(x.encode(), np.uint8)) for x in self.long]
        self.numbers = np.array([np.resize(n, max(map(len, numbers), default=0)) for n in numbers])
        self.built = len(self.known)

    def held(self, low: str) -> set[str]:
        """The literals in a text, which is given in lower case."""
        if len(low) < self.LONG:
            return {x for x in self.known if x in low}
        if self.built != len(self.known):
            self._build()
        seen = np.zeros(1 << 16, bool)
        seen[self._triples(np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8))] = True
        likely = [self.long[i] for i in np.flatnonzero(seen[self.numbers].all(axis=1)).tolist()] if self.long else []
        return {x for x in (*self.short, *likely) if x in low}


LITERALS = Literals()


class Group:
    """Items with a pattern each (None: always likely) whose literals are looked for once a text, with those of all groups."""

    KEPT = 4096

    def __init__(self, items: Iterable, pattern: Callable = lambda x: x):
        self.items, masks = tuple(items), {}
        for i, x in enumerate(self.items):
            for literal in ((p := pattern(x)) is not None and needs(p)) or ("",):
                masks[literal] = masks.get(literal, 0) | 1 << i
        self.always = masks.pop("", 0)
        self.masks, self.picked, self.places = tuple(masks.items()), {}, {id(x): i for i, x in enumerate(self.items)}
        LITERALS.add(masks)

    def likely(self, held: set[str] | str) -> tuple:
        """The items that may match in a text, of which the held literals are given, or all in lower case; in their order."""
        mask = self.always
        for literal, m in self.masks:
            if literal in held:
                mask |= m
        found = self.picked.get(mask)
        if found is None:
            if len(self.picked) >= self.KEPT:
                self.picked.clear()
            found = self.picked[mask] = tuple(x for i, x in enumerate(self.items) if mask >> i & 1)
        return found


    def after(self, present: Present, item: object = None) -> tuple:
        """The items after one of them, or all, that may match in a line."""
        at = -1 if item is None else self.places[id(item)]
        return tuple(x for x in (self.items if present.any else self.likely(present.low)) if self.places[id(x)] > at)


class Present:
    """The patterns that may match in a text."""

    def __init__(self, text: str):
        self.text, self.low, self.known, self.hinted = text, text.lower(), {}, {}
        self.any = not text.isascii() and any(c in text for c in ODD)
        self.all = 0  # literals that there were when they were looked for

    def may(self, pattern: re.Pattern) -> bool:
        if self.any:
            return True
        found = self.known.get(pattern)
        if found is None:
            wanted = needs(pattern)
            found = self.known[pattern] = wanted is None or any(x in self.low for x in wanted)
        return found

    def among(self, group: Group) -> tuple:
        """The items of a group that may match."""
        if self.any:
            return group.items
        if self.all != len(LITERALS.known):
            self.all, self.held = len(LITERALS.known), LITERALS.held(self.low)
        return group.likely(self.held)

    def hints(self, *patterns: re.Pattern) -> list[bool]:
        """Whether the text holds a match of each of the patterns."""
        out = []
        for p in patterns:
            if id(p) not in self.hinted:
                self.hinted[id(p)] = p.search(self.text) is not None
            out.append(self.hinted[id(p)])
        return out


class Anything:
    """Tells nothing: every pattern may match."""

    text = low = ""

    def may(self, pattern: re.Pattern) -> bool:
        return True

    def among(self, group: Group) -> tuple:
        return group.items

    def hints(self, *patterns: re.Pattern) -> list[bool]:
        return [True] * len(patterns)


ANYTHING = Anything()
