"""Cutting texts where every pre-token pattern used here begins a new match.

A space that a visible character follows always begins a match of the byte-level
patterns: it goes to the word, number or symbol run after it, and white space before
it is a match of its own. So each such piece is split alone, and as pieces repeat
often ("the", "of"), most of them are looked up instead.
"""

from __future__ import annotations

#: Longer pieces are not kept for a later look-up.
LONG = 80


def cut(text: str) -> list[str]:
    """Pieces of ``text``; each but the first stands for itself with a space before it."""
    pieces = text.split(" ")
    if any(not p or p[0].isspace() for p in set(pieces[1:])):
        merged = [pieces[0]]
        tail: list[str] = []
        for p in pieces[1:]:
            if p and not p[0].isspace():
                if tail:
                    merged[-1] = " ".join([merged[-1], *tail])
                    tail = []
                merged.append(p)
            else:
                tail.append(p)
        if tail:
            merged[-1] = " ".join([merged[-1], *tail])
        pieces = merged
    return pieces


class Recent:
    """At most ``2 * most`` results by key, in two generations: what was not used lately goes."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.now: dict = {}
        self.older: dict = {}

    def age(self) -> None:
        """Call between slices: a full generation becomes the older one."""
        if len(self.now) > self.most:
            self.older, self.now = self.now, {}

    def absent(self, keys: set) -> list:
        """Keys that must be computed; those of the older generation come back by this."""
        now, older = self.now, self.older
        out = []
        for k in keys.difference(now):
            if k in older:
                now[k] = older[k]
            else:
                out.append(k)
        return out
