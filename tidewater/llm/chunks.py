"""Texts as chunks that tokenizers treat apart, and a bounded memory of them.

Byte-level BPE with the usual splitting pattern never joins anything across a
blank (0x20) that a character other than white space follows.  So a text can
be cut before each such blank, each different chunk encoded once, and the ids
put together.  Words repeat, so few chunks are new.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_ODD = re.compile(r" (?=\s)| \Z")
_CUT = re.compile(r" (?=\S)")
#: Longer chunks are encoded each time.  Two tables of so many entries at most
#: remember the others: when the newer is full it becomes the older, and the
#: entries of the older that were not used since are forgotten.
LONGEST = 64
ENTRIES = 150_000


def split(text: str) -> list[str]:
    """The chunks of a text; joined they are the text."""
    if not _ODD.search(text):
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + r for r in rest]
    cuts = [m.start() for m in _CUT.finditer(text)]
    ends = cuts + [len(text)]
    out = [text[a:b] for a, b in zip([0] + cuts, ends)]
    return [c for c in out if c]


class Memory:
    """chunk -> bytes, by a function that encodes a list of chunks."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = ENTRIES) -> None:
        self.encode, self.entries = encode, entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, texts: list[list[str]]) -> list[bytes]:
        """Per text (a list of chunks): the chunks' values, joined."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        new = set().union(*texts).difference(known)
        for c in [c for c in new if c in old]:
            known[c] = old[c]
            new.remove(c)
        new = list(new)
        long = {}
        for c, v in zip(new, self.encode(new)):
            (known if len(c) <= LONGEST else long)[c] = v
        if long:
            known = known | long
        return [b"".join([known[c] for c in chunks]) for chunks in texts]


def in_groups(texts: list[str | None], chars: int = 1 << 18) -> list[list[str]]:
    """Consecutive texts of about so many characters together (null: empty)."""
    out, size = [], chars
    for t in texts:
        if size >= chars:
            out.append([])
            size = 0
        out[-1].append(t or "")
        size += len(t or "") + 1
    return out
