"""Cut a text where no token can cross, so that tokenizers run once per distinct chunk.

Both pre-tokenizers used here place a boundary at every single blank or newline that stands between
two characters that are not white space: what precedes cannot take the blank in, and the blank either
opens the next token (byte-level BPE) or is dropped (word BPE).  Such chunks repeat like words do, so a
bounded per-worker cache saves most of the work.  Chunks are never shortened or dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fixed value: the byte-level pre-tokenizer for which these cuts are right.  With another one texts are not cut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)( |\n)(?=\S)")
#: Entries of a cache, and the longest chunk that is kept: a bound of about 150 MB for a worker.
ENTRIES, LONGEST = 600_000, 48


class Cache(dict):
    """chunk -> make(chunk).  When half of ``entries`` is reached they become the old half; what is still in use comes back."""

    def __init__(self, make: Callable, entries: int = ENTRIES):
        super().__init__()
        self.make, self.half, self.old = make, entries // 2, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        if len(chunk) <= LONGEST:
            self.put(chunk, value)
        return value

    def put(self, chunk: str, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[chunk] = value


def simple(chunk: str) -> tuple[str, ...] | None:
    """The pre-tokens of a chunk of Latin letters, maybe with one full stop or comma after them; else None.

    Without U+0130, whose lower case is no letter alone.
    """
    if "\u0130" in chunk:
        return None
    if chunk.isalpha():
        return (chunk,) if max(chunk) < "\u0250" else None
    head, last = chunk[:-1], chunk[-1:]
    if (last == "." or last == ",") and head.isalpha() and max(head) < "\u0250":
        return head, last
    return None


class Chunked:
    """make(text) -> value per chunk.  spaced gets chunks that follow a blank, without that blank.

    Without ``spaced`` white space has no tokens, and blanks and newlines are alike.
    """

    def __init__(self, make: Callable[[str], object], spaced: Callable[[str], object] | None = None, entries: int = ENTRIES):
        self.first, self.rest = Cache(make, entries // 6 if spaced else entries), spaced and Cache(spaced, entries)

    def __call__(self, text: str) -> list:
        if not text:
            return []
        first, rest, out = self.first, self.rest, []
        flat = text.replace("\n", " ")
        # a printable text has no white space but blanks
        if not flat.isprintable() or "  " in flat or flat[0] == " " or flat[-1] == " ":
            parts = _CUT.split(text)
            if rest is None:
                return list(map(first.__getitem__, parts[::2]))
            out.append(first[parts[0]])
            for sep, chunk in zip(parts[1::2], parts[2::2]):
                if sep == " ":
                    out.append(rest[chunk])
                else:
                    out += (first[sep], first[chunk])
            return out
        if rest is None:
            return list(map(first.__getitem__, flat.split(" ")))
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(first["\n"])
            words = line.split(" ")
            out.append(first[words[0]])
            if len(words) > 1:
                out.extend(map(rest.__getitem__, words[1:]))
        return out
