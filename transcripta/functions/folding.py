"""One fold for documents and queries: lower case, no marks.

A character is replaced by its canonical decomposition without marks, composed
again, and marks of their own go; so Cyrillic, Greek, Vietnamese or kana letters meet
their forms without marks, and Hangul syllables stay whole.  The table follows from
the Unicode tables; a final sigma counts as any other.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Planes with letters, and the selectors, which are marks.
_RANGES = (range(0x80, 0xD800), range(0xE000, 0x30000), range(0xE0100, 0xE01F0))


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


@cache
def table() -> dict[str, str]:
    """The characters that change, and what becomes of them."""
    out = {"ς": "σ"}
    for c in (chr(k) for r in _RANGES for k in r):
        if _is_mark(c):
            out[c] = ""
        elif (parts := unicodedata.normalize("NFD", c)) != c:
            bare = unicodedata.normalize("NFC", "".join(p for p in parts if not _is_mark(p)))
            if bare != c:
                out[c] = bare
    return out


@cache
def _matching() -> tuple[str, str]:
    """The same as two strings; characters without a partner in the second go."""
    kept = {a: b for a, b in table().items() if b}
    return "".join(kept) + "".join(a for a, b in table().items() if not b), "".join(kept.values())


def fold(text: str) -> str:
    lowered = text.lower()
    return lowered if lowered.isascii() else lowered.translate(str.maketrans(table()))


def folded(text: Column) -> Column:
    """``fold`` as a column; texts of ASCII alone skip the table."""
    lowered = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), lowered).otherwise(F.translate(lowered, *_matching()))
