"""Page cursors and the search box: small text codecs at the edge of the library."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

from .exprs import ZERO_WIDTH

MOST_CURSOR_BYTES = 2048
MOST_QUERY_BYTES = 512
MOST_TERMS = 16


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def session_cursor(started_at: int | None, session_id: str) -> str:
    name = session_id.replace("%", "%25").replace(":", "%3A")
    return f"{'n' if started_at is None else started_at}:{name}"


def read_session_cursor(text: str | None) -> tuple[int | None, str] | None:
    """Time and id; None, the first page, for anything malformed."""
    if not text or len(text.encode()) > MOST_CURSOR_BYTES or text.count(":") != 1:
        return None
    time, name = text.split(":")
    name = name.replace("%3A", ":").replace("%25", "%")
    if not name:
        return None
    if time == "n":
        return None, name
    try:
        return int(time), name
    except ValueError:
        return None


def read_message_cursor(text: str | None) -> int | None:
    try:
        return int(text) if text else None
    except ValueError:
        return None


def search_cursor(rank: float, started_at: int | None, did: int) -> str:
    bits = struct.pack(">d", rank).hex()
    return f"{bits}:{'n' if started_at is None else started_at}:{did}"


def read_search_cursor(text: str | None) -> tuple[float, int | None, int] | None:
    """Rank (to the last bit), time and document; None for anything malformed."""
    parts = (text or "").split(":")
    if len(parts) != 3 or len(parts[0]) != 16:
        return None
    try:
        rank = struct.unpack(">d", bytes.fromhex(parts[0]))[0]
        time = None if parts[1] == "n" else int(parts[1])
        did = int(parts[2])
    except ValueError:
        return None
    return (rank, time, did) if math.isfinite(rank) and did > 0 else None


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    agent: str | None = None
    path: str | None = None
    tool: str | None = None
    has_error: bool = False


def clean_token(text: str) -> str:
    return "".join(c for c in text if c not in ZERO_WIDTH and not ("\x00" <= c <= "\x1f" or "\x7f" <= c <= "\x9f"))


def parse_query(raw: str) -> Query:
    """Words and the filters agent:, path:, tool: and has:error of a search box."""
    query = Query()
    for token in raw.encode()[:MOST_QUERY_BYTES].decode(errors="ignore").split():
        name, mark, value = token.partition(":")
        if mark and name in ("agent", "path", "tool"):
            if cleaned := clean_token(value):
                setattr(query, name, cleaned)
        elif token == "has:error":
            query.has_error = True
        elif len(query.terms) < MOST_TERMS:
            query.terms.append(token)
    query.terms = [cleaned for t in query.terms if (cleaned := clean_token(t))]
    return query
