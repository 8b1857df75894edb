"""Scalar functions of the archive as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width characters that names and paths lose.
ZERO_WIDTH = "\ufeff\u200b\u200c\u200d\u2060"
_MASK = 0xFFFFFFFF
#: 0xCBF29CE484222325 as a signed long.
_FNV_START = 0xCBF29CE484222325 - (1 << 64)


def fnv1a_hex(text: Column) -> Column:
    """FNV-1a-64 of the UTF-8 bytes, as 16 hex digits; null for null.

    The text stands in the expression once, outside all lambdas: a hash of hashes
    would otherwise work each inner one out again for every byte of the outer one.
    """
    # Latin-1 has one character for each byte; "" splits into one empty string
    letters = F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
    values = F.transform(letters, lambda c: F.ascii(c).cast("long"))

    def stepped(state: Column, value: Column) -> Column:
        # by 32-bit halves, which don't overflow under ANSI; the prime is 2**40 + 435
        last = state.bitwiseXOR(value).bitwiseAND(F.lit(_MASK))
        low = last * 435
        high = F.shiftrightunsigned(state, 32) * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(last, 8)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_MASK)))

    return F.aggregate(values, F.lit(_FNV_START), stepped, lambda state: F.lower(F.lpad(F.hex(state), 16, "0")))


def det_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the hash of the parts, joined by the unit separator."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), fnv1a_hex(joined))


def job_id(agent: Column, path: Column) -> Column:
    return det_id("ingest", agent, path)


def content_hash(text: Column) -> Column:
    """Byte length (16 hex digits) and SHA-256 of a text: equal only for equal content."""
    raw = F.encode(text, "UTF-8")
    return F.concat(F.lpad(F.lower(F.hex(F.octet_length(raw))), 16, "0"), F.sha2(raw, 256))


_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def epoch_ms(text: Column) -> Column:
    """RFC 3339 to epoch milliseconds; null for anything else."""
    trimmed = F.trim(text)
    # Spark reads six digits of a fraction; milliseconds need three
    short = F.upper(F.regexp_replace(trimmed, r"(\.\d{1,6})\d*", "$1"))
    return F.when(trimmed.rlike(_RFC3339), F.unix_millis(F.try_to_timestamp(short)))


def sanitized_path(raw: Column) -> Column:
    """A clean relative path: no drives, control or zero-width characters, no escapes."""
    parts = F.transform(F.split(raw, r"[/\\]", -1), lambda s: F.when(s.rlike(r"^[A-Za-z]:$"), "").otherwise(F.regexp_replace(s, f"[\\p{{Cc}}{ZERO_WIDTH}]", "")))

    def walked(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walked), "/")


def stem_of(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized_remote(raw: Column) -> Column:
    """host/path of a Git remote, without credentials, default ports and ``.git``; null if none."""

    def cut(url: Column) -> Column:
        by_scp = ~url.contains("://") & url.contains(":")
        rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(url)
        return _once(rest, lambda rest: named(url, F.when(by_scp, F.regexp_extract(rest, r"(?s)^(.*?):", 1)).otherwise(F.regexp_extract(rest, r"(?s)^([^/]*)", 1)), F.when(by_scp, F.regexp_extract(rest, r"(?s)^.*?:(.*)$", 1)).otherwise(F.regexp_extract(rest, r"(?s)^[^/]*/(.*)$", 1))))

    def named(url: Column, authority: Column, path: Column) -> Column:
        host = F.regexp_replace(ascii_lower(F.regexp_replace(authority, r"(?s)^.*@", "")), r":(22|80|443|9418)$", "")
        path = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.git$", "")
        return _once(F.struct(host.alias("host"), path.alias("path")), lambda x: shown(url, x["host"], x["path"]))

    def shown(url: Column, host: Column, path: Column) -> Column:
        bad = (url == "") | url.rlike(r"[\x00-\x20\x7F]") | (host == "")
        return F.when(url.isNull() | bad, F.lit(None).cast("string")).when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))

    return _once(F.regexp_replace(raw, r"^\s+|\s+$", ""), cut)


# Openings of texts that agents insert, not users.
BOOTSTRAP = ("<permissions instructions>", "# AGENTS.md instructions", "<environment_context>", "<skill>", "<app-context>", "<apps_instructions>", "<plugins_instructions>", "<recommended_plugins>")
REQUEST_MARK = "## My request:"
TITLE_CHARS = 80


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def title_of(text: Column) -> Column:
    """A title from a user's request: its first line that says something; null if none does."""
    whole = _stripped(text)
    asked = F.when(whole.contains(REQUEST_MARK), _stripped(F.regexp_extract(whole, f"(?s)^.*?{REQUEST_MARK}(.*)$", 1))).otherwise(whole)
    lines = F.transform(F.split(asked, "\n", -1), lambda x: _stripped(F.regexp_replace(F.regexp_replace(_stripped(x), r"^#+", ""), r"^[-*]+", "")))
    line = F.get(F.filter(lines, lambda x: (x != "") & ~(x.startswith("<") & x.endswith(">"))), F.lit(0))
    flat = F.regexp_replace(line, r"[\s\p{Z}]+", " ")
    title = F.when(F.length(flat) <= TITLE_CHARS, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, TITLE_CHARS)), F.lit("…")))
    inserted = F.lit(False)
    for opening in BOOTSTRAP:
        inserted = inserted | asked.startswith(opening)
    return F.when(~inserted, title)


def folder_name(name: Column) -> Column:
    """White space collapsed, zero-width characters gone, 100 characters; "New folder" if empty."""
    spaced = F.regexp_replace(name, f"[\\s\\p{{Z}}\\p{{Cc}}{ZERO_WIDTH}]+", " ")
    short = F.trim(F.substring(F.trim(spaced), 1, 100))
    return F.when(F.coalesce(short, F.lit("")) == "", "New folder").otherwise(short)


def bounded(text: Column, chars: int = 40) -> Column:
    return F.substring(text, 1, chars)


def diff_counts(diff: Column) -> Column:
    """(added, removed) lines of a unified diff; null for an empty one."""
    lines = F.filter(F.split(diff, "\n", -1), lambda x: ~x.startswith("+++") & ~x.startswith("---"))

    def starting(mark: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.startswith(mark))).cast("long")

    return F.when(F.length(diff) > 0, F.struct(starting("+").alias("added"), starting("-").alias("removed")))


def sum_or_null(*values: Column) -> Column:
    """The sum of what is there; null if nothing is."""
    return F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, F.lit(0)) for v in values), F.lit(0)).cast("long"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_prefix(column: Column, prefix: str) -> Column:
    """``column LIKE prefix%`` that folds A-Z; ``%`` and ``_`` of the prefix are wildcards."""
    pattern = prefix.translate({c: c + 32 for c in range(65, 91)}).replace("\\", "\\\\")
    return ascii_lower(column).like(f"{pattern}%")


def fence_of(text: Column) -> Column:
    """A Markdown fence longer than any run of backticks in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x)))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


# Keyset predicates: rows strictly after a cursor; null times come last.


def after_newest(time: Column, key: Column, at: int | None, last: str | int) -> Column:
    """For order (time desc nulls last, key desc)."""
    if at is None:
        return time.isNull() & (key < last)
    return time.isNull() | (time < at) | ((time == at) & (key < last))


def after_search(sort: str, rank: Column, time: Column, key: Column, cursor: tuple[float, int | None, int]) -> Column:
    """For the three orders of a search page; the key ascends in all."""
    best, at, last = cursor
    if sort == "relevance":
        tied = time.isNull() & (key > last) if at is None else (time < at) | time.isNull() | ((time == at) & (key > last))
        return (rank > best) | ((rank == best) & tied)
    if at is None:
        return time.isNull() & (key > last)
    later = time < at if sort == "newest" else time > at
    return time.isNull() | later | ((time == at) & (key > last))
