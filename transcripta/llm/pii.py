"""Personal data: regular expressions propose, checksums confirm, context decides.

Proposals: e-mail, IPv4, payment card, phone (the base kinds), IBAN, social
security number and secret (the method's own: a run of 20 characters or more with
letters and digits, which counts only near words such as token or password).  Cards must pass Luhn, IBANs mod 97; the
confirmed ones start at a high score.  Kinds without a checksum start lower and
are raised or lowered by words near the span.  Base spans are always kept, with
their score; own spans only with a score of ``least_score`` or more, and not
inside a base span.

Null and empty texts have no spans.  Rows are treated one by one, so ties,
repeated rows and null ids change nothing; a text is scanned whole, each pattern
from anchors that make it linear in the text's length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9@])")
_DIGITS = re.compile(r"[0-9]")
_ONLY_DIGITS = re.compile(r"[^0-9]+")

# Characters of an IBAN by country, as the registry has them.
_IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        ("15", "NO"), ("16", "BE"), ("18", "DK FI FO GL NL SD"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU XK"), ("21", "CH HR LI LV"), ("22", "BG BH CR DE GB GE IE ME RS VA"),
        ("23", "AE GI IL IQ TL"), ("24", "AD CZ ES MD PK RO SA SE SK TN VG"), ("25", "LY PT ST"), ("26", "IS TR"), ("27", "FR GR IT MC MR SM"),
        ("28", "AL AZ BY CY DO GT HU LB PL"), ("29", "BR EG PS QA UA"), ("30", "JO KW MU"), ("31", "MT SC"), ("32", "LC"),
    )
    for country in countries.split()
}
_IBAN_RESTS = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*_IBAN_LENGTHS.values()}}

#: Characters on either side in which context words count.
CONTEXT = 40
_HINTS = {
    "email": re.compile(r"mail|contact|write|courriel|correo|kontakt", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|pay|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "secret": re.compile(r"secret|token|passw|api.?key|credential|auth|private.?key", re.I),
}
_AGAINST = re.compile(r"version|isbn|order no|invoice no|part no|example", re.I)
#: Score of a proposal that its checksum, if it has one, has confirmed.
_START = {"email": 0.8, "ip": 0.5, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "secret": 0.35}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        after = at + 1
        if begin < at and (domain := _DOMAIN.match(text, after)):
            last = after = domain.end()
            yield begin, last
        at = text.find("@", after)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        # compared as text: a part may have more digits than an integer parses
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = _ONLY_DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_ONLY_DIGITS.sub("", m[0])) <= 15:
                yield "phone", *m.span()


def own_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        # a country's IBANs have one length, so words after them don't belong to them
        rest = m[1] in _IBAN_LENGTHS and _IBAN_RESTS[_IBAN_LENGTHS[m[1]]].match(text, m.end())
        if rest and mod97(f"{m[0]}{rest[0]}".replace(" ", "")):
            yield "iban", m.start(), rest.end()
    yield from (("ssn", *m.span()) for m in _SSN.finditer(text))
    yield from (("secret", *m.span()) for m in _SECRET.finditer(text))


def score(text: str, kind: str, begin: int, end: int) -> float:
    near = f"{text[max(0, begin - CONTEXT) : begin]} {text[end : end + CONTEXT]}"
    value = _START[kind] + 0.3 * bool(_HINTS[kind].search(near)) - 0.3 * bool(_AGAINST.search(near))
    return min(1.0, max(0.0, value))


def _order(span: tuple) -> tuple[int, int]:
    return KINDS.index(span[0]), span[1]


def spans(text: str, least_score: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, all spans with scores), each in order of kind and start."""
    base = sorted(base_spans(text), key=_order)
    found = [(*s, score(text, *s)) for s in base]
    if _DIGITS.search(text):
        taken = sorted((a, b) for _, a, b in base)
        starts, furthest = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
        for s in own_spans(text):
            if furthest[bisect.bisect_left(starts, s[2])] <= s[1] and (value := score(text, *s)) >= least_score:
                found.append((*s, value))
    return base, sorted(found, key=_order)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scanned(batches: Iterator[pa.RecordBatch], least_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, every = [], [], []
        for text in batch.column(1):
            base, found = spans(text.as_py() or "", least_score)
            kinds = [s[0] for s in base]
            counts.append([kinds.count(k) for k in BASE_KINDS])
            digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
            every.append([{"kind": k, "begin": a, "end": b, "score": v} for k, a, b, v in found])
        columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(every, _FOUND)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "found"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.6) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, found) of each row.

    ``found`` holds kind, begin, end (code points, end exclusive) and score of
    each span, by kind and start.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    schema = f"id {id_type}, {counts}, base_sha256 string, found array<struct<kind:string,begin:bigint,end:bigint,score:double>>"
    return rows.mapInArrow(partial(tidy, _scanned, least_score=least_score), schema).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", least_score: float = 0.6) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; null stays null."""

    def masked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for value in batch:
                text = value.as_py()
                if text is not None:
                    parts, last = [], 0
                    for kind, begin, end, _ in sorted(spans(text, least_score)[1], key=lambda s: (s[1], -s[2])):
                        if begin >= last:
                            parts += [text[last:begin], f"<{kind}>"]
                            last = end
                    text = "".join([*parts, text[last:]])
                out.append(text)
            yield pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(masked, "string")(F.col(text_col)))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report with ``spans``, their ``scores`` and ``n_spans`` instead of ``found``."""
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", joined.alias("spans"), scores.alias("scores"), F.size("found").cast("long").alias("n_spans"))
