"""Full-text search: phrases joined by AND, BM25 ranks, filters, three orders, keyset pages.

A term is a phrase of one or more tokens that must stand next to each other.
Token counts and lengths come from one pass over the documents without a shuffle;
only the few totals that BM25 needs are aggregated.  ``posting_index.Index`` keeps
postings in tables instead, so that a query reads its terms' rows alone.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursors import Query, clamp, read_search_cursor, search_cursor
from ..functions.exprs import after_search, like_prefix
from ..functions.folding import fold, folded
from .scratch import settled, spread

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
MOST_HITS = 200
MARKS = ("\ue000", "\ue001")
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
SORTS = ("relevance", "newest", "oldest")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(folded(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_token(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LN" or kind == "Co"


def phrase_of(term: str) -> list[str]:
    """The tokens of a search term, folded as documents are."""
    return "".join(c if _is_token(c) else " " for c in fold(term)).split()


def _occurrences(words: str, phrase: list[str]) -> Column:
    """How often a phrase stands in the token array."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0])).cast("long")

    def here(word: Column, at: Column) -> Column:
        out = word == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get(F.col(words), at + k) == other, F.lit(False))
        return out

    # the first token is tried for all documents, the rest only where it stands
    return F.when(F.array_contains(words, phrase[0]), F.size(F.filter(words, here)).cast("long")).otherwise(0)


def ranked(docs: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """The documents that hold every term, with their BM25 ``rank`` (lower is better)."""
    phrases = [p for p in map(phrase_of, terms) if p]
    others = [c for c in docs.columns if c != text_col]
    if not phrases:
        return docs.select(*others, F.lit(0.0).alias("rank")).limit(0)
    # generators hold filters back: pushed below, they would cut the texts into tokens once more for each phrase
    words = spread(docs.select(*others, text_col)).select(*others, F.explode(F.array(tokens(F.col(text_col)))).alias("_words"))
    facts = F.struct(F.size("_words").cast("long").alias("_length"), *(_occurrences("_words", p).alias(f"_tf{k}") for k, p in enumerate(phrases)))
    # totals and hits both read these few numbers, and texts are cut once
    counted = settled(words.select(*others, F.inline(F.array(facts))), "search-counted")
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(phrases))))
    hits = counted
    for k in range(len(phrases)):
        hits = hits.where(F.col(f"_tf{k}") > 0)
    return scored(hits.crossJoin(F.broadcast(totals)), len(phrases)).select(*others, "rank")  # totals: one row


def scored(hits: DataFrame, phrases: int) -> DataFrame:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_length") / F.col("_mean"))
    total = F.lit(0.0)
    for k in range(phrases):
        tf, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        total = total + idf * tf * F.lit(K1 + 1) / (tf + norm)
    return hits.withColumn("rank", -total)


def filtered(hits: DataFrame, query: Query, tool_calls: DataFrame | None = None, file_events: DataFrame | None = None) -> DataFrame:
    """The structured filters: an equality, and semi joins on the session."""
    if query.agent:
        hits = hits.where(F.col("agent_id") == query.agent)
    if query.has_error:
        hits = hits.join(tool_calls.where("is_error").select("session_id"), "session_id", "left_semi")
    if query.path:
        hits = hits.join(file_events.where(like_prefix(F.col("path"), query.path)).select("session_id"), "session_id", "left_semi")
    if query.tool:
        hits = hits.join(tool_calls.where(F.col("name") == query.tool).select("session_id"), "session_id", "left_semi")
    return hits


def order_of(sort: str) -> list[Column]:
    if sort == "newest":
        return [F.col("started_at").desc_nulls_last(), F.col("did").asc()]
    if sort == "oldest":
        return [F.col("started_at").asc_nulls_last(), F.col("did").asc()]
    return [F.col("rank").asc(), F.col("started_at").desc_nulls_last(), F.col("did").asc()]


def page(hits: DataFrame, sort: str = "relevance", limit: int = 50, cursor: str | None = None) -> DataFrame:
    """One page of hits (rank, started_at, did, ...) in a total order, after the cursor."""
    sort = sort if sort in SORTS else "relevance"
    after = read_search_cursor(cursor)
    if after:
        hits = hits.where(after_search(sort, F.col("rank"), F.col("started_at"), F.col("did"), after))
    return hits.orderBy(*order_of(sort)).limit(clamp(limit, 1, MOST_HITS))


def token_places(text: str) -> list[tuple[int, int, str]]:
    """(from, to, token) of a text as it stands: marks belong to the token that they follow."""
    out, start, made = [], 0, ""
    for at, c in enumerate(text):
        bare = "".join(x for x in fold(c) if _is_token(x))
        if bare:
            start = start if made else at
            made += bare
        elif made and not unicodedata.category(c).startswith("M"):
            out.append((start, at, made))
            made = ""
    return [*out, (start, len(text), made)] if made else out


def phrase_places(words: list[str], phrases: list[list[str]]) -> list[tuple[int, int, int]]:
    """(from, to, phrase) of each place where a phrase stands, in order."""
    found = []
    for k, phrase in enumerate(phrases):
        n = len(phrase)
        found += ((at, at + n, k) for at, word in enumerate(words) if word == phrase[0] and words[at : at + n] == phrase)
    return sorted(found)


def best_window(words: int, places: list[tuple[int, int, int]], width: int) -> tuple[int, int, int]:
    """(start, distinct phrases, occurrences) of the stretch of ``width`` tokens that holds most whole phrases.

    Ties go to more occurrences, then to the first.  One pass over the places: phrases
    enter as the stretch's end reaches theirs, and leave as its start passes theirs.
    """
    best, last = (0, 0, 0), max(0, words - width)
    places = [p for p in places if p[1] - p[0] <= width]
    ends = sorted(places, key=lambda p: p[1])
    held: dict[int, int] = {}
    entered = left = count = 0
    # a best stretch begins at 0, or ends where a phrase ends
    for start in sorted({0, *(min(last, max(0, p[1] - width)) for p in places)}):
        while entered < len(ends) and ends[entered][1] <= start + width:
            held[ends[entered][2]] = held.get(ends[entered][2], 0) + 1
            entered, count = entered + 1, count + 1
        while left < len(places) and places[left][0] < start:
            phrase = places[left][2]
            held[phrase] -= 1
            count -= 1
            if not held[phrase]:
                del held[phrase]
            left += 1
        if (len(held), count) > best[1:]:
            best = (start, len(held), count)
    return best


def marked_window(text: str | None, phrases: list[list[str]], width: int = 12) -> str:
    """The best stretch of a text as it stands, its phrases marked."""
    tokens_ = token_places(text or "")
    places = phrase_places([t for *_, t in tokens_], phrases)
    start = best_window(len(tokens_), places, width)[0]
    shown = tokens_[start : start + width]
    if not shown:
        return ""
    at, out, until = shown[0][0], "", start
    for low, high, _ in places:
        # phrases that overlap share one pair of marks a piece
        low = max(low, until)
        if low < start or high > start + len(shown) or low >= high:
            continue
        out += text[at : tokens_[low][0]] + MARKS[0] + text[tokens_[low][0] : tokens_[high - 1][1]] + MARKS[1]
        at, until = tokens_[high - 1][1], high
    out += text[at : shown[-1][1]]
    return ("…" if start else "") + out + ("…" if start + width < len(tokens_) else "")


def window_of(text: Column, phrases: list[list[str]], words: int = 12) -> Column:
    """Where the best stretch begins, how many distinct phrases it holds, and how many places."""

    @F.pandas_udf("start bigint, phrases bigint, occurrences bigint")
    def found(texts: pd.Series) -> pd.DataFrame:
        cut = ([t for *_, t in token_places(x or "")] for x in texts)
        rows = [best_window(len(tokens_), phrase_places(tokens_, phrases), words) for tokens_ in cut]
        return pd.DataFrame(rows, columns=["start", "phrases", "occurrences"])

    return found(text)


def snippet(text: Column, phrases: list[list[str]], words: int = 12) -> Column:
    """The stretch of ``words`` tokens with the most distinct phrases, marked; for the rows of a page."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: marked_window(x, phrases, words))

    return cut(text)


@dataclass
class Page:
    hits: list
    next_cursor: str | None


def search(documents: DataFrame, sessions: DataFrame, query: Query, sort: str = "relevance", limit: int = 50, cursor: str | None = None, tool_calls: DataFrame | None = None, file_events: DataFrame | None = None) -> Page:
    """A page of search hits with titles and snippets, and the cursor of the next.

    Ranks and filters come first; titles and texts join the page's rows alone.
    """
    limit = clamp(limit, 1, MOST_HITS)
    phrases = [p for p in map(phrase_of, query.terms) if p]
    if not phrases:
        return Page([], None)
    hits = filtered(ranked(documents, query.terms), query, tool_calls, file_events)
    shown = page(hits, sort, limit, cursor)
    # a page has MOST_HITS rows at most
    joined = F.broadcast(shown).join(documents.select("did", "text"), "did").join(sessions.select(F.col("id").alias("session_id"), "title"), "session_id")
    rows = joined.withColumn("snippet", snippet(F.col("text"), phrases)).drop("text").orderBy(*order_of(sort)).collect()
    full = len(rows) == limit
    return Page(rows, search_cursor(rows[-1]["rank"], rows[-1]["started_at"], rows[-1]["did"]) if full else None)


def idf(documents: int, holding: int) -> float:
    return max(math.log((documents - holding + 0.5) / (holding + 0.5)), LEAST_IDF)


def best_by_id(hits: DataFrame, id_col: str, score_col: str) -> DataFrame:
    """One row for each id, that of the best (lowest) rank."""
    first = Window.partitionBy(id_col).orderBy(score_col)
    return hits.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
