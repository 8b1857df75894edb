import random

import pytest
from pyspark.sql import functions as F

from transcripta.functions import folding
from transcripta.functions.cursors import Query
from transcripta.operators import search


@pytest.fixture(scope="module")
def documents(spark):
    words = "alpha beta gamma delta"
    rows = [(k + 1, f"s{k % 5}", "a" if k % 3 else "b", None if k % 4 == 0 else 1000 + k % 6, f"{words[: 5 + k % 12]} Café the-end {'alpha ' * (k % 3)}") for k in range(40)]
    return spark.createDataFrame(rows, "did long, session_id string, agent_id string, started_at long, text string").cache()


@pytest.mark.parametrize("sort", search.SORTS)
def test_pages_together_are_the_whole_order(spark, documents, sort):
    sessions = documents.select(F.col("session_id").alias("id"), F.lit("t").alias("title")).distinct()
    whole = [r.did for r in search.page(search.ranked(documents, ["alpha"]), sort, 200).collect()]
    seen, cursor = [], None
    for _ in range(10):
        page = search.search(documents, sessions, Query(terms=["alpha"]), sort, 9, cursor)
        seen += [r.did for r in page.hits]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == whole and len(set(seen)) == len(seen)


def test_folding_phrases_and_snippets(spark, documents):
    assert search.ranked(documents, ["CAFE"]).count() == 40
    assert search.ranked(documents, ["the-end"]).count() == 40 and search.ranked(documents, ["end-the"]).count() == 0
    assert search.ranked(documents, ["--"]).count() == 0
    text = documents.limit(1).select(search.snippet(F.col("text"), [["cafe"]])).first()[0]
    assert f"{search.MARKS[0]}Café{search.MARKS[1]}" in text


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("мой Первый Ёж", ["мои", "МОЙ", "первый", "еж"]),
        ("나는 한국 사람", ["한국"]),
        ("日本が好き、ガス", ["日本が好き", "カス"]),
        ("Tiếng Việt", ["tieng", "TIẾNG", "viet"]),
        ("naïve Ångström", ["naive", "NAÏVE", "angstrom"]),
        ("ΣΊΣΥΦΟΣ λόγος", ["σισυφος", "ΛΟΓΟΣ"]),
        ("été", ["été", "ete"]),
        ("हिन्दी भाषा", ["हिन्दी"]),
    ],
)
def test_every_script_is_found(spark, text, terms):
    docs = spark.createDataFrame([(1, text), (2, "something else")], "did long, text string")
    for term in terms:
        assert [r.did for r in search.ranked(docs, [term]).collect()] == [1], term


def test_texts_and_queries_are_folded_alike(spark):
    every = [chr(c) for c in range(0x21, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [(k, "".join(every[k : k + 64])) for k in range(0, len(every), 64)]
    got = dict(map(tuple, spark.createDataFrame(rows, "k int, text string").select("k", folding.folded(F.col("text"))).collect()))
    # the two lower-case tables differ in a few letters that one Unicode version has and the other hasn't
    different = sum(got[k] != folding.fold(text) for k, text in rows)
    assert different <= 4


def test_windows_equal_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        phrases = [[rng.choice("abcde") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
        width = rng.randint(1, 8)
        places = search.phrase_places(words, phrases)
        inside = {s: [p for p in places if p[0] >= s and p[1] <= s + width] for s in range(max(0, len(words) - width) + 1)}
        best = max(inside, key=lambda s: (len({p[2] for p in inside[s]}), len(inside[s]), -s))
        assert search.best_window(len(words), places, width) == (best, len({p[2] for p in inside[best]}), len(inside[best]))


def test_snippets_show_texts_as_they_stand():
    a, b = search.MARKS
    assert search.marked_window("x " * 20 + "Ein Café, the END-of it", [["cafe"], ["the", "end"]], 5) == f"…x Ein {a}Café{b}, {a}the END{b}…"
    assert search.marked_window("日本が好き", [["日本か好き"]]) == f"{a}日本が好き{b}"
    assert search.marked_window("a b a b a", [["a", "b", "a"]]) == f"{a}a b a{b} {a}b a{b}"
    assert search.marked_window(None, [["a"]]) == "" and search.marked_window("--", [["a"]]) == ""


def test_ranks_that_show_alike_tie_as_in_sql(spark, tmp_path):
    import duckdb

    from transcripta.plans import catalog

    rows = [(k, "the " + "word " * (900 + k), "en", "src1", 0) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = [r[0] for r in db.sql(catalog.oracle_sql()["search_filter_agent"]).fetchall()]
    assert [r.did for r in catalog.queries()["search_filter_agent"](spark, str(tmp_path)).collect()] == theirs
