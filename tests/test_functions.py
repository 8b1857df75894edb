import pytest
from pyspark.sql import functions as F

from transcripta.functions import exprs
from transcripta.functions.cursors import parse_query, read_message_cursor, read_search_cursor, read_session_cursor, search_cursor, session_cursor


def values(spark, function, *inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r[0] for r in rows.orderBy("k").select(function(F.col("x"))).collect()]


def test_paths(spark):
    got = values(spark, exprs.sanitized_path, "/a//b/./c", "../a/b/../c", "C:\\x\\y", "a/\u200bb\x07/..", None)
    assert got == ["a/b/c", "a/c", "x/y", "a", None]


def test_remotes(spark):
    got = values(spark, exprs.normalized_remote, "git@Host.Example:o/r.git", "ssh://me@host:22/o/r/", "https://u:p@q@host:8443/o/r.git", "host/o", "host", "", "a b", None)
    assert got == ["host.example/o/r", "host/o/r", "host:8443/o/r", "host/o", "host", None, None, None]


def test_a_hash_works_its_text_out_once(spark):
    made = spark.range(1).select(exprs.det_id("e", exprs.det_id("r", F.md5(F.col("id").cast("string")))).alias("x"))
    assert made._jdf.queryExecution().analyzed().toString().count("md5(") == 1
    assert values(spark, exprs.fnv1a_hex, "", "a", "é日本\x00x", None) == ["cbf29ce484222325", "af63dc4c8601ec8c", "f919ce3faeffa89d", None]


def test_a_remote_is_trimmed_once(spark):
    made = spark.range(1).select(exprs.normalized_remote(F.md5(F.col("id").cast("string"))).alias("x"))
    assert made._jdf.queryExecution().analyzed().toString().count("md5(") == 1


def test_times(spark):
    got = values(spark, exprs.epoch_ms, "1970-01-01T00:00:01.2345678Z", " 1970-01-01T01:00:00+01:00 ", "2024-02-30T00:00:00Z", "2026", "1969-12-31T23:59:59.999Z", None)
    assert got == [1234, 0, None, None, -1, None]


def test_titles(spark):
    long = "word " * 30
    got = values(spark, exprs.title_of, "  \n# A   title\nmore", "<skill>x", "<tag>\n- item", "pre ## My request: do it", long, "日" * 90, "", None)
    assert got[:4] == ["A title", None, "item", "do it"]
    assert got[4] == ("word " * 16).strip() + "…" and got[5] == "日" * 80 + "…" and got[6:] == [None, None]


def test_diffs_and_folders(spark):
    counts = values(spark, exprs.diff_counts, "--- a\n+++ b\n+x\n-y\n z\n+", "", None)
    assert (counts[0].added, counts[0].removed, counts[1], counts[2]) == (2, 1, None, None)
    assert values(spark, exprs.folder_name, " a \n b\u200bc ", "", None, "x" * 200) == ["a b c", "New folder", "New folder", "x" * 100]


@pytest.mark.parametrize("at", [None, 0, -5, 1_700_000_000_000])
def test_session_cursor_round_trip(at):
    assert read_session_cursor(session_cursor(at, "s:1%3A")) == (at, "s:1%3A")


def test_malformed_cursors():
    assert [read_session_cursor(x) for x in (None, "", "abc", "1:", "x:y", "1:2:3", "1:" + "z" * 3000)] == [None] * 7
    assert [read_message_cursor(x) for x in (None, "x", "12")] == [None, None, 12]
    good = search_cursor(-1.25, None, 7)
    assert read_search_cursor(good) == (-1.25, None, 7)
    assert [read_search_cursor(x) for x in (good + ":1", "7ff0000000000000:1:2", "zz:1:2", good.replace(":7", ":0"))] == [None] * 4


def test_query_box():
    q = parse_query("fix agent: agent:codex path:src/ tool:sh\u200bell has:error other:x " + "t " * 30)
    assert (q.agent, q.path, q.tool, q.has_error) == ("codex", "src/", "shell", True)
    assert q.terms[:2] == ["fix", "other:x"] and len(q.terms) == 16
    assert len(parse_query("é" * 400).terms[0]) == 256
