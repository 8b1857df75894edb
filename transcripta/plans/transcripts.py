"""Registered queries of the parsers, each with its SQL.

Conversations are written as transcripts of both vendors: every turn is a record,
every fourth of another kind (text, call, result, thought), with some broken lines.
What the parsers make of them is held against what the conversations say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch_ms
from ..operators.enrichment import enrich
from ..operators.ingest import ingest
from ..operators.lifecycle import Archive
from ..operators.scratch import checkpoint_root, settled
from ..operators.transcripts import vendor_a, vendor_b
from ..sources.transcripts import lines
from .catalog import QUERIES, SQL, _registered, _TITLED, table

__all__ = ["QUERIES", "SQL"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).withColumn("k", F.col("rn") % 4)


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _time(second: str) -> Column:
    return F.concat(F.lit("2026-01-02T03:"), F.lpad((F.col("rn") % 60).cast("string"), 2, "0"), F.lit(f":{second}Z"))


def _line(number: Column, raw: Column) -> Column:
    return F.struct(number.cast("long").alias("line_no"), raw.alias("raw"))


def _written(turns: DataFrame, *made: Column) -> DataFrame:
    """(conv_id, line_no, raw): the lines that each turn makes, null ones left out; turns are read once."""
    return turns.select("conv_id", F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def _lines_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, none = _quoted(F.col("text")), F.lit("null")
    content = (
        F.when(F.col("k") == 1, F.format_string('[{"type":"text","text":%s},{"type":"tool_use","id":"c-%d-%d","name":"%s","input":{"file_path":"/src/%d/../%d.ts"}}]', text, "conv_id", "rn", F.when(F.col("conv_id") % 3 == 0, "Read").otherwise("Edit"), "conv_id", "rn"))
        .when(F.col("k") == 2, F.format_string('[{"type":"tool_result","tool_use_id":"c-%d-%d","is_error":%s,"content":%s}]', F.col("conv_id"), F.col("rn") - 1, (F.col("conv_id") % 2 == 0).cast("string"), text))
        .when(F.col("k") == 3, F.format_string('[{"type":"thinking","thinking":%s,"signature":"s"}]', text))
        .otherwise(text)
    )
    usage = F.when(F.col("role") == "assistant", F.format_string('{"input_tokens":%d,"output_tokens":%d}', F.length("text"), F.col("rn"))).otherwise(none)
    parent = F.when(F.col("rn") > 0, F.format_string('"u-%d-%d"', F.col("conv_id"), F.col("rn") - 1)).otherwise(none)
    raw = F.format_string('{"type":"%s","uuid":"u-%d-%d","parentUuid":%s,"sessionId":"a-%d","timestamp":"%s","cwd":"/w/%d","gitBranch":"main","message":{"role":"%s","usage":%s,"content":%s}}', "role", "conv_id", "rn", parent, "conv_id", _time("05.250"), F.floor(F.col("rn") / 3), "role", usage, content)
    first, conv = F.col("rn") == 0, F.col("conv_id")
    title = F.when(first & (conv % 2 == 0), _line(F.lit(1 << 20), F.format_string('{"type":"custom-title","customTitle":"Conversation %d"}', "conv_id")))
    broken = F.when(first & (conv % 5 == 0), _line(F.lit((1 << 20) + 1), F.lit("{broken")))
    surprise = F.when(first & (conv % 7 == 0), _line(F.lit((1 << 20) + 2), F.lit('{"type":"surprise"}')))
    rows = _written(_turns(spark, sf_dir), _line(F.col("rn"), raw), title, broken, surprise)
    return rows.select(F.lit("claude-code").alias("agent_id"), F.format_string("a-%d.jsonl", "conv_id").alias("path"), "line_no", F.col("line_no").alias("byte_offset"), "raw")


def _lines_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _quoted(F.col("text"))
    call = F.format_string('"call_id":"c-%d-%d"', F.col("conv_id"), F.col("rn") - F.when(F.col("k") == 2, 1).otherwise(0))
    payload = (
        F.when(F.col("k") == 1, F.format_string('{"type":"function_call","name":"shell","arguments":%s,%s}', text, call))
        .when(F.col("k") == 2, F.format_string('{"type":"function_call_output","output":%s,"status":"%s",%s}', text, F.when(F.col("conv_id") % 2 == 0, "failed").otherwise("completed"), call))
        .when(F.col("k") == 3, F.format_string('{"type":"reasoning","summary":[{"text":%s}],"encrypted_content":"x"}', text))
        .otherwise(F.format_string('{"type":"message","role":"%s","content":[{"type":"input_text","text":%s}]}', F.col("role"), text))
    )
    turns = _turns(spark, sf_dir).withColumn("ends", F.lead("rn").over(Window.partitionBy("conv_id").orderBy("rn")).isNull())
    number = F.col("rn").cast("long") * 3
    meta = F.format_string('{"type":"session_meta","payload":{"id":"b-%d","cwd":"/p","cli_version":"1","model_provider":"prov","git":{"branch":"main","commit_hash":"abc"}}}', "conv_id")
    totals = F.format_string('{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":%d,"output_tokens":%d,"cached_input_tokens":1}}}}', "conv_id", "rn")
    diff = r"--- a\n+++ b\n-x\n+y\n+z\n"
    patch = F.format_string('{"type":"event_msg","payload":{"type":"patch_apply_end",%s,"changes":{"d/f%d.ts":{"type":"update","unified_diff":"%s"}}}}', call, F.col("rn"), F.lit(diff))
    item = F.format_string('{"type":"response_item","timestamp":"%s","payload":%s}', _time("07"), payload)
    context = F.format_string('{"type":"turn_context","payload":{"model":"m%d"}}', F.floor(F.col("rn") / 3))
    ends = (F.when(F.col("ends"), _line(F.lit(0), meta)), F.when(F.col("ends"), _line(F.lit(1 << 20), totals)))
    rows = _written(turns, _line(number + 2, item), F.when(F.col("rn") % 3 == 0, _line(number + 1, context)), F.when(F.col("k") == 2, _line(number + 3, patch)), *ends)
    return rows.select(F.lit("codex").alias("agent_id"), F.format_string("rollout-%d.jsonl", "conv_id").alias("path"), "line_no", F.col("line_no").alias("byte_offset"), "raw")


def _of_session(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of a table with their session's native id, and a hash of their text in its place."""
    rows = tables[name]
    if "text" in rows.columns:
        rows = rows.withColumn("text", F.md5("text"))  # before it is shuffled
    # never broadcast: sessions grow with the input
    return rows.join(tables["native_ids"].withColumnRenamed("native_session_id", "native").hint("shuffle_hash"), "session_id")


_T = "t as (select *, rn % 4 k from (select *, row_number() over (partition by conv_id order by turn) - 1 rn from conversations where text is not null))"
_AT = "epoch_ms(timestamp '2026-01-02 03:00:00') + (rn % 60) * 60000"
_ROLE = "case when role in ('assistant', 'system', 'tool') then role else 'user' end"


@_registered(f"""with {_T} select 'a-' || conv_id native, rn seq, {_ROLE} "role", 'message' event_kind, {_AT} + 5250 ts, case when role = 'assistant' then length(text) end input_tokens, case when rn > 0 then rn - 1 end parent_seq from t""")
def parsed_messages(spark, sf_dir):
    tables = vendor_a(_lines_a(spark, sf_dir))
    parents = tables["message"].select(F.col("id").alias("parent_id"), F.col("seq").alias("parent_seq"))
    return _of_session(tables, "message").join(parents, "parent_id", "left").select("native", "seq", "role", "event_kind", "ts", "input_tokens", "parent_seq")


@_registered(f"""with {_T}, p as (select *, 0 ordinal, case k when 2 then 'tool_result' when 3 then 'thinking' else 'text' end kind, md5(text) shown, k <> 3 searchable from t
union all select *, 1, 'tool_use', null, false from t where k = 1) select 'a-' || conv_id native, rn seq, ordinal, kind, shown, searchable from p""")
def parsed_parts(spark, sf_dir):
    return _of_session(vendor_a(_lines_a(spark, sf_dir)), "message_part").select("native", "seq", "ordinal", "kind", F.col("text").alias("shown"), "searchable")


_CALLS = f"""with {_T} select c.conv_id || '-' || c.rn call, {{name}} "name", case when r.rn is not null then c.conv_id % 2 = 0 end is_error, md5(r.text) output from t c left join t r on c.conv_id = r.conv_id and r.rn = c.rn + 1 where c.k = 1"""


@_registered(_CALLS.format(name="case when c.conv_id % 3 = 0 then 'Read' else 'Edit' end"))
def parsed_calls(spark, sf_dir):
    return vendor_a(_lines_a(spark, sf_dir))["tool_call"].select(F.substring("native_call_id", 3, 100).alias("call"), "name", "is_error", F.md5("output_text").alias("output"))


@_registered(f"""with {_T} select 'a-' || conv_id native, 'src/' || rn || '.ts' path, 'edit' change_kind, 'c-' || conv_id || '-' || rn call, rn // 3 segment_ix from t where k = 1 and conv_id % 3 <> 0""")
def parsed_files(spark, sf_dir):
    tables = vendor_a(_lines_a(spark, sf_dir))
    calls = tables["tool_call"].select(F.col("id").alias("tool_call_id"), F.col("native_call_id").alias("call"))
    segments = tables["session_segment"].select(F.col("id").alias("segment_id"), "segment_ix")
    return _of_session(tables, "file_event").join(calls, "tool_call_id", "left").join(segments, "segment_id").select("native", "path", "change_kind", "call", "segment_ix")


@_registered(f"""with {_T} select 'a-' || conv_id native, rn // 3 segment_ix, min(rn) seq_start, max(rn) seq_end, '/w/' || (rn // 3) cwd, 'main' git_branch from t group by conv_id, rn // 3""")
def parsed_segments(spark, sf_dir):
    return _of_session(vendor_a(_lines_a(spark, sf_dir)), "session_segment").select("native", "segment_ix", "seq_start", "seq_end", "cwd", "git_branch")


@_registered(_TITLED.format(chosen="text is not null and rn % 4 < 2", turns="(select *, row_number() over (partition by conv_id order by turn) - 1 rn from conversations where text is not null)", then=f""", {_T},
s as (select conv_id, count(*) message_count, count(*) filter (k = 1) tool_call_count, sum(case when role = 'assistant' then length(text) end) input_tokens, min({_AT}) + 5250 started_at, max({_AT}) + 5250 ended_at, (conv_id % 5 = 0)::int + (conv_id % 7 = 0)::int notes from t group by conv_id)
select 'a-' || s.conv_id native, case when s.conv_id % 2 = 0 then 'Conversation ' || s.conv_id else title end title, s.conv_id % 2 = 1 and title is not null synthetic, started_at, ended_at, message_count, tool_call_count, input_tokens::bigint input_tokens,
  case when notes > 0 then 'partial' else 'ok' end parse_status, case when notes = 2 then '2 parser note(s); first: unparseable line (possibly truncated)' when s.conv_id % 5 = 0 then 'unparseable line (possibly truncated)' when notes > 0 then 'unhandled event type: surprise' end parse_note
from s left join titled using (conv_id)"""))
def parsed_sessions(spark, sf_dir):
    rows = vendor_a(_lines_a(spark, sf_dir))["agent_session"]
    return rows.select(F.col("native_session_id").alias("native"), "title", F.col("title_is_synthetic").alias("synthetic"), "started_at", "ended_at", "message_count", "tool_call_count", "input_tokens", "parse_status", "parse_note")


@_registered(f"""with {_T} select 'b-' || conv_id native, rn seq, case k when 0 then {_ROLE} when 2 then 'tool' else 'assistant' end "role", {_AT} + 7000 ts, case when k in (0, 3) then 'm' || (rn // 3) end model from t""")
def rollout_messages(spark, sf_dir):
    return _of_session(vendor_b(_lines_b(spark, sf_dir)), "message").select("native", "seq", "role", "ts", "model")


@_registered(f"""with {_T}, p as (select *, 0 ordinal, case k when 0 then 'text' when 1 then 'tool_use' when 2 then 'tool_result' else 'thinking' end kind, case when k <> 1 then md5(text) end shown, k in (0, 2) searchable from t
union all select *, 1, 'opaque', null, false from t where k = 3) select 'b-' || conv_id native, rn seq, ordinal, kind, shown, searchable from p""")
def rollout_parts(spark, sf_dir):
    return _of_session(vendor_b(_lines_b(spark, sf_dir)), "message_part").select("native", "seq", "ordinal", "kind", F.col("text").alias("shown"), "searchable")


@_registered(_CALLS.format(name="'shell'"))
def rollout_calls(spark, sf_dir):
    return vendor_b(_lines_b(spark, sf_dir))["tool_call"].select(F.substring("native_call_id", 3, 100).alias("call"), "name", "is_error", F.md5("output_text").alias("output"))


@_registered(f"""with {_T} select 'b-' || conv_id native, 'd/f' || rn || '.ts' path, 'edit' change_kind, 2 lines_added, 1 lines_removed, 'c-' || conv_id || '-' || (rn - 1) call from t where k = 2""")
def rollout_files(spark, sf_dir):
    tables = vendor_b(_lines_b(spark, sf_dir))
    calls = tables["tool_call"].select(F.col("id").alias("tool_call_id"), F.col("native_call_id").alias("call"))
    return _of_session(tables, "file_event").join(calls, "tool_call_id", "left").select("native", "path", "change_kind", "lines_added", "lines_removed", "call")


@_registered(f"""with {_T} select 'b-' || conv_id native, count(*) message_count, count(*) filter (k = 1) tool_call_count, conv_id input_tokens, max(rn) output_tokens, 1 cache_tokens, 'ok' parse_status, '1' agent_version from t group by conv_id""")
def rollout_sessions(spark, sf_dir):
    rows = vendor_b(_lines_b(spark, sf_dir))["agent_session"]
    return rows.select(F.col("native_session_id").alias("native"), "message_count", "tool_call_count", "input_tokens", "output_tokens", "cache_tokens", "parse_status", "agent_version")


@_registered(f"""with {_T} select 'b-' || conv_id native, rn // 3 segment_ix, min(rn) seq_start, max(rn) seq_end, '/p' cwd, 'm' || (rn // 3) model, 'prov' provider, case when rn // 3 = 0 then 'abc' end git_commit_sha from t group by conv_id, rn // 3""")
def rollout_segments(spark, sf_dir):
    return _of_session(vendor_b(_lines_b(spark, sf_dir)), "session_segment").select("native", "segment_ix", "seq_start", "seq_end", "cwd", "model", "provider", "git_commit_sha")


@_registered(f"""with {_T}, s as (select conv_id, count(*) n from t group by 1) select 'a-' || conv_id native, 1 + (conv_id % 3 = 0)::int sources, case when conv_id % 3 = 0 then 1 else n end messages from s""")
def session_sources(spark, sf_dir):
    every = _lines_a(spark, sf_dir)
    # a third of the sessions have a second file, later by name, that holds their first record
    second = every.where(F.expr("cast(regexp_extract(path, '([0-9]+)', 1) as bigint) % 3 = 0 and line_no = 0")).withColumn("path", F.concat(F.lit("z"), "path"))
    tables = vendor_a(every.unionByName(second))
    linked = tables["session_source"].groupBy("session_id").agg(F.count("*").alias("sources"))
    return tables["agent_session"].join(linked, F.col("id") == F.col("session_id")).select(F.col("native_session_id").alias("native"), "sources", F.col("message_count").alias("messages"))


def _files(every: DataFrame) -> DataFrame:
    """Lines as files."""
    grouped = every.groupBy("agent_id", "path").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("rows"))  # a transcript is one file
    content = F.encode(F.array_join(F.transform("rows", lambda r: r["raw"]), "\n"), "UTF-8")
    return grouped.select("agent_id", "path", F.timestamp_millis(F.lit(0)).alias("modificationTime"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


@_registered(f"""with {_T} select 'a-' || conv_id || '.jsonl' path, count(*) + (conv_id % 2 = 0)::int + (conv_id % 5 = 0)::int + (conv_id % 7 = 0)::int n from t group by conv_id""")
def file_lines(spark, sf_dir):
    return lines(_files(_lines_a(spark, sf_dir))).groupBy("path").agg(F.count("*").alias("n"))


@_registered("select event_id, epoch_ms(date_trunc('second', ts)) ms from events")
def epoch_ms_utc(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", epoch_ms(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ms"))


# The composed ingest


@_registered(f"""with {_T} select 'a-' || conv_id native, count(*) messages, count(*) + count(*) filter (k = 1) parts, count(*) filter (k = 1) calls, count(*) filter (rn = 0) linked, 'ok' state from t group by conv_id""")
def composed_ingest(spark, sf_dir):
    """Conversations as files into an archive, twice, the second time to no effect; then enrichment of one folder's segments."""
    archive = Archive(spark, f"{checkpoint_root(spark)}/archive-{uuid.uuid4().hex}")
    files = settled(_files(_lines_a(spark, sf_dir)), "ingest-files")
    ingest(archive, files)
    ingest(archive, files)
    texts = {"cwd": "/w/0", "common_dir": "/w/0/.git", "workdir": "/w/0", "branch": "main", "head": "c"}
    flags = {"detached": False, "dirty": False, "truncated": False}
    facts = spark.range(1).select(*(F.lit(v).alias(k) for k, v in {**texts, **flags}.items()), *(F.array(F.lit(k)).alias(k) for k in ("remotes", "roots")))
    enrich(archive, facts, F.lit(0).cast("long"))
    counts = [archive.read(table).groupBy("session_id").agg(F.count("*").alias(name)) for table, name in (("message", "messages"), ("message_part", "parts"), ("tool_call", "calls"))]
    linked = archive.read("session_segment").groupBy("session_id").agg(F.count("repository_id").alias("linked"))
    states = archive.read("session_source").join(archive.read("ingest_state"), "source_artifact_id").select("session_id", F.col("status").alias("state"))
    rows = archive.read("agent_session").select(F.col("id").alias("session_id"), F.col("native_session_id").alias("native")).join(linked, "session_id").join(states, "session_id")
    for count in counts:
        rows = rows.join(count, "session_id", "left")
    return rows.select("native", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("messages", "parts", "calls")), "linked", "state")
