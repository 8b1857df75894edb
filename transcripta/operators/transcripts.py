"""Vendor transcripts to archive tables, as joins, windows and selects over lines.

Lines (agent_id, path, line_no, byte_offset, raw) are parsed once into VARIANT;
each table is a select over them.  What a session's state machine would carry
from line to line is a window over its lines, so a batch of any number of files is
one job.  Unknown shapes become notes and make a session partial; nothing fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bounded, det_id, diff_counts, epoch_ms, sanitized_path, stem_of, sum_or_null, title_of
from .scratch import settled
from .sequences import filled, first_there, island_bounds, numbered, paired, saturating_sum

# The records of both formats.
KEPT_A = ("user", "assistant", "system", "attachment", "summary", "mode", "pr-link")
QUIET_A = ("custom-title", "ai-title", "queue-operation", "last-prompt")
CALLS_B = ("function_call", "custom_tool_call")
OUTPUTS_B = ("function_call_output", "custom_tool_call_output")
QUIET_ITEMS_B = ("tool_search_call", "tool_search_output", "web_search_call")
QUIET_EVENTS_B = ("task_started", "user_message", "agent_message", "agent_reasoning", "thread_settings_applied", "mcp_tool_call_start", "mcp_tool_call_end", "web_search_start", "web_search_end", "task_complete", "turn_aborted", "patch_apply_end", "token_count", "context_compacted")
RECORDS_B = ("session_meta", "turn_context", "response_item", "event_msg", "compacted", "world_state", "inter_agent_communication_metadata")
EDITING = {"Edit": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "Write": "write"}

KEY = ["agent_id", "path"]


# JSON fields by type: a value of another type counts as missing.


def _value(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str = "$") -> Column:
    return F.when(_type(_value(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _flag(v: Column, path: str) -> Column:
    return F.when(_type(_value(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def _int(v: Column, path: str) -> Column:
    return F.when(_type(_value(v, path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def _count(v: Column, path: str) -> Column:
    found = _int(v, path)
    return F.when(found >= 0, found)


def _array(v: Column, path: str = "$") -> Column:
    return F.when(_type(_value(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _object(v: Column, path: str) -> Column:
    return _type(_value(v, path)).startswith("OBJECT")


def _json(v: Column, path: str = "$") -> Column:
    """Compact JSON of a value that is there (a JSON null is "null")."""
    found = _value(v, path)
    return F.when(F.coalesce(F.is_variant_null(found), F.lit(False)), "null").otherwise(F.to_json(found))


def _text_or_json(v: Column, path: str) -> Column:
    return F.coalesce(_text(v, path), _json(v, path))


def _block_texts(blocks: Column) -> Column:
    """The texts of strings and of {text} objects in an array."""
    return F.filter(F.transform(blocks, lambda b: F.coalesce(_text(b), _text(b, "$.text"))), lambda t: t.isNotNull())


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with their record ``v``, null where a line is no JSON object."""
    record = F.try_parse_json("raw")
    rows = lines.withColumn("v", record).drop("raw")
    return rows.withColumn("v", F.when(F.coalesce(_type(F.col("v")).startswith("OBJECT"), F.lit(False)), F.col("v"))).withColumn("type", F.coalesce(_text(F.col("v"), "$.type"), F.lit("")))


def _sequenced(rows: DataFrame, kept: Column, context: list[str]) -> DataFrame:
    """Rows with the number ("seq") of each kept one in its file, and of its run of equal context; null for others.

    In the order of lines, so that rows that are parsed already need no shuffle for it.
    """
    ordered = Window.partitionBy(*KEY).orderBy("line_no")
    so_far, before = (ordered.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    rows = rows.withColumn("_own", F.when(kept, F.struct(*context)))
    rows = rows.withColumns({"_last": F.last("_own", ignorenulls=True).over(before), "_seq": F.count("_own").over(so_far) - 1})
    fresh = F.col("_own").isNotNull() & ~F.col("_own").eqNullSafe(F.col("_last"))
    rows = rows.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(so_far) - 1)
    held = F.col("_own").isNotNull()
    return rows.withColumns({"seq": F.when(held, F.col("_seq")), "segment_ix": F.when(held, F.col("_run"))}).drop("_own", "_last", "_seq", "_fresh", "_run")


def _note(rows: DataFrame, message: Column) -> DataFrame:
    return rows.select(*KEY, "line_no", message.alias("note"))


def _notes(rows: DataFrame, cases: list[tuple[Column, str | Column]]) -> DataFrame:
    """The messages of all conditions that a row meets, in one pass."""
    found = F.array(*(F.when(met, F.lit(message) if isinstance(message, str) else message) for met, message in cases))
    return rows.select(*KEY, "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("note"))


def _part(ordinal: Column, kind: str | Column, text: Column | None = None, content_json: Column | None = None, searchable: bool = False, metadata: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(ordinal.cast("long").alias("ordinal"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if text is None else text).alias("text"), (none if content_json is None else content_json).alias("content_json"), F.lit(searchable).alias("searchable"), (none if metadata is None else metadata).alias("metadata_json"))


_NO_PARTS = "array<struct<ordinal:bigint,kind:string,text:string,content_json:string,searchable:boolean,metadata_json:string>>"


def _no_parts() -> Column:
    return F.array().cast(_NO_PARTS)


def _numbered_parts(texts: Column, kind: str, searchable: bool) -> Column:
    return F.transform(texts, lambda t, i: _part(i, kind, t, searchable=searchable))


# Vendor A: a tree of messages


def _result_text(block: Column) -> Column:
    joined = _block_texts(_array(block, "$.content"))
    return F.coalesce(_text(block, "$.content"), F.when(F.size(joined) > 0, F.array_join(joined, "\n")))


def _block_part(block: Column, at: Column) -> Column:
    kind = F.coalesce(_text(block, "$.type"), F.lit(""))
    signature = _text(block, "$.signature")
    return (
        F.when(_text(block).isNotNull(), _part(at, "text", _text(block), searchable=True))
        .when(kind == "text", _part(at, "text", _text(block, "$.text"), searchable=True))
        .when(kind == "thinking", _part(at, "thinking", _text(block, "$.thinking"), metadata=F.when(signature.isNotNull(), F.to_json(F.struct(signature.alias("signature"))))))
        .when(kind == "tool_use", _part(at, "tool_use", content_json=_json(block)))
        .when(kind == "tool_result", _part(at, "tool_result", _result_text(block), _json(block, "$.content"), True))
        .otherwise(_part(at, "other", content_json=_json(block)))
    )


def vendor_a(lines: DataFrame) -> dict[str, DataFrame]:
    # some twenty selects read these rows: lines are made and parsed once, not for each
    v = F.col("v")
    rows = parsed(lines).withColumns({"cwd": _text(v, "$.cwd"), "git_branch": _text(v, "$.gitBranch")})
    rows = settled(_sequenced(rows, F.col("type").isin(*KEPT_A), ["cwd", "git_branch"]), "lines")
    kept = rows.where("seq is not null")
    content, attachment = _value(v, "$.message.content"), _value(v, "$.attachment")
    given = _text(v, "$.message.role")
    role = F.when(given.isin("assistant", "system", "tool"), given).when(given.isNotNull(), "user").when(F.col("type").isin("assistant", "system"), F.col("type")).when(F.col("type").isin("summary", "mode", "pr-link"), "meta").otherwise("user")
    kind = F.when(F.col("type").isin("attachment", "summary", "mode"), F.col("type")).when(F.col("type") == "pr-link", "pr_link").otherwise("message")
    blocks = _array(v, "$.message.content")
    parts = (
        F.when(_text(v, "$.message.content").isNotNull(), F.array(_part(F.lit(0), "text", _text(v, "$.message.content"), searchable=True)))
        .when(blocks.isNotNull(), F.transform(blocks, _block_part))
        .when(content.isNull() & attachment.isNotNull(), F.array(_part(F.lit(0), "attachment", content_json=_json(v, "$.attachment"))))
        .otherwise(_no_parts())
    )
    messages = kept.select(
        *KEY, "seq", "line_no", _text(v, "$.uuid").alias("native_uuid"), _text(v, "$.parentUuid").alias("parent_native_uuid"), role.alias("role"), kind.alias("event_kind"),
        F.coalesce(_flag(v, "$.isSidechain"), F.lit(False)).alias("is_sidechain"), epoch_ms(_text(v, "$.timestamp")).alias("ts"), _text(v, "$.message.model").alias("model"),
        _int(v, "$.message.usage.input_tokens").alias("input_tokens"), _int(v, "$.message.usage.output_tokens").alias("output_tokens"), _int(v, "$.message.usage.cache_read_input_tokens").alias("cache_tokens"),
        _text(v, "$.message.stop_reason").alias("stop_reason"), F.col("byte_offset").alias("source_offset"), parts.alias("parts"), "cwd", "git_branch", "segment_ix",
    )

    uses = kept.select(*KEY, "seq", "line_no", F.posexplode(blocks).alias("ordinal", "b"))
    b = F.col("b")
    uses = uses.withColumn("kind", _text(b, "$.type")).where("kind in ('tool_use', 'tool_result')").withColumn("native_call_id", F.when(F.col("kind") == "tool_use", _text(b, "$.id")).otherwise(_text(b, "$.tool_use_id")))
    named = uses.where("native_call_id is not null").withColumn("input", _value(b, "$.input"))
    calls = named.where("kind = 'tool_use'").select(*KEY, "native_call_id", F.coalesce(_text(b, "$.name"), F.lit("")).alias("name"), F.col("seq").alias("call_seq"), F.col("ordinal").cast("long").alias("call_ordinal"), _json(b, "$.input").alias("input_json"), F.col("input").alias("input"))
    # what a result says is cut out before its call is looked for
    said = named.select(*KEY, "line_no", "seq", "ordinal", "kind", "native_call_id", F.when(F.col("kind") == "tool_result", _result_text(b)).alias("output_text"), F.when(F.col("kind") == "tool_result", _flag(b, "$.is_error")).alias("is_error"))
    results = paired(said, [*KEY, "native_call_id"], ["seq", "ordinal"], F.col("kind") == "tool_use", F.col("kind") == "tool_result", ["seq", "ordinal"])
    # presence, not type, chooses the field: a path that is no text is no event
    chosen = F.coalesce(_value(F.col("input"), "$.file_path"), _value(F.col("input"), "$.notebook_path"), _value(F.col("input"), "$.path"))
    change = F.element_at(F.create_map(*(F.lit(x) for item in EDITING.items() for x in item)), F.col("name"))
    events = calls.select(*KEY, "native_call_id", F.col("call_seq").alias("at"), F.col("call_ordinal").alias("at_2"), sanitized_path(_text(chosen)).alias("file"), change.alias("change_kind"))
    events = events.where("file is not null and change_kind is not null").withColumns({"old_path": F.lit(None).cast("string"), "lines_added": F.lit(None).cast("long"), "lines_removed": F.lit(None).cast("long"), "patch_text": F.lit(None).cast("string"), "source": F.lit("agent_tool_input"), "event_ts": F.lit(None).cast("long")})
    outputs = results.select(*KEY, "native_call_id", F.col("seq").alias("result_seq"), F.col("ordinal").cast("long").alias("result_ordinal"), "output_text", "is_error", F.col("call_seq"), F.col("call_ordinal").cast("long").alias("call_ordinal"))

    strange = F.filter(F.transform(blocks, lambda x: F.when(_text(x).isNull(), F.coalesce(_text(x, "$.type"), F.lit("")))), lambda t: t.isNotNull() & ~t.isin("text", "thinking", "tool_use", "tool_result"))
    unknown = kept.select(*KEY, "line_no", F.explode(strange).alias("block"))
    notes = [
        _notes(rows, [
            (v.isNull(), "unparseable line (possibly truncated)"),
            (v.isNotNull() & ~F.col("type").isin(*KEPT_A, *QUIET_A), F.concat(F.lit("unhandled event type: "), bounded(F.col("type")))),
        ]),
        _note(unknown, F.concat(F.lit("unknown content block: "), bounded(F.col("block")))),
        _note(uses.where("native_call_id is null"), F.when(F.col("kind") == "tool_use", "tool_use without id").otherwise("tool_result without tool_use_id")),
        _note(results.where("call_seq is null"), F.lit("tool_result without matching tool_use")),
    ]
    meta = rows.select(*KEY, "line_no", _text(v, "$.sessionId").alias("native"), _text(v, "$.version").alias("agent_version"), F.when(F.col("type") == "custom-title", _text(v, "$.customTitle")).alias("custom"), F.when(F.col("type") == "ai-title", _text(v, "$.aiTitle")).alias("ai"))
    heads = meta.groupBy(*KEY).agg(first_there("native", "line_no").alias("native_session_id"), first_there("agent_version", "line_no").alias("agent_version"), F.max_by("custom", F.when(F.col("custom").isNotNull(), F.col("line_no"))).alias("custom"), first_there("ai", "line_no").alias("ai"))
    heads = heads.select(*KEY, "native_session_id", "agent_version", F.coalesce("custom", "ai").alias("title"))
    bounds = messages.groupBy(*KEY).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), first_there("model", "seq").alias("primary_model"))
    segments = island_bounds(messages, KEY, "seq", ["cwd", "git_branch"]).withColumns({c: F.lit(None).cast("string") for c in ("model", "provider", "git_commit_sha", "git_remote_url")})
    return _tables(messages, calls.drop("input"), outputs, events, notes, settled(heads.join(bounds, KEY, "left"), "parsed"), segments)


# Vendor B: a linear log


def _change_kind(change: Column) -> Column:
    kind = _text(change, "$.type")
    return (
        F.when(_text(change, "$.move_path").isNotNull(), "move")
        .when(kind.isin("add", "create"), "create")
        .when(kind.isin("delete", "remove"), "delete")
        .when(kind.isin("update", "modify", "edit"), "edit")
        .when(_text(change, "$.unified_diff").isNotNull(), "edit")
        .when(_text(change, "$.content").isNotNull(), "write")
        .otherwise("patch")
    )


def vendor_b(lines: DataFrame) -> dict[str, DataFrame]:
    rows = parsed(lines)
    v = F.col("v")
    item = F.coalesce(_text(v, "$.payload.type"), F.lit(""))
    rows = rows.withColumns({"item": item, "ts": epoch_ms(_text(v, "$.timestamp")), "has_payload": _value(v, "$.payload").isNotNull()})
    sets = F.col("type").isin("session_meta", "turn_context")
    rows = rows.withColumns({"cwd": F.when(sets, _text(v, "$.payload.cwd")), "model_set": F.when(F.col("type") == "turn_context", _text(v, "$.payload.model"))})
    rows = filled(rows, KEY, ["line_no"], ["cwd", "model_set"]).withColumn("context_model", F.col("model_set"))
    items = F.col("item").isin("message", "reasoning", *CALLS_B, *OUTPUTS_B)
    is_item = (F.col("type") == "response_item") & F.col("has_payload")
    compaction = (F.col("type") == "compacted") | ((F.col("type") == "event_msg") & (F.col("item") == "context_compacted"))
    rows = rows.withColumns({"is_compaction": compaction, "native_call_id": F.when(is_item & F.col("item").isin(*CALLS_B, *OUTPUTS_B), _text(v, "$.payload.call_id"))})
    rows = settled(_sequenced(rows, (is_item & items) | compaction, ["cwd", "context_model"]), "lines")  # as for vendor A
    kept = rows.where("seq is not null")

    given = _text(v, "$.payload.role")
    plain = F.when(given.isin("assistant", "system", "tool"), given).otherwise("user")
    role = F.when(F.col("is_compaction"), "meta").when(F.col("item") == "message", plain).when(F.col("item").isin(*OUTPUTS_B), "tool").otherwise("assistant")
    whole = _text(v, "$.payload.content")
    texts = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.coalesce(_block_texts(_array(v, "$.payload.content")), F.array().cast("array<string>")))
    thoughts = F.concat(*(F.when(_text(v, p).isNotNull(), F.array(_text(v, p))).otherwise(F.coalesce(_block_texts(_array(v, p)), F.array().cast("array<string>"))) for p in ("$.payload.summary", "$.payload.content")))
    sealed = _text(v, "$.payload.encrypted_content")
    opaque = F.when(sealed.isNotNull(), F.array(_part(F.size(thoughts), "opaque", content_json=F.to_json(F.struct(sealed.alias("encrypted_content"))), metadata=F.lit('{"opaque":"encrypted_content"}')))).otherwise(_no_parts())
    summary = F.when(F.col("type") == "compacted", _text(v, "$.payload.message"))
    output = _text_or_json(v, "$.payload.output")
    parts = (
        F.when(F.col("is_compaction"), F.when(summary.isNotNull(), F.array(_part(F.lit(0), "summary", summary, searchable=True))).otherwise(_no_parts()))
        .when(F.col("item") == "message", _numbered_parts(texts, "text", True))
        .when(F.col("item") == "reasoning", F.concat(_numbered_parts(thoughts, "thinking", False), opaque))
        .when(F.col("item").isin(*CALLS_B), F.array(_part(F.lit(0), "tool_use", content_json=_json(v, "$.payload"))))
        .otherwise(F.array(_part(F.lit(0), "tool_result", output, _json(v, "$.payload"), True)))
    )
    none = {c: F.lit(None).cast(t) for c, t in (("native_uuid", "string"), ("parent_native_uuid", "string"), ("input_tokens", "long"), ("output_tokens", "long"), ("cache_tokens", "long"), ("stop_reason", "string"))}
    messages = kept.select(
        *KEY, "seq", "line_no", role.alias("role"), F.when(F.col("is_compaction"), "compaction").otherwise("message").alias("event_kind"), F.lit(False).alias("is_sidechain"), "ts",
        F.when(F.col("item").isin("message", "reasoning") & ~F.col("is_compaction"), F.col("model_set")).alias("model"), F.col("byte_offset").alias("source_offset"), parts.alias("parts"), "cwd", "context_model", "segment_ix",
    ).withColumns(none)

    is_tool = F.col("seq").isNotNull() & ~F.col("is_compaction") & F.col("item").isin(*CALLS_B, *OUTPUTS_B)
    tools = rows.where(is_tool)
    named = tools.where("native_call_id is not null")
    arguments = F.coalesce(_value(v, "$.payload.arguments"), _value(v, "$.payload.input"))
    calls = named.where(F.col("item").isin(*CALLS_B)).select(*KEY, "native_call_id", F.coalesce(_text(v, "$.payload.name"), F.lit("")).alias("name"), F.col("seq").alias("call_seq"), F.lit(0).cast("long").alias("call_ordinal"), _text_or_json(arguments, "$").alias("input_json"))
    status = F.when(F.col("item").isin(*OUTPUTS_B), _text(v, "$.payload.status"))
    said = named.select(*KEY, "line_no", "seq", "item", "native_call_id", F.when(F.col("item").isin(*OUTPUTS_B), output).alias("output_text"), F.when(status.isNotNull(), ~status.isin("completed", "success", "ok")).alias("is_error"))
    results = paired(said, [*KEY, "native_call_id"], ["seq"], F.col("item").isin(*CALLS_B), F.col("item").isin(*OUTPUTS_B), ["seq"])
    outputs = results.select(*KEY, "native_call_id", F.col("seq").alias("result_seq"), F.lit(0).cast("long").alias("result_ordinal"), "output_text", "is_error", "call_seq", F.lit(0).cast("long").alias("call_ordinal"))

    patches = rows.where((F.col("type") == "event_msg") & (F.col("item") == "patch_apply_end"))
    # a map of variants has its keys as entries, whatever they hold
    entries = F.array_sort(F.map_entries(F.try_variant_get(v, "$.payload.changes", "map<string,variant>")).cast("array<struct<key:string,value:variant>>"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    changes = patches.where(_object(v, "$.payload.changes")).select(*KEY, "line_no", "ts", _text(v, "$.payload.call_id").alias("native_call_id"), F.posexplode(entries).alias("place", "entry"))
    change = F.col("entry.value")
    counts = diff_counts(_text(change, "$.unified_diff"))
    events = changes.select(
        *KEY, "native_call_id", F.col("line_no").alias("at"), F.col("place").cast("long").alias("at_2"), sanitized_path(F.coalesce(_text(change, "$.move_path"), F.col("entry.key"))).alias("file"), _change_kind(change).alias("change_kind"),
        F.when(_text(change, "$.move_path").isNotNull(), sanitized_path(F.col("entry.key"))).alias("old_path"), counts["added"].alias("lines_added"), counts["removed"].alias("lines_removed"),
        F.coalesce(_text(change, "$.unified_diff"), _text(change, "$.content")).alias("patch_text"), F.lit("agent_patch").alias("source"), F.col("ts").alias("event_ts"),
    )

    shapeless = changes.where(F.coalesce(_text(change, "$.type"), _text(change, "$.move_path"), _text(change, "$.unified_diff"), _text(change, "$.content")).isNull())
    notes = [
        _notes(rows, [
            (v.isNull(), "unparseable line (possibly truncated)"),
            (v.isNotNull() & ~F.col("type").isin(*RECORDS_B), F.concat(F.lit("unknown record type: "), bounded(F.col("type")))),
            (is_item & ~items & ~F.col("item").isin(*QUIET_ITEMS_B), F.concat(F.lit("unknown response_item: "), bounded(F.col("item")))),
            ((F.col("type") == "event_msg") & F.col("has_payload") & ~F.col("item").isin(*QUIET_EVENTS_B), F.concat(F.lit("unknown event_msg: "), bounded(F.col("item")))),
            (is_tool & F.col("native_call_id").isNull(), F.when(F.col("item").isin(*CALLS_B), "tool call without call_id").otherwise("tool output without call_id")),
        ]),
        _note(results.where("call_seq is null"), F.lit("tool output without matching call")),
        _note(patches.where(_value(v, "$.payload.changes").isNotNull() & ~_object(v, "$.payload.changes")), F.lit("malformed patch_apply_end changes (not an object)")),
        _note(shapeless, F.lit("unrecognized patch_apply_end change shape")),
    ]
    # a later meta record replaces all of its fields, absent ones too
    meta = F.when((F.col("type") == "session_meta") & F.col("has_payload"), F.struct(_text(v, "$.payload.id").alias("native_session_id"), _text(v, "$.payload.cli_version").alias("agent_version"), _text(v, "$.payload.model_provider").alias("provider"), _text(v, "$.payload.git.branch").alias("git_branch"), _text(v, "$.payload.git.commit_hash").alias("git_commit_sha"), _text(v, "$.payload.git.repository_url").alias("git_remote_url")))
    info = F.coalesce(_value(v, "$.payload.info.total_token_usage"), _value(v, "$.payload.info"))
    usage = F.struct(F.coalesce(_count(info, "$.input_tokens"), _count(info, "$.input")).alias("input_tokens"), F.coalesce(_count(info, "$.output_tokens"), _count(info, "$.output")).alias("output_tokens"), sum_or_null(_count(info, "$.cached_input_tokens"), _count(info, "$.cache_write_input_tokens")).alias("cache_tokens"))
    used = F.when((F.col("type") == "event_msg") & (F.col("item") == "token_count"), usage)
    facts = rows.select(*KEY, "line_no", "ts", meta.alias("m"), used.alias("u"))
    told = F.when(F.expr("coalesce(u.input_tokens, u.output_tokens, u.cache_tokens) is not null"), F.col("line_no"))
    heads = facts.groupBy(*KEY).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("line_no"))).alias("m"), F.max_by("u", told).alias("u"))
    heads = heads.select(*KEY, "started_at", "ended_at", "m.*", *(F.col(f"u.{c}").alias(f"total_{c}") for c in ("input_tokens", "output_tokens", "cache_tokens"))).withColumns({"title": F.lit(None).cast("string"), "primary_model": F.lit(None).cast("string")})
    heads = settled(heads, "parsed")
    meta = heads.select(*KEY, "provider", "git_branch", "git_commit_sha", "git_remote_url")
    segments = island_bounds(messages, KEY, "seq", ["cwd", "context_model"]).withColumnRenamed("context_model", "model").join(meta, KEY, "left")
    first = F.col("segment_ix") == 0
    segments = segments.withColumns({c: F.when(first, F.col(c)) for c in ("git_branch", "git_commit_sha", "git_remote_url")})
    return _tables(messages, calls, outputs, events, notes, heads.drop("provider", "git_branch", "git_commit_sha", "git_remote_url"), segments)


# Tables of both


def _tables(messages, calls, outputs, events, notes, heads, segments) -> dict[str, DataFrame]:
    """Archive tables with deterministic ids; files that break a key are in ``failures``.

    Files of one native session are one session: the last of them by path gives its
    rows, all are in ``session_source``.  ``native_ids`` names sessions without the
    counts and titles that ``agent_session`` is joined from.
    """
    every = notes[0]
    for more in notes[1:]:
        every = every.unionByName(more)
    noted = every.groupBy(*KEY).agg(F.count("*").alias("n"), F.min_by("note", "line_no").alias("first"))
    noted = noted.select(*KEY, F.when(F.col("n") == 1, F.col("first")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" parser note(s); first: "), "first")).alias("parse_note"))
    repeated_calls = calls.groupBy(*KEY, "native_call_id").count().where("count > 1").select(*KEY)
    repeated_uuids = messages.where("native_uuid is not null").groupBy(*KEY, "native_uuid").count().where("count > 1").select(*KEY)
    failures = repeated_calls.unionByName(repeated_uuids).distinct().withColumn("reason", F.lit("a native id occurs twice"))
    heads = heads.join(failures.select(*KEY), KEY, "left_anti").withColumn("dedupe_key", stem_of(F.col("path")))
    heads = heads.withColumn("session_id", det_id("s", F.col("agent_id"), F.coalesce("native_session_id", "dedupe_key")))
    ends = messages.groupBy(*KEY).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    sources = heads.select(*KEY, "session_id").join(ends, KEY, "left")
    named = settled(heads.groupBy("agent_id", "session_id").agg(F.max("path").alias("path"), F.max_by("native_session_id", "path").alias("native_session_id")).select(*KEY, "session_id", "native_session_id"), "parsed")
    # never broadcast: sessions grow with the input
    ids = named.select(*KEY, "session_id").hint("shuffle_hash")
    heads = heads.join(ids, [*KEY, "session_id"], "left_semi")

    def of_session(rows: DataFrame) -> DataFrame:
        return rows.join(ids, KEY)

    def message_id(seq: str) -> Column:
        return det_id("m", F.col("session_id"), F.col(seq))

    messages = of_session(messages)
    parents = messages.where("native_uuid is not null").groupBy("session_id", F.col("native_uuid").alias("parent_native_uuid")).agg(F.max("seq").alias("parent_seq"))
    linked = messages.join(parents, ["session_id", "parent_native_uuid"], "left")
    message = linked.select(*KEY, message_id("seq").alias("id"), "session_id", "seq", det_id("seg", F.col("session_id"), F.col("segment_ix")).alias("segment_id"), "native_uuid", F.when(F.col("parent_seq").isNotNull(), message_id("parent_seq")).alias("parent_id"), "role", "event_kind", "is_sidechain", "ts", "model", "input_tokens", "output_tokens", "cache_tokens", "stop_reason", "source_offset", F.lit(None).cast("string").alias("metadata_json"))
    parts = messages.select(*KEY, "session_id", "seq", "role", "is_sidechain", F.explode("parts").alias("p")).withColumn("message_id", message_id("seq"))
    part = parts.select(det_id("p", F.col("message_id"), F.col("p.ordinal")).alias("id"), "message_id", "session_id", "seq", "p.*")

    # a result closes the latest call of its id before it; of several results the last counts
    last = outputs.where("call_seq is not null").groupBy(*KEY, "native_call_id", "call_seq", "call_ordinal").agg(F.max_by(F.struct("result_seq", "result_ordinal", "output_text", "is_error"), F.struct("result_seq", "result_ordinal")).alias("r"))
    joined = of_session(calls.join(last, [*KEY, "native_call_id", "call_seq", "call_ordinal"], "left"))
    call_part = det_id("p", message_id("call_seq"), F.col("call_ordinal"))
    result_part = F.when(F.col("r").isNotNull(), det_id("p", det_id("m", F.col("session_id"), F.col("r.result_seq")), F.col("r.result_ordinal")))
    tool_call = joined.select(*KEY, det_id("t", F.col("session_id"), F.col("native_call_id")).alias("id"), "session_id", call_part.alias("call_part_id"), result_part.alias("result_part_id"), "native_call_id", "name", "input_json", F.col("r.output_text").alias("output_text"), F.col("r.is_error").alias("is_error"), F.lit(None).cast("long").alias("duration_ms"), "call_seq")

    at_call = tool_call.groupBy(*KEY, "native_call_id").agg(F.max("call_seq").alias("seq"), F.max("id").alias("tool_call_id"))
    placed = numbered(events, KEY, ["at", "at_2"], "ix").join(at_call, [*KEY, "native_call_id"], "left").join(messages.select(*KEY, "seq", "segment_ix"), [*KEY, "seq"], "left")
    file_event = of_session(placed).select(det_id("f", F.col("session_id"), F.col("ix")).alias("id"), "session_id", det_id("seg", F.col("session_id"), F.coalesce("segment_ix", F.lit(0))).alias("segment_id"), "tool_call_id", F.col("file").alias("path"), "change_kind", "old_path", "lines_added", "lines_removed", "patch_text", "source", "event_ts")

    segment = of_session(segments).select(det_id("seg", F.col("session_id"), F.col("segment_ix")).alias("id"), "session_id", F.col("segment_ix").cast("long").alias("segment_ix"), "seq_start", "seq_end", "cwd", "model", "provider", F.lit(None).cast("string").alias("repository_id"), F.lit(None).cast("string").alias("worktree_id"), F.lit("event").alias("context_source"), F.lit("unresolved").alias("resolution_confidence"), "git_branch", "git_commit_sha", "git_remote_url")

    titles = parts.where("role = 'user' and not is_sidechain and p.kind = 'text'").select(*KEY, title_of(F.col("p.text")).alias("t"), F.struct("seq", "p.ordinal").alias("o")).where("t is not null").groupBy(*KEY).agg(F.min_by("t", "o").alias("asked"))
    counted = message.groupBy(*KEY).agg(F.count("*").alias("message_count"), *(saturating_sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_tokens")))
    called = tool_call.groupBy(*KEY).agg(F.count("*").alias("tool_call_count"))
    whole = heads.join(counted, KEY, "left").join(called, KEY, "left").join(titles, KEY, "left").join(noted, KEY, "left")

    def total(c: str) -> Column:
        return (F.coalesce(f"total_{c}", c) if f"total_{c}" in heads.columns else F.col(c)).alias(c)

    session = whole.select(
        *KEY, F.col("session_id").alias("id"), "native_session_id", "dedupe_key", F.coalesce("title", "asked").alias("title"), (F.col("title").isNull() & F.col("asked").isNotNull()).alias("title_is_synthetic"), "started_at", "ended_at",
        F.coalesce("message_count", F.lit(0)).alias("message_count"), F.coalesce("tool_call_count", F.lit(0)).alias("tool_call_count"), total("input_tokens"), total("output_tokens"), total("cache_tokens"), "primary_model", "agent_version",
        F.when(F.col("parse_note").isNotNull(), "partial").otherwise("ok").alias("parse_status"), "parse_note",
    )
    return {
        "agent_session": session.drop("path"),
        "message": message.drop(*KEY),
        "message_part": part,
        "tool_call": tool_call.drop(*KEY, "call_seq"),
        "file_event": file_event,
        "session_segment": segment,
        "session_source": sources,
        "native_ids": named.select("session_id", "native_session_id"),
        "failures": failures,
        "notes": every,
    }


def of_both(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables of a batch that holds files of both vendors."""
    a = vendor_a(lines.where("agent_id = 'claude-code'"))
    b = vendor_b(lines.where("agent_id = 'codex'"))
    return {name: a[name].unionByName(b[name]) for name in a}


def search_fields(tables: dict[str, DataFrame]) -> DataFrame:
    """The texts that are scanned, and whether they are indexed."""
    titles = tables["agent_session"].where("title is not null and not title_is_synthetic").select(F.col("id").alias("session_id"), F.lit("session").alias("source_kind"), F.col("id").alias("source_id"), F.lit("title").alias("field"), F.col("title").alias("text"), F.lit(True).alias("index"))
    parts = tables["message_part"].select("session_id", F.lit("message_part").alias("source_kind"), F.col("id").alias("source_id"), F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("text"), F.col("searchable").alias("index")), F.struct(F.lit("content_json").alias("field"), F.col("content_json").alias("text"), F.lit(False).alias("index")))).alias("x"))
    patches = tables["file_event"].where("patch_text is not null").select("session_id", F.lit("file_event").alias("source_kind"), F.col("id").alias("source_id"), F.lit("patch").alias("field"), F.col("patch_text").alias("text"), F.lit(True).alias("index"))
    return titles.unionByName(parts.select("session_id", "source_kind", "source_id", "x.*").where("text is not null")).unionByName(patches)


def search_documents(shown: DataFrame, sessions: DataFrame) -> DataFrame:
    """Search documents with a surrogate number that depends on their keys alone, and their session's sort keys."""
    keys = sessions.select(F.col("id").alias("session_id"), "started_at", "agent_id")
    did = F.xxhash64("session_id", "source_kind", "source_id", "field").bitwiseAND(F.lit((1 << 63) - 1))
    return shown.join(keys, "session_id").select(did.alias("did"), "session_id", "source_kind", "source_id", "field", F.lit(0).alias("ordinal"), "text", "started_at", "agent_id")

