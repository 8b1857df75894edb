"""Transcript files: discovery, ownership, and lines with byte offsets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import det_id, stem_of

MOST_BYTES = 64 << 20
VENDORS = {"claude-code": "*.jsonl", "codex": "rollout-*.jsonl"}
#: Levels below a root in which the second vendor keeps its files.
MOST_DEPTH = {"codex": 5}
MOST_ROOTS = 16


def default_roots(environment: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Where the agents keep their transcripts."""
    env = os.environ if environment is None else environment
    home = env.get("HOME", "")
    first = env.get("CLAUDE_CONFIG_DIR") or f"{home}/.claude"
    return {"claude-code": [f"{first}/projects"], "codex": [f"{home}/.codex/sessions", f"{home}/.codex/archived_sessions"]}


def without_root(roots: list[str], path: str) -> list[str]:
    """``roots`` without one of them."""
    return [r for r in roots if r != path.rstrip("/")]


def discovery(spark: SparkSession, roots: dict[str, list[str]] | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """All agents' files below their default and own roots, but for the disabled agents; roots that aren't there have none."""
    found = None
    for agent, places in default_roots().items():
        for place in [] if agent in disabled else sorted({*places, *(roots or {}).get(agent, [])}):
            folder = spark._jvm.org.apache.hadoop.fs.Path(place)
            if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                files = discovered(spark, agent, [place])
                found = files if found is None else found.unionByName(files)
    return spark.createDataFrame([], "agent_id string, path string, modificationTime timestamp, length bigint, content binary") if found is None else found.dropDuplicates(["agent_id", "path"])


def installations(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """(agent_id, root, there, files, newest) of each root: whether it exists, and what transcripts lie below it."""
    rows = [(agent, root.rstrip("/")) for agent, places in sorted(roots.items()) for root in places]
    places = spark.createDataFrame(rows, "agent_id string, root string")
    found = None
    for agent, root in rows:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            # names and times alone are listed
            files = discovered(spark, agent, [root]).select("agent_id", F.lit(root).alias("root"), "modificationTime")
            counted = files.groupBy("agent_id", "root").agg(F.count("*").alias("files"), F.max("modificationTime").alias("newest"))
            one = spark.createDataFrame([(agent, root, True)], "agent_id string, root string, there boolean").join(counted, ["agent_id", "root"], "left")
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = places.limit(0).select("*", F.lit(True).alias("there"), F.lit(0).cast("long").alias("files"), F.lit(None).cast("timestamp").alias("newest"))
    return places.join(found, ["agent_id", "root"], "left").select("agent_id", "root", F.coalesce("there", F.lit(False)).alias("there"), F.coalesce("files", F.lit(0)).alias("files"), "newest")


def with_root(roots: list[str], path: str) -> list[str]:
    """``roots`` and one more: absolute, each once, at most MOST_ROOTS."""
    if not path.startswith("/") and "://" not in path:
        raise ValueError("a root is an absolute path")
    found = sorted({*roots, path.rstrip("/")})
    if len(found) > MOST_ROOTS:
        raise ValueError(f"at most {MOST_ROOTS} roots")
    return found


def discovered(spark: SparkSession, agent_id: str, roots: list[str]) -> DataFrame:
    """(agent_id, path, modificationTime, length, content) of an agent's files, each once."""
    found = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", VENDORS[agent_id]).load(root)
        if agent_id in MOST_DEPTH:
            below = F.size(F.split(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "/")) - len(root.split("://")[-1].rstrip("/").split("/"))
            files = files.where(below <= MOST_DEPTH[agent_id] + 1)
        found = files if found is None else found.unionByName(files)
    return found.dropDuplicates(["path"]).select(F.lit(agent_id).alias("agent_id"), "*")


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the agent of the longest root (agent_id, root) above it."""
    # roots are settings: MOST_ROOTS for each agent
    found = paths.join(F.broadcast(roots), F.col("path").startswith(F.concat("root", F.lit("/"))), "left")
    return found.groupBy(*paths.columns).agg(F.max_by("agent_id", F.length("root")).alias("agent_id"))


def lines(files: DataFrame) -> DataFrame:
    """(agent_id, path, line_no, byte_offset, raw) of the lines that say something.

    Lines are cut at line feeds; offsets count bytes.  Files over MOST_BYTES are
    left to ``oversized``.
    """
    texts = files.where(F.col("length") <= MOST_BYTES).select("agent_id", "path", F.expr("make_valid_utf8(cast(content as string))").alias("text"))
    placed = texts.select("agent_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "piece"))
    size = F.octet_length("piece").cast("long") + 1
    in_file = Window.partitionBy("agent_id", "path").orderBy("line_no")
    placed = placed.withColumn("byte_offset", F.sum(size).over(in_file.rowsBetween(Window.unboundedPreceding, 0)) - size)
    return placed.select("agent_id", "path", F.col("line_no").cast("long").alias("line_no"), "byte_offset", F.regexp_replace("piece", r"^\s+|\s+$", "").alias("raw")).where("raw <> ''")


def oversized(files: DataFrame) -> DataFrame:
    """A shell of a session for each file that is too large to parse."""
    large = files.where(F.col("length") > MOST_BYTES)
    return large.select(det_id("s", F.col("agent_id"), stem_of(F.col("path"))).alias("id"), "agent_id", stem_of(F.col("path")).alias("dedupe_key"), F.lit("partial").alias("parse_status"), F.lit("source exceeds the size limit").alias("parse_note"), F.lit(0).cast("long").alias("message_count"), F.lit(0).cast("long").alias("tool_call_count"))


def synthetic(spark: SparkSession, sessions: int, turns: int, seed: int = 1) -> DataFrame:
    """(agent_id, path, raw, line_no): a deterministic corpus of both vendors' lines."""
    rows = spark.range(sessions).select(F.col("id").alias("session"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    word = F.concat(F.lit("w"), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "session", "turn")), 1, 3), 16, 10))
    time = F.concat(F.lit("2026-01-01T"), F.lpad((F.col("turn") / 3600 % 24).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("turn") / 60 % 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("Z"))
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    first = F.to_json(F.struct(role.alias("type"), F.concat_ws("-", F.lit("u"), "session", "turn").alias("uuid"), F.concat(F.lit("a-"), F.col("session")).alias("sessionId"), time.alias("timestamp"), F.lit("/repo").alias("cwd"), F.struct(role.alias("role"), F.concat(F.lit("add health check "), word).alias("content")).alias("message")))
    second = F.to_json(F.struct(F.lit("response_item").alias("type"), time.alias("timestamp"), F.struct(F.lit("message").alias("type"), role.alias("role"), F.concat(F.lit("retry with backoff "), word).alias("content")).alias("payload")))
    even = F.col("session") % 2 == 0
    return rows.select(F.when(even, "claude-code").otherwise("codex").alias("agent_id"), F.concat(F.when(even, "a-").otherwise("rollout-"), F.col("session"), F.lit(".jsonl")).alias("path"), F.col("turn").cast("long").alias("line_no"), F.when(even, first).otherwise(second).alias("raw"))
