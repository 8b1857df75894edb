"""Git evidence: captured facts become repositories, worktrees, evidence and observations.

Facts are an input table: cwd, common_dir, workdir, branch, head, detached, dirty,
remotes (array), roots (array), truncated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import det_id, fnv1a_hex, normalized_remote


def clean_remotes(facts: DataFrame) -> DataFrame:
    remotes = F.array_sort(F.array_distinct(F.filter(F.transform("remotes", normalized_remote), lambda r: r.isNotNull())))
    return facts.withColumn("remotes", F.coalesce(remotes, F.array().cast("array<string>")))


def identified(facts: DataFrame) -> DataFrame:
    """Adds identity_key, identity_confidence, display_name and repository_id."""
    facts = clean_remotes(facts)
    remote = F.size("remotes") > 0
    roots = F.coalesce(F.size("roots") > 0, F.lit(False)) & ~F.coalesce("truncated", F.lit(False))
    common = fnv1a_hex(F.col("common_dir"))
    key = (
        F.when(remote & roots, F.concat(F.lit("rr:"), fnv1a_hex(F.array_join(F.concat("remotes", "roots"), "\n"))))
        .when(remote, F.concat(F.lit("r:"), fnv1a_hex(F.array_join("remotes", "\n"))))
        .otherwise(F.concat(F.lit("gcd:"), common))
    )
    confidence = F.when(remote & ~roots, "medium").otherwise("high")
    local = F.element_at(F.split(F.regexp_replace("workdir", "/+$", ""), "/"), -1)
    name = F.when(remote, F.element_at(F.split(F.get("remotes", F.lit(0)), "/"), -1)).otherwise(local)
    out = facts.withColumns({"identity_key": key, "identity_confidence": confidence, "common_key": common})
    return out.withColumn("display_name", F.coalesce(F.when(name != "", name), local, "identity_key")).withColumn("repository_id", det_id("repo", F.col("identity_key")))


def repositories(known: DataFrame) -> DataFrame:
    return known.groupBy(F.col("repository_id").alias("id"), "identity_key").agg(F.min("display_name").alias("display_name"), F.min("workdir").alias("primary_path"), F.min("identity_confidence").alias("identity_confidence"), F.lit(False).alias("is_missing"))


def worktrees(known: DataFrame) -> DataFrame:
    return known.select(det_id("wt", F.col("repository_id"), F.col("workdir")).alias("id"), "repository_id", F.col("workdir").alias("path"), (F.col("common_dir") == F.concat("workdir", F.lit("/.git"))).alias("is_main"), F.lit(False).alias("is_missing")).dropDuplicates(["id"])


def evidence(known: DataFrame) -> DataFrame:
    """A row for the common folder, for each remote and for the set of roots."""

    def one(kind: str, value, confidence: str):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value_hash"), F.lit(confidence).alias("confidence"))

    rows = F.concat(
        F.array(one("git_common_dir", F.col("common_key"), "high")),
        F.transform("remotes", lambda r: one("remote", fnv1a_hex(r), "medium")),
        F.when((F.size("roots") > 0) & ~F.coalesce("truncated", F.lit(False)), F.array(one("root_set", fnv1a_hex(F.array_join("roots", "\n")), "low"))).otherwise(F.array().cast("array<struct<kind:string,value_hash:string,confidence:string>>")),
    )
    out = known.select("repository_id", F.explode(rows).alias("e")).select("repository_id", "e.kind", "e.value_hash", "e.confidence")
    return out.select(det_id("ev", F.col("repository_id"), F.col("kind"), F.col("value_hash")).alias("id"), "*").dropDuplicates(["id"])


def linked(segments: DataFrame, known: DataFrame) -> DataFrame:
    """Segments with the repository and worktree of their folder, where facts have it."""
    found = known.select("cwd", F.col("repository_id").alias("_r"), det_id("wt", F.col("repository_id"), F.col("workdir")).alias("_w"), F.col("identity_confidence").alias("_c")).dropDuplicates(["cwd"])
    joined = segments.join(found, "cwd", "left")
    return joined.withColumns({"repository_id": F.coalesce("repository_id", "_r"), "worktree_id": F.coalesce("worktree_id", "_w"), "resolution_confidence": F.coalesce("_c", "resolution_confidence")}).drop("_r", "_w", "_c").select(*segments.columns)


def captured(segments: DataFrame, known: DataFrame, observed_at: int) -> DataFrame:
    """What the folder's repository looked like when facts were taken."""
    now = known.select("cwd", "branch", "head", "detached", "dirty", F.get("remotes", F.lit(0)).alias("remote")).dropDuplicates(["cwd"])
    rows = segments.select(F.col("id").alias("segment_id"), "session_id", "cwd").join(now, "cwd")
    return rows.select(det_id("gc", F.col("segment_id")).alias("id"), "session_id", "segment_id", F.lit("captured").alias("source"), F.lit("current_only").alias("temporal_confidence"), "branch", F.col("head").alias("commit_sha"), F.col("detached").alias("is_detached"), F.col("dirty").alias("is_dirty"), F.col("remote").alias("remote_url_norm"), F.lit(observed_at).cast("long").alias("observed_at"))


def recorded(segments: DataFrame) -> DataFrame:
    """What agents recorded of Git: one observation for each segment with a branch or commit."""
    rows = segments.where("git_branch is not null or git_commit_sha is not null")
    return rows.select(det_id("g", F.col("session_id"), F.col("segment_ix")).alias("id"), "session_id", F.col("id").alias("segment_id"), F.lit("agent_recorded").alias("source"), F.lit("near_event").alias("temporal_confidence"), F.col("git_branch").alias("branch"), F.col("git_commit_sha").alias("commit_sha"), normalized_remote(F.col("git_remote_url")).alias("remote_url_norm"))


def reverified(observations: DataFrame, commits: DataFrame, refs: DataFrame, observed_at: int) -> DataFrame:
    """Recorded observations against what repositories hold now.

    ``commits`` (repository_id, commit_sha) and ``refs`` (repository_id, branch,
    commit_sha) are what is there; observations carry their repository_id.
    """
    there = commits.select("repository_id", "commit_sha").distinct().withColumn("_commit", F.lit(True))
    tips = refs.select("repository_id", "branch", F.col("commit_sha").alias("_tip")).dropDuplicates(["repository_id", "branch"])
    joined = observations.join(there, ["repository_id", "commit_sha"], "left").join(tips, ["repository_id", "branch"], "left")
    return joined.withColumns(
        {
            "commit_exists": F.when(F.col("commit_sha").isNotNull(), F.coalesce("_commit", F.lit(False))),
            "branch_exists": F.when(F.col("branch").isNotNull(), F.col("_tip").isNotNull()),
            "branch_at_commit": F.when(F.col("_tip").isNotNull(), F.col("_tip").eqNullSafe(F.col("commit_sha"))),
            "source": F.lit("reverified"),
            "temporal_confidence": F.lit("retrospective"),
            "observed_at": F.lit(observed_at).cast("long"),
        }
    ).drop("_commit", "_tip")
