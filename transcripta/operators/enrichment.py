"""Git enrichment: what still has to be resolved or checked again, and a pass that does only that.

Facts of folders (``git_facts``) say when they were taken (``taken_at``).  A segment is
unresolved while it has a folder and no repository.  A recorded commit is a target of
verification while nothing has been found out about it since the facts of its folder
were taken.  Both lists are joins over whole tables, so a second pass finds them empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import det_id
from ..schemas import KEYS
from .git_facts import captured, evidence, identified, linked, repositories, worktrees
from .lifecycle import Archive, inserted_new, replaced_by_key, upserted
from .scratch import settled


def unresolved_segments(segments: DataFrame) -> DataFrame:
    """(id, session_id, cwd) of the segments with a folder and no repository."""
    return segments.where("cwd is not null and repository_id is null").select("id", "session_id", "cwd")


def reverify_targets(segments: DataFrame, observations: DataFrame, worktrees_: DataFrame) -> DataFrame:
    """Recorded commits and the place to check each: the segment's worktree, else its folder."""
    recorded = observations.where("source = 'agent_recorded' and commit_sha is not null").select("segment_id", "branch", "commit_sha")
    places = worktrees_.select(F.col("id").alias("worktree_id"), F.col("path").alias("_path"))
    joined = segments.select(F.col("id").alias("segment_id"), "session_id", "repository_id", "worktree_id", "cwd").join(recorded, "segment_id").join(places, "worktree_id", "left")
    return joined.withColumn("path", F.coalesce("_path", "cwd")).where("path is not null").select("segment_id", "session_id", "repository_id", "worktree_id", "path", "branch", "commit_sha")


def unverified(targets: DataFrame, observations: DataFrame, taken: DataFrame) -> DataFrame:
    """The targets that nothing was found out about since the facts of their path were taken (path, taken_at)."""
    done = observations.where("source = 'reverified'").groupBy("segment_id", "commit_sha").agg(F.max("observed_at").alias("_done"))
    times = taken.groupBy("path").agg(F.max("taken_at").alias("taken_at"))
    joined = targets.join(times, "path").join(done, ["segment_id", "commit_sha"], "left")
    return joined.where("_done is null or _done < taken_at").drop("_done")


def verdicts(targets: DataFrame, commits: DataFrame, refs: DataFrame, missing: DataFrame) -> DataFrame:
    """What is there now of each target: an observation of its own beside the recorded one.

    ``commits`` (repository_id, commit_sha) and ``refs`` (repository_id, branch,
    commit_sha) are what repositories hold, ``missing`` (path, reason) places that
    can't be read: nothing is known about their commits.
    """
    there = commits.select("repository_id", "commit_sha").distinct().withColumn("_commit", F.lit(True))
    tips = refs.groupBy("repository_id", "branch").agg(F.max("commit_sha").alias("_tip"))
    gone = missing.groupBy("path").agg(F.min("reason").alias("_reason"))
    joined = targets.join(there, ["repository_id", "commit_sha"], "left").join(tips, ["repository_id", "branch"], "left").join(gone, "path", "left")
    exists = F.when(F.col("_reason").isNull(), F.coalesce("_commit", F.lit(False)))
    found = F.to_json(F.struct(exists.alias("commit_exists"), F.col("_tip").isNotNull().alias("branch_exists"), F.col("_tip").eqNullSafe(F.col("commit_sha")).alias("branch_at_recorded_commit")))
    return joined.select(
        det_id("gr", F.col("session_id"), F.col("segment_id"), F.col("commit_sha")).alias("id"), "session_id", "segment_id", "worktree_id",
        F.lit("reverified").alias("source"), F.lit("retrospective").alias("temporal_confidence"), "branch", "commit_sha", exists.alias("commit_exists"),
        F.when(F.col("_reason").isNotNull(), F.to_json(F.struct(F.col("_reason").alias("unavailable")))).otherwise(found).alias("metadata_json"), F.col("_reason").isNotNull().alias("worktree_missing"),
        F.col("taken_at").alias("observed_at"),
    )


def merged_repositories(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Repositories by identity: the first path and time stay, the rest is new."""
    dated = new.withColumns({"created_at": now, "updated_at": now})
    return upserted(old, dated, KEYS["repository"], ["primary_path", "created_at"])


def enrich(archive: Archive, facts: DataFrame, now: Column) -> dict[str, int]:
    """Resolves segments whose folder has facts; how many were waiting, and how many are linked now.

    The segments are written last: a pass that dies leaves them waiting, and the next
    writes the same rows again.
    """
    segments = archive.read("session_segment")
    known = settled(identified(facts), "enrich-facts")
    watch = Observation(f"enrich-{uuid.uuid4().hex}")
    waiting = unresolved_segments(segments).join(known.select("cwd").distinct().withColumn("_known", F.lit(True)), "cwd", "left")
    waiting = settled(waiting.observe(watch, F.count("*").alias("waiting"), F.count("_known").alias("linked")), "enrich-waiting")
    report = {"waiting": watch.get["waiting"], "linked": watch.get["linked"]}
    if not report["linked"]:
        return report
    todo = segments.join(waiting.where("_known").select("id"), "id", "left_semi")
    used = settled(known.join(waiting.select("cwd").distinct(), "cwd", "left_semi"), "enrich-used")
    archive.write("repository", merged_repositories(archive.read("repository"), archive.shaped("repository", repositories(used)), now))
    archive.merge("worktree", archive.shaped("worktree", worktrees(used)))
    archive.write("repository_identity_evidence", inserted_new(archive.read("repository_identity_evidence"), archive.shaped("repository_identity_evidence", evidence(used)), KEYS["repository_identity_evidence"]))
    seen = captured(todo, used, 0).withColumn("observed_at", now)
    archive.write("git_observation", replaced_by_key(archive.read("git_observation"), archive.shaped("git_observation", seen), KEYS["git_observation"]))
    archive.merge("session_segment", archive.shaped("session_segment", linked(todo, used)))
    return report


def reverify(archive: Archive, facts: DataFrame, commits: DataFrame, refs: DataFrame, missing: DataFrame) -> int:
    """Checks the recorded commits that are due; worktrees that are missing are marked.  How many were checked."""
    observations, trees = archive.read("git_observation"), archive.read("worktree")
    taken = facts.select(F.explode(F.array("cwd", "workdir")).alias("path"), "taken_at").where("path is not null").unionByName(missing.select("path", "taken_at"))
    due = unverified(reverify_targets(archive.read("session_segment"), observations, trees), observations, taken)
    watch = Observation(f"reverify-{uuid.uuid4().hex}")
    found = settled(verdicts(due, commits, refs, missing).observe(watch, F.count("*").alias("n")), "reverify")
    if watch.get["n"]:
        gone = found.where("worktree_missing and worktree_id is not null").select(F.col("worktree_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
        marked = trees.join(gone, "id", "left").withColumn("is_missing", F.coalesce("_gone", "is_missing")).select(*trees.columns)
        archive.write("worktree", marked)
        archive.write("git_observation", replaced_by_key(observations, archive.shaped("git_observation", found), KEYS["git_observation"]))
    return watch.get["n"]
