"""Registered queries of enrichment, sources, and figures by key, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantiles
from ..operators import browse, enrichment
from ..operators.ingest import found_sources
from .catalog import QUERIES, SQL, _registered, table

__all__ = ["QUERIES", "SQL"]


# Orders stand for segments, customers for worktrees, line items for observations.

_SEGMENTS = """segments as (select o_orderkey id, o_custkey session_id, case when o_orderkey % 3 = 0 then null else o_clerk end cwd, case when o_custkey % 4 = 0 then o_custkey end repository_id, case when o_orderkey % 2 = 0 then o_custkey end worktree_id from orders)"""


def _segments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_clerk", F.concat(F.lit("clerk"), F.col("o_custkey") % 10))
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_clerk")).alias("cwd"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_custkey")).alias("repository_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("worktree_id"))


_OWN = _SEGMENTS.replace("o_clerk", "'clerk' || (o_custkey % 10)")


@_registered(f"with {_OWN} select id, session_id, cwd from segments where cwd is not null and repository_id is null")
def unresolved_segments(spark, sf_dir):
    return enrichment.unresolved_segments(_segments(spark, sf_dir))


_TARGETS = f"""with {_OWN},
observations as (select l_orderkey segment_id, 'b' || l_linenumber branch, case when l_linenumber % 3 > 0 then l_partkey::varchar end commit_sha, case when l_returnflag = 'R' then 'agent_recorded' when l_returnflag = 'A' then 'reverified' else 'captured' end source, l_linenumber * 10 observed_at from lineitem),
worktrees as (select c_custkey id, c_name path from customer where c_custkey % 5 <> 0),
targets as (select s.id segment_id, s.session_id, s.repository_id, s.worktree_id, coalesce(w.path, s.cwd) path, o.branch, o.commit_sha from segments s
  join observations o on o.segment_id = s.id and o.source = 'agent_recorded' and o.commit_sha is not null left join worktrees w on w.id = s.worktree_id where coalesce(w.path, s.cwd) is not null)"""


def _observations(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "R", "agent_recorded").when(F.col("l_returnflag") == "A", "reverified").otherwise("captured")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.concat(F.lit("b"), "l_linenumber").alias("branch"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_partkey").cast("string")).alias("commit_sha"), source.alias("source"), (F.col("l_linenumber") * 10).alias("observed_at"))


def _targets(spark, sf_dir):
    trees = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"))
    return enrichment.reverify_targets(_segments(spark, sf_dir), _observations(spark, sf_dir), trees)


@_registered(f"{_TARGETS} select segment_id, session_id, repository_id, worktree_id, path, branch, commit_sha from targets")
def reverify_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@_registered(f"""{_TARGETS}, taken as (select c_name path, 20 + c_custkey % 40 taken_at from customer union all select 'clerk' || i, 30 from range(10) r(i)),
times as (select path, max(taken_at) taken_at from taken group by 1),
done as (select segment_id, commit_sha, max(observed_at) done from observations where source = 'reverified' group by 1, 2)
select t.segment_id, t.commit_sha, t.path, taken_at from targets t join times using (path) left join done using (segment_id, commit_sha) where done is null or done < taken_at""")
def unverified_targets(spark, sf_dir):
    folders = table(spark, sf_dir, "customer").select(F.concat(F.lit("clerk"), F.col("c_custkey") % 10).alias("path"), F.lit(30).alias("taken_at")).distinct()
    taken = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), (20 + F.col("c_custkey") % 40).alias("taken_at")).unionByName(folders)
    return enrichment.unverified(_targets(spark, sf_dir), _observations(spark, sf_dir), taken).select("segment_id", "commit_sha", "path", "taken_at")


# Documents stand for files: those of even number were seen before, some at another path.


@_registered("""with f as (select doc_id, 'p' || doc_id path, 'n' || doc_id % 400 native, md5(coalesce(text, '')) hash, source agent from documents),
old as (select doc_id id, agent, native, hash, case when doc_id % 6 = 0 then path else 'gone/' || path end path, doc_id % 7 seen from f where doc_id % 2 = 0),
here as (select f.doc_id, o.id from f join old o using (agent, path)),
best as (select *, row_number() over (partition by agent, native, hash order by seen desc, id) k from old),
moved as (select f.doc_id, f.path, b.id from f join best b on b.agent = f.agent and b.native = f.native and b.hash = f.hash and b.k = 1 where f.doc_id not in (select doc_id from here) and b.id not in (select id from here)),
first as (select id, arg_min(doc_id, path) doc_id from moved group by 1)
select f.doc_id, coalesce(h.id, m.id) known from f left join here h on h.doc_id = f.doc_id left join first m on m.doc_id = f.doc_id""")
def moved_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.lit("p"), "doc_id").alias("path"), F.concat(F.lit("n"), F.col("doc_id") % 400).alias("native_file_id"), F.md5(F.coalesce("text", F.lit(""))).alias("full_hash"), F.col("source").alias("agent_id"))
    old = files.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "agent_id", "native_file_id", "full_hash", F.when(F.col("doc_id") % 6 == 0, F.col("path")).otherwise(F.concat(F.lit("gone/"), "path")).alias("path"), (F.col("doc_id") % 7).alias("last_seen_at"), F.lit(0).alias("size"), F.lit("").alias("prefix_hash"), F.lit(0).alias("generation"))
    states = old.select(F.col("id").alias("source_artifact_id"), F.lit("1").alias("parser_version"), F.lit("ok").alias("status"))
    return found_sources(files, old, states).select("doc_id", F.col("known.id").alias("known"))


@_registered("select e.event_id, e.user_id, d.source, length(d.text) size from events e join documents d on e.event_id = d.doc_id")
def patch_blobs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_id").alias("patch_blob_id"))
    blobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scan_state"), F.col("text").alias("content"))
    return browse.patches(events, blobs).select(F.col("id").alias("event_id"), F.col("session_id").alias("user_id"), F.col("scan_state").alias("source"), F.length("content").alias("size"))


@_registered("select event_type, count(value) n, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95 from events group by 1")
def value_percentiles(spark, sf_dir):
    return quantiles.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
