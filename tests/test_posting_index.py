"""The segmented index against the scan: built, grown, thinned out, merged, compacted and read by bounds."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from transcripta.operators import posting_index, scratch, search
from transcripta.operators.posting_index import Index

WORDS = ["common", "often", "seldom", "rare", "café", "мой", "한국"]


def drawn(low, high, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices(WORDS, weights=[30, 15, 5, 1, 3, 3, 2], k=rng.choice([1, 3, 10, 60])))) for k in range(low, high)]
    return [*rows, (high, None), (high + 1, "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "did long, text string")


def ranks(hits):
    return {r.did: round(r["rank"], 9) for r in hits.collect()}


def agrees(spark, index, rows, *terms):
    assert ranks(index.ranked(list(terms))) == ranks(search.ranked(frame(spark, rows), list(terms)))


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, f"file://{tmp_path}/index")


def test_index_ranks_as_the_scan_does(spark, index):
    rows = drawn(0, 300, 1)
    index.build(frame(spark, rows).repartition(3))
    for terms in (["common"], ["CAFÉ", "common"], ["common-often", "seldom"], ["Мой"], ["rare", "rare"], ["nowhere", "common"]):
        agrees(spark, index, rows, *terms)
    assert index.ranked(["--"]).count() == 0


def test_adding_writes_its_own_rows_alone(spark, index):
    rows = dict(drawn(0, 300, 2))
    index.build(frame(spark, list(rows.items())))
    before = index.segments()[0]
    more = {7: "changed entirely", 1000: "rare common", 1001: "seldom"}
    index.add(frame(spark, list(more.items())))
    first, second = index.segments()
    # the old segment is the same files; the new one has only the batch, tombstones only what it replaces
    assert first.name == before.name and (second.documents, sum(n for n, _ in first.gone.values())) == (3, 1)
    assert spark.read.parquet(f"{index.path}/segments/{second.name}/postings").agg(F.sum("n")).first()[0] == 5
    rows |= more
    for terms in (["common"], ["entirely"], ["rare", "common"]):
        agrees(spark, index, list(rows.items()), *terms)


def test_dropping_merging_and_compacting(spark, index, monkeypatch):
    monkeypatch.setattr(posting_index, "TIER", 4)
    rows = {}
    for k in range(5):
        more = dict(drawn(40 * k, 40 * k + 60, k))
        rows |= more
        index = index.add(frame(spark, list(more.items())))
    assert len(index.segments()) == 2
    agrees(spark, index, list(rows.items()), "common", "often")
    gone = [d for d in rows if d % 3 == 0]
    index.without(frame(spark, [(d, None) for d in gone]))
    rows = {d: t for d, t in rows.items() if d % 3}
    agrees(spark, index, list(rows.items()), "common", "often")
    agrees(spark, index, list(rows.items()), "common-often")
    index.compacted()
    assert len(index.segments()) == 1 and not index.segments()[0].gone
    agrees(spark, index, list(rows.items()), "common-often")
    # what was dropped is in no file any more
    left = spark.read.parquet(f"{index.path}/segments/*/postings").select(F.explode("entries.did").alias("did"))
    assert left.where(F.col("did") % 3 == 0).isEmpty()
    index.without(frame(spark, list(rows.items())))
    assert index.ranked(["common"]).count() == 0 and index.totals() == (0, 0.0)


@pytest.mark.parametrize("terms", [["common"], ["often", "common"], ["rare"], ["common", "common", "seldom"]])
def test_bounds_give_the_same_page(spark, index, monkeypatch, terms):
    monkeypatch.setattr(posting_index, "FIRST_GROUPS", 1)
    rows = drawn(0, 2000, 9)
    index.build(frame(spark, rows))
    full = sorted((r["rank"], r.did) for r in index.ranked(terms).collect())
    for limit in (1, 20):
        best = sorted((r["rank"], r.did) for r in index.best(terms, limit).collect())
        assert best[:limit] == full[:limit] and {x for x in full if x[0] <= full[min(limit, len(full)) - 1][0]} <= set(best)
    after = full[len(full) // 2][0]
    rest = [x for x in full if x[0] >= after]
    assert sorted((r["rank"], r.did) for r in index.best(terms, 20, after).collect())[:20] == rest[:20]


def test_bounds_leave_most_groups_unread(spark, index):
    """A few short documents are all about a word that every document holds: their groups decide the page."""
    rows = [(k, f"common {' '.join(f'w{(k * 31 + j) % 997}' for j in range(30))}") for k in range(6000)] + [(10_000 + k, "common common common") for k in range(60)]
    index.build(frame(spark, rows))
    best = index.best(["common"], 50)
    plan = best._jdf.queryExecution().executedPlan()

    def scanned(node):
        node = node.finalPhysicalPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node
        children = node.children()
        over_scan = node.getClass().getSimpleName() == "FilterExec" and children.apply(0).getClass().getSimpleName() in ("ColumnarToRowExec", "InputAdapter", "FileSourceScanExec")
        own = node.metrics().get("numOutputRows").get().value() if over_scan else 0
        return own + sum(scanned(children.apply(k)) for k in range(children.size()))

    assert {r.did for r in best.collect()} == {d for d, _ in rows if d >= 10_000}
    groups = index._rows(["common"]).count()
    assert groups > 40 and scanned(plan) <= groups // 2


def test_two_documents_of_one_number_are_refused(spark, index):
    with pytest.raises(ValueError):
        index.build(frame(spark, [(1, "a"), (1, "b")]))
    assert index.segments() == []


def test_a_second_writer_of_the_same_change_fails(spark, index):
    index.build(frame(spark, [(1, "a")]))
    with pytest.raises(RuntimeError):
        index._commit([], 1)


def test_a_page_of_rounded_ranks_has_all_that_tie(spark, index, monkeypatch):
    monkeypatch.setattr(posting_index, "FIRST_GROUPS", 1)
    index.build(frame(spark, drawn(0, 2000, 9)))
    full = sorted((round(r["rank"], 1), r.did) for r in index.ranked(["often"]).collect())
    best = sorted((r["rank"], r.did) for r in index.best(["often"], 20, digits=1).collect())
    assert {x for x in full if x[0] <= full[19][0]} <= set(best)


def test_tasks_are_given_one_group_at_a_time(spark, tmp_path, monkeypatch):
    from transcripta.operators import posting_index

    seen, grouped = f"{tmp_path}/seen", posting_index._grouped

    def watched(batches, number):
        import uuid

        def passed():
            for batch in batches:
                with open(f"{seen}-{batch.num_rows}-{uuid.uuid4().hex}", "w"):
                    pass
                yield batch

        yield from grouped(passed(), number)

    monkeypatch.setattr(posting_index, "_grouped", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(k, "a b " * k) for k in range(600)], "did long, text string").coalesce(1)
    index = posting_index.Index(spark, f"file://{tmp_path}/index").build(docs)
    sizes = [int(p.name.split("-")[1]) for p in tmp_path.glob("seen-*")]
    assert sum(sizes) == 600 and max(sizes) <= posting_index.GROUP
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert index.ranked(["a"]).count() == 599


def test_long_documents_make_smaller_groups():
    import pyarrow as pa

    from transcripta.operators import posting_index

    lengths = [0, 5, *[60_000] * 7, 300_000, 3, *[1] * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lengths))), pa.array([["w"] * n for n in lengths])], names=["did", "words"])
    cuts = [c.column(0).to_pylist() for c in posting_index._cut(batch)]
    assert [d for c in cuts for d in c] == list(range(len(lengths)))
    assert all(len(c) <= posting_index.GROUP and (len(c) == 1 or sum(lengths[d] for d in c) <= posting_index.MOST_WORDS) for c in cuts)
    assert len(cuts) < 12


def test_dead_entries_leave_without_taking_lists_apart(spark, tmp_path):
    from transcripta.operators.posting_index import Index

    index = Index(spark, str(tmp_path / "i")).build(spark.createDataFrame([(k, "a b" if k % 2 else "b a a") for k in range(300)], "did long, text string"))
    index.without(spark.range(0, 300, 3).withColumnRenamed("id", "did"))
    segment = index.segments()[0]
    rows = index._living(spark.read.parquet(f"{index.path}/segments/{segment.name}/postings").drop("bucket"), segment)
    assert "collect_list(e" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.term, e.did): (e.tf, list(e.places)) for r in rows.collect() for e in r.entries}
    assert got == {(t, k): (1, [0 if t == "a" else 1]) if k % 2 else ((2, [1, 2]) if t == "a" else (1, [0])) for t in "ab" for k in range(300) if k % 3}
    assert all(r.n == len(r.entries) and r.most == max(e.tf for e in r.entries) and r.span == min(e.len / e.tf for e in r.entries) for r in rows.collect())


def test_changes_leave_no_table_behind_and_deal_postings_out_once(spark, index, monkeypatch):
    plans, stored = [], Index._stored

    def watched(self, rows, name, buckets):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        stored(self, rows, name, buckets)

    monkeypatch.setattr(Index, "_stored", watched)
    rows = dict(drawn(0, 200, 5))
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with scratch.noted() as made:
            index.build(frame(spark, list(rows.items()))).without(spark.range(0, 200, 3).withColumnRenamed("id", "did"))
            index.compacted()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert {Path(x).name.rsplit("-", 1)[0] for x in made} == {"index-words", "index-gone"}
    assert not any(Path(x.removeprefix("file:")).exists() for x in made if "index-words" in x)
    # the lists of entries pass through one shuffle, by group, for the join and the files
    assert plans[1].count("REPARTITION_BY_NUM") == 1 and "REPARTITION_BY_COL" not in plans[1]
    assert spark.conf.get(cleanup) == before[0]
    agrees(spark, index, [(d, t) for d, t in rows.items() if d >= 200 or d % 3], "common", "often")
