import os

import pytest

from transcripta.sources import watched as source


@pytest.fixture
def folders(tmp_path):
    for name in ("root", "state", "checkpoint"):
        (tmp_path / name).mkdir()
    return tmp_path


def batches(spark, folders, **options):
    """What has arrived since the last run: a list of (path, kind, size, old_size) for each batch."""
    seen = []

    def batch(rows, _):
        seen.append(sorted((os.path.basename(r.path), r.kind, r.size, r.old_size) for r in rows.collect()))

    stream = source.watched(spark, {"claude-code": [f"file://{folders}/root"]}, f"file://{folders}/state", **options)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"file://{folders}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return [b for b in seen if b]


def test_all_kinds_of_change_arrive_across_restarts(spark, folders):
    root = folders / "root"
    (root / "deep").mkdir()
    (root / "a.jsonl").write_text("1\n")
    (root / "deep" / "b.jsonl").write_text("22\n")
    (root / "other.txt").write_text("no transcript")
    assert batches(spark, folders) == [[("a.jsonl", "new", 2, None), ("b.jsonl", "new", 3, None)]]
    assert batches(spark, folders) == []
    with (root / "a.jsonl").open("a") as f:
        f.write("3\n")
    (root / "deep" / "b.jsonl").write_text("9\n")
    (root / "c.jsonl").write_text("")
    assert batches(spark, folders) == [[("a.jsonl", "grown", 4, 2), ("b.jsonl", "shrunk", 2, 3), ("c.jsonl", "new", 0, None)]]
    (root / "a.jsonl").write_text("5\n6\n")
    os.utime(root / "a.jsonl", ns=(1, 10**18))
    (root / "c.jsonl").unlink()
    assert batches(spark, folders) == [[("a.jsonl", "touched", 4, 4), ("c.jsonl", "deleted", 0, 0)]]
    assert batches(spark, folders) == []
    # committed listings go; a batch is committed when the next is planned
    assert len([p for p in os.listdir(folders / "state") if p.isdigit()]) <= 2


def test_a_failed_batch_comes_again_whole(spark, folders):
    root = folders / "root"
    (root / "a.jsonl").write_text("1\n")

    def broken(rows, _):
        raise RuntimeError("stopped")

    stream = source.watched(spark, {"codex": [f"file://{root}"]}, f"file://{folders}/state")
    query = stream.writeStream.foreachBatch(broken).option("checkpointLocation", f"file://{folders}/checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination()
    (root / "b.jsonl").write_text("2\n")
    # the failed batch as it was, then what has come since
    assert [row for _ in range(2) for b in batches(spark, folders) for row in b] == [("a.jsonl", "new", 2, None), ("b.jsonl", "new", 2, None)]


def test_batches_are_bounded_and_quiet_files_wait(folders):
    root = folders / "root"
    for k in range(5):
        (root / f"{k}.jsonl").write_text("x")
        os.utime(root / f"{k}.jsonl", ns=(k, k))
    options = {"roots": f'[["a", "{root}"]]', "state": str(folders / "state"), "most": "2"}
    reader, at, seen = source._Reader(options), {"listing": 0}, []
    while (end := reader.latestOffset()) != at:
        seen.append([os.path.basename(r[1]) for p in reader.partitions(at, end) for r in reader.read(p)])
        reader.commit(end)
        at = end
    assert seen == [["0.jsonl", "1.jsonl"], ["2.jsonl", "3.jsonl"], ["4.jsonl"]]
    (root / "new.jsonl").write_text("x")
    assert source._Reader(options | {"quiet_ms": "60000"}).latestOffset() == at
    assert source._Reader(options | {"roots": '[["a", "/not/there"]]'}).latestOffset() != at


def test_the_longest_root_owns_a_file(folders):
    (folders / "root" / "in").mkdir()
    (folders / "root" / "in" / "x.jsonl").write_text("")
    found = source.listed([("inner", str(folders / "root" / "in")), ("outer", str(folders / "root"))], ".jsonl")
    assert [a for a, *_ in found.values()] == ["inner"]
