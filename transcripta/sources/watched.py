"""A stream of what happens to transcript files: new, grown, shrunk, touched and deleted ones.

A folder is listed for each batch and the listing compared with the one before, so a
file that grows or is written anew arrives again, under the same name.  Listings are
Parquet files in the ``state`` folder, and an offset is a listing's number: it stays
small however many files there are, and a batch that runs again after a restart
compares the same two listings.  A batch brings at most ``most`` changes, those of the
oldest files first; the rest follow in the next.  Roots that aren't there yet are
empty.  A file still being written can be left until it has been quiet for ``quiet_ms``.

Options: ``roots`` (a JSON list of [agent_id, root]), ``state``, ``suffix`` (.jsonl),
``most`` (10000), ``quiet_ms`` (0), ``parts`` (8).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "watched_files"
CHANGES = "agent_id string, path string, size bigint, mtime_ms bigint, old_size bigint, kind string"
_LISTED = pa.schema([("agent_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64())])

Files = dict[str, tuple[str, int, int]]


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def listed(roots: list[tuple[str, str]], suffix: str) -> Files:
    """path -> (agent_id, size, mtime in ns) of the files below the roots; the longest root owns a file."""
    out: Files = {}
    for agent, root in sorted(roots, key=lambda r: len(r[1])):
        store, place = _opened(root)
        head = root[: len(root) - len(place)] if "://" in root else "file://"
        for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(suffix):
                out[f"{head}{info.path}"] = (agent, info.size, info.mtime_ns or 0)
    return out


def compared(old: Files, new: Files) -> list[tuple]:
    """Rows of CHANGES, in the order of times and paths."""
    rows = []
    for path, (agent, size, mtime) in new.items():
        before = old.get(path)
        if before is None:
            rows.append((mtime, agent, path, size, None, "new"))
        elif before[1:] != (size, mtime):
            rows.append((mtime, agent, path, size, before[1], "grown" if size > before[1] else "shrunk" if size < before[1] else "touched"))
    rows += ((mtime, agent, path, size, size, "deleted") for path, (agent, size, mtime) in old.items() if path not in new)
    return [(agent, path, size, mtime // 1_000_000, before, kind) for mtime, agent, path, size, before, kind in sorted(rows, key=lambda r: (r[0], r[2]))]


class _Part(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [tuple(r) for r in json.loads(options["roots"])]
        self.suffix, self.most = options.get("suffix", ".jsonl"), int(options.get("most", "10000"))
        self.quiet_ns, self.parts = int(options.get("quiet_ms", "0")) * 1_000_000, int(options.get("parts", "8"))
        self.store, self.state = _opened(options["state"])

    def _numbers(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.state, allow_not_found=True))
        return sorted(int(i.base_name) for i in found if i.base_name.isdigit())

    def _read(self, number: int) -> Files:
        if number == 0:
            return {}
        with self.store.open_input_file(f"{self.state}/{number}") as f:
            table = pq.read_table(f)
        return dict(zip(table["path"].to_pylist(), zip(*(table[c].to_pylist() for c in ("agent_id", "size", "mtime_ns")))))

    def _write(self, number: int, files: Files) -> None:
        self.store.create_dir(self.state, recursive=True)
        rows = [(a, p, s, m) for p, (a, s, m) in files.items()]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, _LISTED)]
        # renamed whole, so a listing is there or isn't
        with self.store.open_output_stream(f"{self.state}/.{number}") as f:
            pq.write_table(pa.table(columns, schema=_LISTED), f)
        self.store.move(f"{self.state}/.{number}", f"{self.state}/{number}")

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        number = (self._numbers() or [0])[-1]
        old, new = self._read(number), listed(self.roots, self.suffix)
        still = time.time_ns() - self.quiet_ns
        changes = [c for c in compared(old, new) if c[5] == "deleted" or not self.quiet_ns or new[c[1]][2] <= still][: self.most]
        if not changes:
            return {"listing": number}
        now = dict(old)
        for _, path, *_, kind in changes:
            if kind == "deleted":
                del now[path]
            else:
                now[path] = new[path]
        self._write(number + 1, now)
        return {"listing": number + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = compared(self._read(start["listing"]), self._read(end["listing"])) if start != end else []
        size = max(1, -(-len(rows) // self.parts))
        return [_Part(rows[k : k + size]) for k in range(0, len(rows), size)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            # the last listing is what the next is compared with
            if number < end["listing"]:
                self.store.delete_file(f"{self.state}/{number}")


class WatchedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def watched(spark: SparkSession, roots: dict[str, list[str]], state: str, **options) -> DataFrame:
    """The stream of changes below ``roots`` (agent_id -> folders); ``state`` is a folder of its own, kept with the checkpoint."""
    spark.dataSource.register(WatchedFiles)
    pairs = json.dumps([[agent, root.rstrip("/")] for agent, places in sorted(roots.items()) for root in places])
    return spark.readStream.format(FORMAT).options(roots=pairs, state=state, **{k: str(v) for k, v in options.items()}).load()
