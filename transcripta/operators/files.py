"""Files that tasks write one by one: exports and blobs, each below a folder that it can't leave.

A name is a relative path of plain parts; absolute paths, drives, ``..`` and links that
lead out are refused before anything is opened.  A file is written beside its place
and renamed when it is whole, so a task that runs again or dies leaves no half file.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[^\x00-\x1f\x7f\\:]+")


def safe_relpath(name: str) -> str:
    """``name`` with single slashes; raises ValueError where it isn't a plain relative path."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not name or name.startswith(("/", "~")) or not parts or any(p == ".." or not _PLAIN.fullmatch(p) for p in parts):
        raise ValueError(f"not a plain relative path: {name!r}")
    return "/".join(parts)


def placed(store: fs.FileSystem, root: str, name: str) -> str:
    """The place of ``name`` below ``root``; a link on the way must not lead out."""
    path = f"{root.rstrip('/')}/{safe_relpath(name)}"
    if isinstance(store, fs.LocalFileSystem):
        inside = os.path.realpath(root)
        if os.path.commonpath([inside, os.path.realpath(path)]) != inside or os.path.islink(path):
            raise ValueError(f"leads out of {root}: {name!r}")
    return path


def export_name(title: str | None, session_id: str) -> str:
    """A file name for a session: its title's letters and digits, and its id."""
    words = re.sub(r"[^\w]+", "-", title or "session").strip("-")[:60] or "session"
    return safe_relpath(f"{words}-{re.sub(r'[^A-Za-z0-9_-]', '_', session_id)}.md")


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


_WRITTEN = pa.schema([("name", pa.string()), ("size", pa.int64()), ("error", pa.string())])


def _write_each(batches: Iterator[pa.RecordBatch], root: str, replace: bool) -> Iterator[pa.RecordBatch]:
    store, base = _opened(root)
    for batch in batches:
        rows = []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (content.as_buffer() or pa.py_buffer(b"")).to_pybytes()
            try:
                path = placed(store, base, name or "")
                if not replace and store.get_file_info(path).type != fs.FileType.NotFound:
                    raise ValueError(f"is there already: {name!r}")
                store.create_dir(os.path.dirname(path), recursive=True)
                made = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
                with store.open_output_stream(made) as out:
                    out.write(data)
                store.move(made, path)
                rows.append((safe_relpath(name), len(data), None))
            except (ValueError, OSError) as error:
                rows.append((name, None, str(error)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, _WRITTEN)], schema=_WRITTEN)


def saved(files: DataFrame, root: str, replace: bool = True) -> DataFrame:
    """Writes (name, content) rows below ``root``, a file each; (name, size, error) of each row.

    A row whose name is refused or whose file can't be written fails alone.
    """
    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(partial(_write_each, root=root, replace=replace), "name string, size bigint, error string")


def _read_each(batches: Iterator[pa.RecordBatch], root: str, remove: bool) -> Iterator[pa.RecordBatch]:
    store, base = _opened(root)
    for batch in batches:
        rows = []
        for name in batch.column(0).to_pylist():
            try:
                path = placed(store, base, name or "")
                if remove:
                    there = store.get_file_info(path).type == fs.FileType.File
                    if there:
                        store.delete_file(path)
                    rows.append((name, None, None if there else "not there"))
                else:
                    with store.open_input_stream(path) as f:
                        rows.append((name, f.read(), None))
            except (ValueError, OSError) as error:
                rows.append((name, None, str(error)))
        yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip((("name", pa.string()), ("content", pa.binary()), ("error", pa.string())), zip(*rows) if rows else [()] * 3)})


def loaded(names: DataFrame, root: str) -> DataFrame:
    """(name, content, error) of the files ``names`` (name) below ``root``."""
    return names.select("name").mapInArrow(partial(_read_each, root=root, remove=False), "name string, content binary, error string")


def removed(names: DataFrame, root: str) -> DataFrame:
    """Deletes the files ``names`` below ``root``; (name, error), with an error where a file wasn't there or was refused."""
    return names.select("name").mapInArrow(partial(_read_each, root=root, remove=True), "name string, content binary, error string").drop("content")


def blob_name(blob_id: str = "id"):
    """Where a blob's file lies: its id below the first two digits of its hash."""
    return F.concat(F.lit("blobs/"), F.substring(F.regexp_replace(blob_id, "^blob_", ""), 1, 2), F.lit("/"), F.col(blob_id))


def saved_exports(markdown: DataFrame, sessions: DataFrame, root: str, replace: bool = True) -> DataFrame:
    """Saves exports (session_id, markdown) as a file for each session, named after its title (id, title)."""
    named = F.udf(export_name, "string")
    rows = markdown.join(sessions.select(F.col("id").alias("session_id"), "title"), "session_id")
    return saved(rows.select(named("title", "session_id").alias("name"), F.col("markdown").alias("content")), root, replace)
