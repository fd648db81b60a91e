"""Files that Python tasks write to, and read from, the shared folder.

A task attempt writes files of its own name and returns that name in its rows.
Whoever reads takes the names from the (written) table of those rows, so the
files of lost or repeated attempts are never read. Paths are URIs for
``pyarrow.fs``: local folders, HDFS, S3 and the like.
"""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


def new_name(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def open_out(uri: str) -> Any:
    where, path = _place(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def open_in(uri: str) -> Any:
    """A stream to read once, from start to end."""
    where, path = _place(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_random(uri: str) -> Any:
    """A file to read at any place; local files are mapped, not copied."""
    import pyarrow as pa
    where, path = _place(uri)
    return pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
