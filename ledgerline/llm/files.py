"""Files in the shared folder that tasks read and write by ranges, whatever store it is in."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path (local without a scheme) and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_once(folder: str, suffix: str, write: Callable) -> str:
    """Writes a new file in folder by write(stream) and returns its path.

    Each attempt of a task writes its own file. Only the paths that the successful attempts return are read later.
    """
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    store, inner = filesystem(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner) as out:
        write(out)
    return path


def read_range(path: str, start: int, length: int) -> bytes:
    store, inner = filesystem(path)
    with store.open_input_file(inner) as f:
        return f.read_at(length, start)


def file_size(path: str) -> int:
    store, inner = filesystem(path)
    return store.get_file_info(inner).size
