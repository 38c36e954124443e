"""Files that executors write and read through Arrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyarrow import fs as arrow_fs


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    uri = folder if not folder.startswith("file:/") else "file://" + "/" + folder[len("file:"):].lstrip("/")
    system, path = arrow_fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def commit_file(folder: str, name: str, parts: Iterable[bytes]) -> int:
    """Write ``parts`` under a temporary name, then move it to ``name``; returns the number of bytes.

    Names are a function of the content's place, so a repeated or speculative task replaces a file by an equal one.
    """
    system, path = _open(folder)
    system.create_dir(f"{path}/_temporary", recursive=True)
    hidden, final, size = f"{path}/_temporary/{name}.{uuid4().hex}", f"{path}/{name}", 0
    with system.open_output_stream(hidden) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    try:
        system.move(hidden, final)
    except OSError:
        # Some stores refuse to replace; an equal file is then there already.
        if system.get_file_info(final).type != arrow_fs.FileType.File:
            raise
        system.delete_file(hidden)
    return size


def read_file(folder: str, name: str) -> bytes:
    system, path = _open(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        return source.read()


def read_stream(folder: str, name: str):
    """The file as a readable stream of bytes."""
    system, path = _open(folder)
    return system.open_input_stream(f"{path}/{name}", compression=None)
