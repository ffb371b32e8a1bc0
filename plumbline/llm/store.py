"""Files that tasks write and read in a folder all of them share, through pyarrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow.fs as fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it of a URI or a plain path."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def put(path: str, fill: Callable) -> int:
    """Write a file whole or not at all, and return its size: a lost task leaves no part of it under its name.

    A task that runs again writes the same name; the last rename stays.
    """
    system, place = at(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(draft, compression=None) as out:
            fill(out)
            size = out.tell()
        system.move(draft, place)
    except BaseException:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise
    return size


def opened(path: str):
    system, place = at(path)
    return system.open_input_file(place)
