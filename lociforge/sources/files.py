"""Files of binary and multi-line formats for Python data sources: found and opened by URI, wherever a task runs."""

from __future__ import annotations

import os

from pyarrow import fs

#: Bytes that one partition takes of a file, unless the option `split` says otherwise.
SPLIT = 32 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def found(uri: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(URI, bytes) of the file, or of the files with one of the endings below the folder; hidden ones are left out."""
    system, path = located(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    below = system.get_file_info(fs.FileSelector(path, recursive=True))
    own = [x for x in below if x.type == fs.FileType.File and x.path.endswith(endings) and not x.base_name.startswith((".", "_"))]
    return [(uri.rstrip("/") + x.path[len(path.rstrip("/")) :], x.size) for x in sorted(own, key=lambda x: x.path)]


def exists(uri: str) -> bool:
    system, path = located(uri)
    return system.get_file_info(path).type == fs.FileType.File


def opened(uri: str):
    """The file for reads at any place."""
    system, path = located(uri)
    return system.open_input_file(path)


def ranges(size: int, split: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a file."""
    return [(a, min(a + split, size)) for a in range(0, size, split)]
