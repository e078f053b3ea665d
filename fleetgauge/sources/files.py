"""Files as tasks read them: byte ranges through the file systems of pyarrow (local, HDFS, S3, GCS)."""

from __future__ import annotations

import fnmatch
import os
import re


def open_store(path: str):
    """File system of a path or URI, and the path in it."""
    from pyarrow import fs

    plain = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(plain if re.match("[a-z0-9]+://", plain) else os.path.abspath(plain))


def sized_files(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, size) of a file, of the files of a glob in its last part, or of those of a folder that match the pattern; hidden ones aside."""
    from pyarrow import fs

    store, inner = open_store(path)
    kind = store.get_file_info(inner)
    if kind.type == fs.FileType.File:
        return [(inner, kind.size)]
    folder, _, last = inner.rpartition("/")
    if kind.type == fs.FileType.Directory:
        folder, last = inner, pattern
    found = store.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True))
    files = [(x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and fnmatch.fnmatch(x.base_name, last)]
    if not files:
        raise FileNotFoundError(path)
    return sorted(files)
