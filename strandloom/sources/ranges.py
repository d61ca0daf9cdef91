"""Files read by stretches of bytes, local or on any file system that pyarrow knows."""

from __future__ import annotations


def open_anywhere(path: str):
    if "://" in path or path.startswith("file:"):
        from pyarrow.fs import FileSystem

        fs, rest = FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
        return fs.open_input_file(rest)
    return open(path, "rb")  # noqa: SIM115
