"""Files in the shared folder, from Python: local paths by open(), other stores by pyarrow's file systems."""

from __future__ import annotations

import os
from typing import BinaryIO


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def open_write(uri: str) -> BinaryIO:
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(uri)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(at)


def open_read(uri: str) -> BinaryIO:
    """A seekable file."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(uri)
    return fs.open_input_file(at)
