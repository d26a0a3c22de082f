"""Files that tasks write and read by themselves: any file system that Arrow knows, by URI."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file:/x, file:///x, hdfs://..., a plain path) and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str):
    """A stream to a file of a name that no other task or attempt uses, and its URI.

    What a lost attempt leaves is never read: readers only open what the index of finished tasks names.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None), uri


def open_file(uri: str):
    fs, path = file_system(uri)
    return fs.open_input_file(path)
