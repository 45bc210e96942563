"""Files that tasks write to and read from the shared folder, whatever store it lies in."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a URI (file, hdfs, s3, gs ...) or a plain path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), os.path.abspath(path)


class AttemptFile:
    """A file of one task attempt: its name is never used twice, so a lost or repeated attempt harms none.

    Readers use only the names that successful tasks have returned.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.path = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
        store, inside = open_store(self.path)
        store.create_dir(os.path.dirname(inside), recursive=True)
        self.out = store.open_output_stream(inside, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Offset at which data begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


def open_input(path: str):
    store, inside = open_store(path)
    return store.open_input_file(inside)


def remove_folder(path: str) -> None:
    """Deletes a folder and its files, if it is there: without rows none is written."""
    store, inside = open_store(path)
    if store.get_file_info(inside).type == pafs.FileType.Directory:
        store.delete_dir(inside)
