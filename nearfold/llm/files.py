"""Files in the shared folder that tasks write and read themselves."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from nearfold.llm.common import ship

ship(__name__)


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(path)
    except Exception as error:
        scheme = path.partition("://")[0]
        if scheme == path or "nrecognized filesystem" not in str(error):
            raise
        raise ValueError(
            f"tasks cannot open {scheme}:// files; set spark.checkpoint.dir to a folder under file://, hdfs://, s3:// or gs://"
        ) from error


class SharedFile:
    """A file that one task writes and reads."""

    def __init__(self, path: str):
        self.store, self.path = file_system(path)

    @classmethod
    def new(cls, folder: str) -> "SharedFile":
        return cls(f"{folder}/{uuid.uuid4().hex}")

    @contextmanager
    def writing(self):
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(self.path) as out:
            yield out

    @contextmanager
    def reading(self):
        with self.store.open_input_stream(self.path) as f:
            yield f

    def remove(self) -> None:
        self.store.delete_file(self.path)
