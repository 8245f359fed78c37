"""Files that tasks write into the shared folder, through any file system that pyarrow reaches."""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Whole:
    """A file that appears under its name only when it is complete: a lost or repeated task leaves no half of one."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        folder, _, name = self.path.rpartition("/")
        self.temporary = f"{folder}/_{name}.{uuid.uuid4().hex}.tmp"  # a name that readers of the folder pass over

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.temporary)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)
