"""Binary files on any file system that pyarrow knows, written whole or not at all."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class AtomicFile:
    """A file that gets its name when closed; a repeated task writes the same name again."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.uri, self.part = uri, f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> int:
        """Append and return the offset at which ``data`` begins."""
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)
