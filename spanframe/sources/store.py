"""Files by path or URI, opened where a task runs: ranged reads, staged writes and several files read as one."""

from __future__ import annotations

import os
import re
import uuid
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate
from typing import BinaryIO

from pyarrow import fs


def local(path: str) -> str | None:
    """The path of a file on a mounted file system, or None for another store."""
    if re.match(r"file:/", path):
        return re.sub(r"^file:/+", "/", path)
    return None if "://" in path else path


def opened(path: str) -> BinaryIO:
    """A file to seek in and read; URIs go to the stores that Arrow knows (hdfs, s3, gs, abfs)."""
    plain = local(path)
    if plain is not None:
        return open(plain, "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def size_of(path: str) -> int:
    plain = local(path)
    if plain is not None:
        return os.path.getsize(plain)
    store, name = fs.FileSystem.from_uri(path)
    return store.get_file_info(name).size


def listed(folder: str, prefix: str = "part-") -> list[tuple[str, int]]:
    """(path, size) of the files in a folder whose names have the prefix, by name."""
    store, name = fs.FileSystem.from_uri(f"file://{os.path.abspath(local(folder))}" if local(folder) is not None else folder)
    found = [x for x in store.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name.startswith(prefix)]
    return sorted((f"{folder.rstrip('/')}/{x.base_name}", x.size) for x in found)


def written(path: str, parts) -> int:
    """Write parts to a file that takes its name when it is whole, so that tasks that run twice leave one; its size."""
    n, staged = 0, f"{path}.{uuid.uuid4().hex}"
    plain = local(path)
    store, name, temporary = (fs.LocalFileSystem(), plain, local(staged)) if plain is not None else (*fs.FileSystem.from_uri(path), fs.FileSystem.from_uri(staged)[1])
    with store.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    store.move(temporary, name)
    return n


class Joined:
    """Several files as one, to seek in and read; it goes to tasks as names and sizes."""

    def __init__(self, parts: Sequence[tuple[str, int]]) -> None:
        self.parts = [p for p in parts if p[1]]
        self.ends = list(accumulate(n for _, n in self.parts))
        self.size = self.ends[-1] if self.ends else 0
        self._at, self._open = 0, (None, None)

    @classmethod
    def of(cls, path: str) -> Joined:
        return cls([(path, size_of(path))])

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_at": 0, "_open": (None, None)}

    def seek(self, at: int) -> int:
        self._at = at
        return at

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and self._at < self.size:
            k = bisect_right(self.ends, self._at)
            if self._open[0] != k:
                if self._open[1]:
                    self._open[1].close()
                self._open = (k, opened(self.parts[k][0]))
            self._open[1].seek(self._at - (self.ends[k] - self.parts[k][1]))
            part = self._open[1].read(min(n, self.ends[k] - self._at))
            if not part:
                raise EOFError(f"{self.parts[k][0]} is shorter than it was")
            out.append(part)
            self._at, n = self._at + len(part), n - len(part)
        return b"".join(out)
