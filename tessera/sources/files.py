"""File access of the Python data sources: any file system that pyarrow knows, staged writes, read counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSourceWriter, InputPartition, WriterCommitMessage

STAGING = "_staging-"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int, float]]:
    """(path below the folder, bytes, modification time) of its files; names that begin with _ or . are left out."""
    files, root = located(uri)
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        below = f.path[len(root.rstrip("/")) + 1 :]
        if f.type == fs.FileType.File and not any(part[0] in "_." for part in below.split("/")):
            out.append((below, f.size, f.mtime_ns / 1e9 if f.mtime_ns else 0.0))
    return sorted(out)


def read_file(uri: str, below: str) -> bytes:
    files, root = located(uri)
    with files.open_input_file(f"{root.rstrip('/')}/{below}") as f:
        return f.read()


@dataclass
class Group(InputPartition):
    """Files that one task reads."""

    files: list


def grouped(files: Iterable[tuple], size: Callable[[tuple], int], most: int) -> list[Group]:
    """Groups of at most ``most`` bytes (a larger file stands alone)."""
    out: list[Group] = []
    total = 0
    for f in files:
        if not out or total + size(f) > most:
            out.append(Group([]))
            total = 0
        out[-1].files.append(f)
        total += size(f)
    return out


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: the name of its own folder."""

    folder: str


class StagedWriter(DataSourceWriter):
    """Tasks write into folders of their own below ``_staging-<job>``; the job's commit moves the files of the tasks
    that ended well and drops the rest, so failed attempts leave nothing behind."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def files(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        """(path below the folder, content) of a task's rows."""
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Staged:
        files, root = located(self.uri)
        own = uuid.uuid4().hex
        made: set[str] = set()
        for below, content in self.files(iterator):
            path = f"{root.rstrip('/')}/{STAGING}{self.job}/{own}/{below}"
            folder = path.rpartition("/")[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(path) as f:
                f.write(content)
        return Staged(own)

    def commit(self, messages: list) -> None:
        files, root = located(self.uri)
        root = root.rstrip("/")
        if self.overwrite:
            for below, *_ in listed(self.uri):
                files.delete_file(f"{root}/{below}")
        stage = f"{root}/{STAGING}{self.job}"
        moves, folders = [], set()
        for m in messages:
            if m is None:
                continue
            base = f"{stage}/{m.folder}"
            for f in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    target = f"{root}/{f.path[len(base) + 1 :]}"
                    moves.append((f.path, target))
                    folders.add(target.rpartition("/")[0])
        for folder in sorted(folders):
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: files.move(*m), moves))
        self._drop(files, stage)

    def abort(self, messages: list) -> None:
        files, root = located(self.uri)
        self._drop(files, f"{root.rstrip('/')}/{STAGING}{self.job}")

    @staticmethod
    def _drop(files: fs.FileSystem, stage: str) -> None:
        if files.get_file_info(stage).type == fs.FileType.Directory:
            files.delete_dir(stage)
