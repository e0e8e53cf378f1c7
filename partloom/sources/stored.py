"""Files through pyarrow's file systems, for data sources written in Python.

They reach folders that all machines mount and the stores that pyarrow speaks to (s3, gs,
hdfs); other stores are read through Spark's own binaryFile (``ooxml.workbooks``).
"""

from __future__ import annotations

import fnmatch
import uuid
from urllib.parse import quote

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def listed(path: str, glob: str) -> list[tuple[str, int]]:
    """Path and size of the files below a folder (or of the one file), without lock files of open ones."""
    system, root = opened(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and not f.base_name.startswith("~$")]
    return sorted(names)


class Aside:
    """A folder whose files appear by a rename: a job writes below ``_aside``, and what it
    commits moves to its place at once."""

    def __init__(self, path: str, job: str | None = None) -> None:
        self.path, self.job = path, job or uuid.uuid4().hex

    def folder(self, *names: str) -> str:
        _, root = opened(self.path)
        return "/".join([root, "_aside", self.job, *names])

    def attempt(self) -> str:
        """A folder for one attempt of a task; what a lost attempt leaves is never moved."""
        made = self.folder(f"attempt-{uuid.uuid4().hex}")
        opened(self.path)[0].create_dir(made)
        return made

    def publish(self, files: list[str], place: str) -> bool:
        """Move some files, all or none, to a folder that isn't there yet; False if it is."""
        system, root = opened(self.path)
        target = f"{root}/{place}"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            return False
        together = self.folder("together", quote(place, safe=""))
        system.create_dir(together)
        for f in files:
            system.move(f, f"{together}/{f.rsplit('/', 1)[-1]}")
        system.create_dir(target.rsplit("/", 1)[0])
        system.move(together, target)
        return True

    def clear(self) -> None:
        system, _ = opened(self.path)
        if system.get_file_info(self.folder()).type != fs.FileType.NotFound:
            system.delete_dir(self.folder())
