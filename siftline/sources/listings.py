"""A data source of what a store of files holds: folders are listed by tasks, contents aren't read."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The driver opens folders level by level until it knows so many; tasks walk them.
MOST_FOLDERS = 256
MOST_TASKS = 64


class Folders(InputPartition):
    """Folders to walk, or files that were met on the way to them."""

    def __init__(self, folders: list[str], files: list[tuple]):
        super().__init__(None)
        self.folders, self.files = folders, files


class Listing(DataSource):
    """Files below ``path`` whose path below it starts with ``prefix``: path, size, modified. Empty files count too."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, size long, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], self.options.get("prefix", ""), self.options.get("recursive", "true") == "true")


class ListingReader(DataSourceReader):
    def __init__(self, path: str, prefix: str, recursive: bool):
        self.path = re.sub("^(file:)?/+", "file:/", path.rstrip("/"))
        self.prefix, self.recursive = prefix, recursive

    def opened(self, folder: str) -> tuple[list[str], list[tuple]]:
        """What lies right in a folder, by paths below the source's own, as far as the prefix admits it; in what is none, nothing."""
        from pyarrow.fs import FileSelector, FileSystem, FileType

        store, root = FileSystem.from_uri(self.path.replace("file:/", "file:///"))
        folders, files = [], []
        try:
            infos = store.get_file_info(FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        except NotADirectoryError:
            return [], []
        for x in infos:
            below = folder + x.base_name
            if x.type == FileType.Directory:
                below += "/"
                if below.startswith(self.prefix) or self.prefix.startswith(below):
                    folders.append(below)
            elif below.startswith(self.prefix):
                files.append((f"{self.path}/{below}", x.size, x.mtime))
        return folders if self.recursive or folder != self.base() else [], files

    def base(self) -> str:
        """The deepest folder that holds all of the prefix's paths."""
        return self.prefix[: self.prefix.rfind("/") + 1]

    def partitions(self) -> list[InputPartition]:
        folders, parts = [self.base()], []
        while folders and len(folders) < MOST_FOLDERS:
            inner: list[str] = []
            for folder in folders:
                found, files = self.opened(folder)
                inner += found
                parts.append(Folders([], files))
            folders = inner
        step = max(1, -(-len(folders) // MOST_TASKS))
        parts += [Folders(folders[k : k + step], []) for k in range(0, len(folders), step)]
        return [p for p in parts if p.folders or p.files] or [Folders([], [])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        yield from partition.files
        left = list(partition.folders)
        while left:
            folders, files = self.opened(left.pop())
            left += folders
            yield from files
