"""Folders of note files as a Spark data source: ``format("notes")``.

Reading: the folders below the root are dealt to a bounded number of groups, and each group is read by one task per slot
of its names, so that a folder with most of the files is read by several tasks and many small folders by few ones. Only
the upper levels are listed ahead; tasks walk what lies below. Writing: each task writes its files below a folder of its own attempt; when all
tasks are done the files move to their places, each in one step. A task that is killed leaves nothing in the
vault, and neither does a job that fails.
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Where attempts write, below the root: on the same disk, so that a move is one step.
STAGING = "_writing"
#: Tasks that read one folder.
SLOTS = 4
#: Groups of folders: levels are listed ahead until there are so many folders, and so many times ``SLOTS`` tasks read at most.
GROUPS = 64
#: Threads that move folders of files when a job commits.
MOVERS = 16


def folder_of(path: str) -> str:
    """The mounted folder of a path; other stores hold no note files."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"note files need a mounted folder, not {path!r}")
    return parts.path if parts.scheme else path


def inside(root: str, path: str) -> str:
    """Place of a note below the root; a path that leads out of it raises."""
    target = os.path.normpath(os.path.join(root, path))
    if not target.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"the path {path!r} leaves the folder")
    return target


@dataclass
class Names(InputPartition):
    """The files of some folders whose name falls into a slot; those in ``deep`` with all that lies below them."""

    flat: set[str]
    deep: list[str]
    slot: int


def listing(folder: str) -> tuple[list[str], list[str]]:
    """Paths of the folders in a folder, but for attempts of writers, and names of its files."""
    with os.scandir(folder) as found:
        entries = [(e, e.is_dir(follow_symlinks=False)) for e in found if e.name != STAGING]
        return sorted(e.path for e, is_folder in entries if is_folder), sorted(e.name for e, is_folder in entries if not is_folder and e.is_file())


class NoteReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, contents: bool):
        self.root, self.suffix, self.contents = root, suffix, contents

    def partitions(self) -> list[InputPartition]:
        flat, deep = [], [self.root] if os.path.isdir(self.root) else []
        while deep and len(deep) < GROUPS:
            flat += deep
            deep = [below for folder in deep for below in listing(folder)[0]]
        groups = min(GROUPS, max(len(flat), len(deep)))
        return [Names(set(flat[g::groups]), deep[g::groups], slot) for g in range(groups) for slot in range(SLOTS)]

    def read(self, partition: Names) -> Iterator[tuple]:
        waiting = [*partition.flat, *partition.deep]
        while waiting:
            folder = waiting.pop()
            below, names = listing(folder)
            if folder not in partition.flat:
                waiting += below
            for name in names:
                if name.endswith(self.suffix) and zlib.crc32(name.encode()) % SLOTS == partition.slot:
                    path, content = os.path.join(folder, name), None
                    if self.contents:
                        with open(path, encoding="utf-8", newline="") as file:
                            content = file.read()
                    yield os.path.relpath(path, self.root), content


@dataclass
class Attempt(WriterCommitMessage):
    """Where a task left its files."""

    folder: str


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, os.path.join(root, STAGING, uuid.uuid4().hex)

    def write(self, rows: Iterator[Row]) -> Attempt:
        folder = os.path.join(self.job, uuid.uuid4().hex)
        os.makedirs(folder)
        for row in rows:
            inside(self.root, row.path)
            target = inside(folder, row.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8", newline="") as file:
                file.write(row.content or "")
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        def move(attempt: str, folder: str, names: list[str]) -> None:
            place = os.path.join(self.root, os.path.relpath(folder, attempt))
            os.makedirs(place, exist_ok=True)
            for name in names:
                os.replace(os.path.join(folder, name), os.path.join(place, name))

        with ThreadPoolExecutor(MOVERS) as movers:
            for message in messages:
                moves = [movers.submit(move, message.folder, folder, names) for folder, _, names in os.walk(message.folder if message else "")]
                for moved in moves:
                    moved.result()
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Drop this job's staging folder, with what attempts that lost or were killed left there."""
        shutil.rmtree(self.job, ignore_errors=True)
        try:
            os.rmdir(os.path.join(self.root, STAGING))
        except OSError:
            pass  # another job writes


class NoteFiles(DataSource):
    """``(path, content)`` of the files below a folder that every executor can reach.

    Options: the path; ``suffix`` (``.md``); ``contents`` ``false`` reads names only, with null contents. A null
    content is written as an empty file. Of equal paths in one write any may win, each whole.
    """

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "path string, content string"

    def _root(self) -> str:
        return folder_of(self.options["path"])

    def reader(self, schema: StructType) -> NoteReader:
        return NoteReader(self._root(), self.options.get("suffix", ".md"), self.options.get("contents", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        return NoteWriter(self._root())


def read_note_files(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    spark.dataSource.register(NoteFiles)
    return spark.read.format("notes").option("contents", str(contents).lower()).load(root)


def write_note_files(notes: DataFrame, root: str) -> None:
    """One file per row of ``notes(path, content)`` below ``root``; files of other paths stay."""
    os.makedirs(folder_of(root), exist_ok=True)
    notes.sparkSession.dataSource.register(NoteFiles)
    notes.select("path", "content").write.format("notes").mode("append").save(root)
