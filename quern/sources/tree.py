"""A Spark data source for folders of documents: spark.read.format("quern_documents").load(root), and a writer that replaces files.

Reading: the driver lists folders only as deep as it takes to have enough of them; each task walks its own ones and reads their files.
Every folder counts but excluded and hidden ones (Spark's own listing would leave out those that begin with an underscore). Rows are
(path, content, error); a file that can't be read has an error and no content.

Writing (path, new_content): tasks write hidden drafts beside the files; only when all have ended are the drafts renamed over the
files, each in one step. A task that fails leaves all files as they were, and the drafts are deleted. A file whose draft can't be
written is reported (option `report`, a folder for JSON lines) and doesn't stop the others.

Works on what pyarrow.fs opens (local and mounted folders, and the object stores that it was built with)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "quern_documents"
SCHEMA = "path string, content binary, error string"
#: Folders that the driver lists before tasks go on, and bytes of files in a batch of rows.
FOLDERS, BATCH_BYTES = 64, 8 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before a path to make it a Spark path)."""
    if uri.startswith("/"):
        uri = f"file://{uri}"
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/").rstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/"), uri.rstrip("/").removesuffix(path.rstrip("/"))


def readable(uri: str) -> bool:
    """Whether this source can open a folder's file system."""
    try:
        opened(uri)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


@dataclass
class Folders(InputPartition):
    """Folders that one task reads: (path, whether also what is below)."""

    paths: tuple[tuple[str, bool], ...]


class Reader(DataSourceReader):
    def __init__(self, root: str, name: str, exclude: list[str], recursive: bool):
        self.root, self.name, self.exclude, self.recursive = root, name, set(exclude), recursive

    def _below(self, system: fs.FileSystem, path: str) -> list[str]:
        """Folders in a folder that aren't skipped."""
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [f.path for f in found if f.type == fs.FileType.Directory and f.base_name not in self.exclude and not f.base_name.startswith(".")]

    def partitions(self) -> list[Folders]:
        system, root, _ = opened(self.root)
        if not self.recursive:
            return [Folders(((root, False),))]
        own, level = [(root, False)], self._below(system, root)
        while level and len(level) + len(own) < FOLDERS:
            own += [(x, False) for x in level]
            level = [y for x in level for y in self._below(system, x)]
        every = own + [(x, True) for x in level]
        return [Folders(tuple(every[k::FOLDERS])) for k in range(min(FOLDERS, len(every)))]

    def read(self, part: Folders) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.root)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        rows, size, todo = [], 0, list(part.paths)
        while todo:
            folder, deep = todo.pop()
            if deep:
                todo += [(x, True) for x in self._below(system, folder)]
            at = f"{folder}/{self.name}"
            if system.get_file_info(at).type != fs.FileType.File:
                continue
            try:
                with system.open_input_stream(at) as f:
                    rows.append((before + at, f.read(), None))
            except OSError as e:
                rows.append((before + at, None, str(e)[:300]))
            size += len(rows[-1][1] or b"")
            if size > BATCH_BYTES:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Drafts(WriterCommitMessage):
    """What a task has written, (draft, file), and what it couldn't, (file, error)."""

    done: list[tuple[str, str]]
    failed: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, root: str, report: str | None):
        self.root, self.report = root, report

    def write(self, rows) -> Drafts:
        system, root, before = opened(self.root)
        out = Drafts([], [])
        for row in rows:
            at = row.path.removeprefix("file://") if row.path.startswith("file:///") else row.path.removeprefix(before)
            folder, _, name = at.rpartition("/")
            draft = f"{folder}/.{name}.draft-{uuid.uuid4().hex}"
            try:
                if not at.startswith(f"{root}/"):
                    raise OSError(f"not below {root}")
                if system.get_file_info(folder).type != fs.FileType.Directory:
                    raise OSError(f"no folder {folder}")
                with system.open_output_stream(draft) as f:
                    f.write(row.new_content.encode())
                out.done.append((draft, at))
            except OSError as e:
                out.failed.append((row.path, str(e)[:300]))
        return out

    def commit(self, messages: list) -> None:
        system, _, before = opened(self.root)
        failed = [x for m in messages if m for x in m.failed]
        for draft, at in (x for m in messages if m for x in m.done):
            try:
                system.move(draft, at)
            except OSError as e:
                failed.append((before + at, str(e)[:300]))
        if self.report and failed:
            target, folder, _ = opened(self.report)
            target.create_dir(folder, recursive=True)
            with target.open_output_stream(f"{folder}/errors.json") as f:
                f.write("".join(json.dumps({"path": p, "error": e}) + "\n" for p, e in failed).encode())

    def abort(self, messages: list) -> None:
        system, *_ = opened(self.root)
        for draft, _ in (x for m in messages if m for x in m.done):
            if system.get_file_info(draft).type == fs.FileType.File:
                system.delete_file(draft)


class Documents(DataSource):
    """Options: path; name (of the files), exclude (folders, a JSON array), recursive; for writing, report."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("name", "SKILL.md"), json.loads(self.options.get("exclude", "[]")), self.options.get("recursive", "true") == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("report"))
