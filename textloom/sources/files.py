"""Files under their own names: page folders, and whole texts as one file each.

Two data sources for paths that every machine sees.

``named_files`` reads and writes rows (folder, file_name, text) as ``<path>/<folder>/<file_name>``,
on any file system that pyarrow knows (local mounts, hdfs:, s3:, gs:). ``ordered_files`` writes
rows (file, at, text) to ``<path>/<file>``, each text at its byte ``at``, so many tasks fill one
file and none holds it; it needs a mount, since object stores have no files that can be filled.

Both write below ``<path>/_temporary-<job>``; a file shows under its name only when the whole job
has committed, by a rename on the driver, one for each folder or file, never reading a text.
A killed task or job leaves nothing behind but that folder, which abort deletes. Tasks that run
twice write the same bytes to the same places.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from textloom.sources.shared import materialize

#: Bytes and files of one part that a task reads, and bytes of a batch that it hands on.
PART_BYTES, PART_FILES, BATCH_BYTES = 64 << 20, 2000, 4 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; an address without a scheme is a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked(name: str | None) -> str:
    """A name that is one component of a path; others could reach outside the folder."""
    if not name or "/" in name or "\\" in name or name in (".", "..") or name.startswith("_temporary-"):
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Files(InputPartition):
    """Paths below the root: (folder, file name) each."""

    names: list[tuple[str, str]]


class NamedFilesReader(DataSourceReader):
    """A task for each PART_BYTES or PART_FILES; the driver lists names and sizes only."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Files]:
        system, root = place(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.base_name.endswith(self.suffix)]
        parts, size = [Files([])], 0
        for x in sorted(found, key=lambda x: x.path):
            above = os.path.relpath(os.path.dirname(x.path), root)
            if os.sep in above or above.startswith(("_", "..")):
                continue  # one level of folders; what a job is still writing is none
            if size + x.size > PART_BYTES and parts[-1].names or len(parts[-1].names) >= PART_FILES:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(("" if above == "." else above, x.base_name))
            size += x.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = place(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            return pa.RecordBatch.from_arrays(columns, names=["folder", "file_name", "text"])

        for folder, name in partition.names:
            with system.open_input_stream(f"{root}/{folder}/{name}" if folder else f"{root}/{name}") as f:
                data = f.read()
            rows.append((folder, name, data.decode("utf-8", "replace")))
            size += len(data)
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        yield batch()


class Job(DataSourceArrowWriter):
    """What both writers share: the job's folder, and what becomes of it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, job = place(self.job)
        _, root = place(self.path)
        system.create_dir(job, recursive=True)
        made = system.get_file_info(fs.FileSelector(job))
        taken = [x.base_name for x in made if not x.base_name.startswith(".") and system.get_file_info(f"{root}/{x.base_name}").type != fs.FileType.NotFound]
        if taken and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{len(taken)} of the names are there already, as {taken[0]!r}; mode overwrite replaces them")
        for x in made:
            if not x.base_name.startswith("."):
                target = f"{root}/{x.base_name}"
                if x.base_name in taken:
                    system.delete_dir(target) if x.type == fs.FileType.Directory else system.delete_file(target)
                system.move(x.path, target)
        system.delete_dir(job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, job = place(self.job)
        if system.get_file_info(job).type != fs.FileType.NotFound:
            system.delete_dir(job)


def attempt() -> str:
    context = TaskContext.get()
    return uuid.uuid4().hex if context is None else f"{context.partitionId()}-{context.taskAttemptId()}"


class NamedFilesWriter(Job):
    """A file is written under a name of the attempt, then moved to its own within the job's folder."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, job = place(self.job)
        own = f"{job}/.{attempt()}"
        system.create_dir(own, recursive=True)
        known = set()
        for batch in iterator:
            for folder, name, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("folder", "file_name", "text")), strict=True):
                at = f"{job}/{checked(folder.as_py())}"
                if at not in known:
                    system.create_dir(at, recursive=True)
                    known.add(at)
                new = f"{own}/{checked(name.as_py())}"
                with system.open_output_stream(new) as f:
                    f.write((text.as_py() or "").encode())
                system.move(new, f"{at}/{name.as_py()}")
        system.delete_dir(own)
        return WriterCommitMessage()


class OrderedFilesWriter(Job):
    """Each text goes to its place in its file; what lies between is filled by other tasks."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, job = place(self.job)
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError("ordered_files needs a mounted path")
        os.makedirs(job, exist_ok=True)
        name, f = None, None
        try:
            for batch in iterator:
                for file, at, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("file", "at", "text")), strict=True):
                    if file.as_py() != name:
                        if f is not None:
                            os.close(f)
                        name = checked(file.as_py())
                        f = os.open(f"{job}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
                    data, to = memoryview((text.as_py() or "").encode()), at.as_py()
                    while data:
                        n = os.pwrite(f, data, to)
                        data, to = data[n:], to + n
        finally:
            if f is not None:
                os.close(f)
        return WriterCommitMessage()


class NamedFiles(DataSource):
    """Format ``named_files``; option ``suffix`` (.txt) tells which files are read."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "folder string, file_name string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NamedFilesReader(self.options["path"], self.options.get("suffix", ".txt"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


class OrderedFiles(DataSource):
    """Format ``ordered_files``, for writing."""

    @classmethod
    def name(cls) -> str:
        return "ordered_files"

    def schema(self) -> str:
        return "file string, at long, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return OrderedFilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (NamedFiles, OrderedFiles):
        spark.dataSource.register(source)


def write_named(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write (folder, file_name, text); a name that two rows have is an error, found before anything is written.

    Null texts are empty files. Folders that exist are an error too, unless ``overwrite`` replaces them.
    """
    twice = rows.groupBy("folder", "file_name").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['n']} rows are named {twice[0]['folder']}/{twice[0]['file_name']}")
    register(rows.sparkSession)
    rows.select("folder", "file_name", "text").write.format("named_files").mode("overwrite" if overwrite else "append").save(path)


def read_named(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(folder, file_name, text) of the files of a folder and of the folders in it; folder is '' at the top."""
    register(spark)
    return spark.read.format("named_files").option("suffix", suffix).load(path)


def placed(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` (file, text, and the columns of ``order``) with ``at``: the bytes of the file's texts before this one.

    Sorted by range, with a running sum in each part; the sums of the parts, a row for each part
    and file, give where a part begins in a file. No task has all of a file.
    """
    ordered = rows.repartitionByRange("file", *order).sortWithinPartitions("file", *order).select("file", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            before = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != name:
                    name, total = file, 0
                before.append(total)
                data = text.as_buffer()
                total += data.size if data is not None else 0
            numbers = [pa.array([part] * len(batch), pa.int32()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], names=["file", "text", "part", "within"])

    found = materialize(ordered.mapInArrow(run, "file string, text string, part int, within long"), "placed")
    sizes = found.groupBy("file", "part").agg(F.max(F.col("within") + F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    starts = sizes.select("file", "part", (F.sum("size").over(Window.partitionBy("file").orderBy("part")) - F.col("size")).alias("start"))
    return found.join(materialize(starts, "starts"), ["file", "part"]).select("file", (F.col("start") + F.col("within")).alias("at"), "text")


def write_ordered(rows: DataFrame, order: tuple[str, ...], path: str, overwrite: bool = False) -> None:
    """Write ``rows`` (file, text, and the columns of ``order``) as one file for each name, texts in order.

    Null texts add nothing; a file of empty texts alone is empty. Names that are there already are
    an error, unless ``overwrite`` replaces them. ``path`` is one that all machines see.
    """
    register(rows.sparkSession)
    placed(rows, order).write.format("ordered_files").mode("overwrite" if overwrite else "append").save(path)
