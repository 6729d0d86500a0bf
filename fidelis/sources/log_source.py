"""Keyed logs of JSON lines as a Spark data source, in batch, as a stream, and as a sink whose commit shows all rows or none.

A log is a folder of `.jsonl` files with lines {"key": ..., "payload": ...}, or one such file. Files are read by byte
ranges; a last line without newline is a torn write and left out, any other unreadable line stops the run. A folder with
`_commits` shows the files that are named there only, so that neither a failed task's file nor a half-done write is read;
a folder without it shows all its files. Payloads are text: that of a string is itself, of anything else its JSON.

Register it with `spark.dataSource.register(LogSource)`; options are `path` and `split`, the bytes of a range.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from fidelis.operators import ledger

SCHEMA = "key string, payload string, file string, at long"
ARROW = pa.schema([("key", pa.string()), ("payload", pa.string()), ("file", pa.string()), ("at", pa.int64())])
SPLIT = 64 << 20
# Bytes of lines in one Arrow batch, and of a block that is searched for a line's end.
BATCH, BLOCK = 4 << 20, 1 << 16


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+://", path) and not path.startswith("file:") else (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path))


def _join(folder: str, *names: str) -> str:
    return "/".join((folder.rstrip("/"), *names))


def _files(path: str) -> dict[str, int]:
    """Sizes of the files that the log shows, by path; none for a log that isn't there yet."""
    system, root = _system(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return {root: system.get_file_info(root).size}
    found = {i.path: i.size for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File and i.path.endswith(".jsonl")}
    commits = system.get_file_info(fs.FileSelector(_join(root, "_commits"), allow_not_found=True))
    if not commits:
        return found
    named = []
    for one in sorted(i.path for i in commits if i.path.endswith(".json")):
        with system.open_input_file(one) as f:
            named += json.loads(f.read())
    if lost := [n for n in named if _join(root, n) not in found]:
        raise ValueError(f"{path}: committed files are gone: {lost[:3]}")
    return {_join(root, n): found[_join(root, n)] for n in named}


def _whole(system: fs.FileSystem, path: str, size: int) -> int:
    """Where the last line with a newline ends; read backward, by blocks, no further than that."""
    with system.open_input_file(path) as f:
        end = size
        while end:
            start = max(0, end - BLOCK)
            f.seek(start)
            if (at := f.read(end - start).rfind(b"\n")) >= 0:
                return start + at + 1
            end = start
    return 0


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end); whole is where its last complete line ends."""

    path: str
    start: int
    end: int
    whole: int


def _ranges(files: dict[str, tuple[int, int]], split: int) -> list[Range]:
    return [Range(path, at, min(at + split, end), end) for path, (start, end) in sorted(files.items()) for at in range(start, end, split)]


def _parsed(line: bytes, path: str, at: int) -> tuple:
    try:
        said = json.loads(line)
        key, payload = said["key"], said.get("payload")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"{path}: corrupt line at byte {at}") from e
    if not isinstance(key, str):
        raise ValueError(f"{path}: no key in the line at byte {at}")
    return key, payload if payload is None or isinstance(payload, str) else json.dumps(payload, sort_keys=True, separators=(",", ":")), path, at


def _lines(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    """A range's lines; one that begins before the range belongs to the one before, one that ends beyond it is read to its end."""
    system, _ = _system(root)
    with system.open_input_file(part.path) as f:
        at = part.start
        if at:
            f.seek(at - 1)
        rest, place = b"", at - 1 if at else 0
        skipping, rows, size = bool(at), [], 0
        while place < part.end or (rest and not skipping):
            # A line longer than a block is read in blocks as long as what is held of it.
            block = f.read(min(max(BLOCK, len(rest)), part.whole - place - len(rest)))
            if not block:
                break
            *ended, rest = (rest + block).split(b"\n")
            for line in ended:
                if not skipping and place < part.end:
                    rows.append(_parsed(line, part.path, place))
                    size += len(line)
                skipping, place = False, place + len(line) + 1
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
            if place >= part.end:
                break
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class LogReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        system, _ = _system(self.path)
        return _ranges({p: (0, _whole(system, p, n)) for p, n in _files(self.path).items()}, self.split) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition) if partition.end else iter(())


class LogStreamReader(DataSourceStreamReader):
    """Offsets are, for each file, where its last complete line ended; a torn line is read once it has been ended."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _system(self.path)
        return {p: _whole(system, p, n) for p, n in _files(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if shrunk := [p for p, at in start.items() if end.get(p, 0) < at]:
            raise ValueError(f"a log only grows; lines that were read are gone from {shrunk[:3]}")
        return _ranges({p: (start.get(p, 0), at) for p, at in end.items()}, self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str


class LogWriter(DataSourceWriter):
    """Each task attempt writes a file of its own; the commit names those of the attempts that counted in one new file."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, root = _system(self.path)
        name, out = f"{self.run}-{uuid.uuid4().hex}.jsonl", None
        system.create_dir(root, recursive=True)
        for row in iterator:
            if row.key is None:
                raise ValueError("a row without a key")
            out = out or system.open_output_stream(_join(root, name))
            out.write(json.dumps({"key": row.key, "payload": row.payload}).encode() + b"\n")
        if out:
            out.close()
        return Written(name if out else "")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        system.create_dir(_join(root, "_commits"), recursive=True)
        made = _join(root, "_commits", f"{self.run}.tmp")
        with system.open_output_stream(made) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())
        system.move(made, _join(root, "_commits", f"{self.run}.json"))

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f"{self.run}-"):
                system.delete_file(i.path)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_log"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("split", SPLIT))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._options())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(*self._options())

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(self.options["path"])


def read_log(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.read.format("keyed_log").option("split", split).load(path)


def stream_log(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.readStream.format("keyed_log").option("split", split).load(path)


def commit_log(rows: DataFrame, path: str) -> None:
    """Append the (key, payload) rows whose key isn't in the log, all or none; equal rows of a key are one, and a retry appends none.

    Rows of a key that differ, among themselves or from the log's, stop the run before anything is written, and so does a null
    key. Keys are compared by Spark joins. Two writers at once may both add a key: `ledger.no_duplicates` tells.
    """
    rows = rows.select(F.col("key").cast("string").alias("key"), F.col("payload").cast("string").alias("payload"))
    held = read_log(rows.sparkSession, path).select("key", "payload")
    wrong = [r[0] for r in ledger.conflicts(rows, held, "key").limit(3).collect()] + rows.where("key is null").select("key").limit(1).collect()
    if wrong:
        raise ValueError(f"second commits of a key with another payload, or rows without a key: {wrong}")
    ledger.uncommitted(rows.dropDuplicates(["key"]), held, "key").write.format("keyed_log").mode("append").save(path)
