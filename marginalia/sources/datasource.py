"""Point stores as a data source: spark.read, writeStream and readStream with format("points").

A store is a folder of Parquet files and a log of numbered entries, one for each
append: files count only once an entry names them. So a task that fails, or a job
that is aborted, leaves no rows; readers of one entry see the same rows for good; and
a stream's offset is the number of an entry.

Options: path; x_dim and num_params, or names (separated by commas); ncalls (of an
append); most_appends (of a batch of a stream, and of a whole run with availableNow).
The folder is on any file system that pyarrow opens, so machines need no shared disk but that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "points"
#: Rows of a Parquet file that are read or written at once.
ROWS = 10_000


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointsSource)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _entries(path: str) -> list[dict]:
    """The log, in order: {files: [[name, rows, first seq]], rows, seq, ncalls, names, batch}."""
    from pyarrow import fs

    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
    out = []
    for f in sorted((f for f in found if f.base_name.endswith(".json")), key=lambda f: f.base_name):
        with system.open_input_stream(f.path) as s:
            out.append(json.loads(s.read()))
    return out


def _append(path: str, files: list[tuple[str, int]], names: list[str], ncalls: int | None, batch: str | None) -> None:
    """Adds one entry. It is written aside and then moved to its name, which only one writer can take: stores have one at a time."""
    system, root = _open(path)
    log = _entries(path)
    if batch is not None and any(e.get("batch") == batch for e in log):
        return  # a stream's batch that was committed before it was restarted
    seq = log[-1]["seq"] + log[-1]["rows"] if log else 0
    placed, at = [], seq
    for name, rows in files:
        placed.append([name, rows, at])
        at += rows
    calls = ncalls if ncalls is not None else (log[-1]["ncalls"] if log else 0)
    entry = {"files": placed, "rows": at - seq, "seq": seq, "ncalls": calls, "names": names, "batch": batch}
    system.create_dir(f"{root}/log", recursive=True)
    aside = f"{root}/log/.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as s:
        s.write(json.dumps(entry).encode())
    system.move(aside, f"{root}/log/{len(log):012d}.json")


def _names(options: dict, log: list[dict]) -> list[str]:
    """The columns that the options ask for, checked against those of the store; those of the store if they ask for none."""
    from .store import columns

    if "names" in options:
        asked = [n.strip() for n in options["names"].split(",")]
    elif "x_dim" in options:
        asked = columns(int(options["x_dim"]), int(options.get("num_params", options["x_dim"])))
    else:
        asked = log[0]["names"] if log else None
    if asked is None:
        raise ValueError("the store is new: give x_dim and num_params, or names")
    if log and log[0]["names"] != asked:
        raise ValueError(f"{options['path']} holds {log[0]['names']}, not {asked}")
    return asked


@dataclass
class FilePart(InputPartition):
    name: str
    first: int


@dataclass
class Written(WriterCommitMessage):
    files: list


def _read(path: str, part: FilePart, names: list[str]) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq

    system, root = _open(path)
    at = part.first
    with system.open_input_file(f"{root}/data/{part.name}") as f:
        for b in pq.ParquetFile(f).iter_batches(ROWS, columns=names):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(b)), pa.int64()), *b.columns], names=["seq", *names])
            at += len(b)


class PointsReader(DataSourceReader):
    def __init__(self, path: str, log: list[dict], names: list[str]):
        self.path, self.names = path, names
        self.parts = [FilePart(name, first) for e in log for name, rows, first in e["files"] if rows]

    def partitions(self) -> list[FilePart]:
        return self.parts or [FilePart("", -1)]

    def read(self, part: FilePart) -> Iterator:
        return iter(()) if part.first < 0 else _read(self.path, part, self.names)


class PointsStream(DataSourceStreamReader):
    def __init__(self, path: str, names: list[str], most: int | None):
        self.path, self.names, self.most = path, names, most
        self.told = 0

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        have = len(_entries(self.path))
        # with most_appends a batch takes that many entries more than what was told last
        self.told = have if self.most is None else min(have, self.told + self.most)
        return {"entry": self.told}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        self.told = max(self.told, end["entry"])
        return [FilePart(name, first) for e in _entries(self.path)[start["entry"] : end["entry"]] for name, rows, first in e["files"] if rows]

    def read(self, part: FilePart) -> Iterator:
        return _read(self.path, part, self.names)

    def commit(self, end: dict) -> None:
        """Entries are kept: other readers may be behind."""


class _Writer:
    """What batch and stream writers share: a file for each task, and its deletion if the job fails."""

    def __init__(self, path: str, names: list[str], ncalls: int | None):
        self.path, self.names, self.ncalls = path, names, ncalls

    def write(self, rows: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        from pyspark import TaskContext

        system, root = _open(self.path)
        system.create_dir(f"{root}/data", recursive=True)
        schema = pa.schema([(n, pa.float64()) for n in self.names])
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
        count, held = 0, []
        try:
            with system.open_output_stream(f"{root}/data/{name}") as s, pq.ParquetWriter(s, schema) as w:
                def put() -> None:
                    cols = [[None if r[n] is None else float(r[n]) for r in held] for n in self.names]
                    w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols], schema=schema))
                    held.clear()

                for row in rows:
                    held.append(row.asDict())
                    count += 1
                    if len(held) == ROWS:
                        put()
                if held:
                    put()
        except BaseException:
            system.delete_file(f"{root}/data/{name}")
            raise
        return Written([(name, count)])

    def _files(self, messages: list) -> list[tuple[str, int]]:
        return sorted(f for m in messages if m is not None for f in m.files)

    def _undo(self, messages: list) -> None:
        system, root = _open(self.path)
        for name, _ in self._files(messages):
            system.delete_file(f"{root}/data/{name}")


class PointsWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        _append(self.path, self._files(messages), self.names, self.ncalls, None)

    def abort(self, messages: list) -> None:
        self._undo(messages)


class PointsStreamWriter(_Writer, DataSourceStreamWriter):
    def __init__(self, path: str, names: list[str], ncalls: int | None, query: str):
        super().__init__(path, names, ncalls)
        self.query = query

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  the interface's name
        _append(self.path, self._files(messages), self.names, self.ncalls, f"{self.query}/{batchId}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._undo(messages)


class PointsSource(DataSource):
    """Rows (seq, birth, logl, quality, u_.., p_..), or those of ``names``; a null birth is from the prior."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _log(self) -> list[dict]:
        return _entries(self.options["path"])

    def schema(self) -> str:
        return "seq long, " + ", ".join(f"`{n}` double" for n in _names(self.options, self._log()))

    def reader(self, schema: StructType) -> PointsReader:
        log = self._log()
        return PointsReader(self.options["path"], log, _names(self.options, log))

    def streamReader(self, schema: StructType) -> PointsStream:  # noqa: N802
        most = self.options.get("most_appends")
        return PointsStream(self.options["path"], _names(self.options, self._log()), int(most) if most else None)

    def _own(self, schema: StructType, overwrite: bool) -> tuple[list[str], int | None]:
        if overwrite:
            raise ValueError("stores only grow: use the mode append")
        given = [f.name for f in schema.fields if f.name != "seq"]
        options = self.options if "names" in self.options or "x_dim" in self.options else {**self.options, "names": ",".join(given)}
        names = _names(options, self._log())
        if given != names:
            raise ValueError(f"rows of {given} do not fit a store of {names}")
        calls = self.options.get("ncalls")
        return names, int(calls) if calls is not None else None

    def writer(self, schema: StructType, overwrite: bool) -> PointsWriter:
        return PointsWriter(self.options["path"], *self._own(schema, overwrite))

    def streamWriter(self, schema: StructType, overwrite: bool) -> PointsStreamWriter:  # noqa: N802
        return PointsStreamWriter(self.options["path"], *self._own(schema, overwrite), self.options.get("query_name", "stream"))


def calls(path: str) -> int:
    """Likelihood calls so far, as the last append told."""
    log = _entries(path)
    return log[-1]["ncalls"] if log else 0


def vacuum(path: str) -> int:
    """Deletes the files that no entry names, such as those of tasks that were killed, and says how many; only while nothing writes to the store."""
    from pyarrow import fs

    system, root = _open(path)
    named = {name for e in _entries(path) for name, *_ in e["files"]}
    lost = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f.base_name not in named]
    for p in lost:
        system.delete_file(p)
    return len(lost)
