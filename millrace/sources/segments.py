"""A custom source and sink: a folder of Arrow files with a log of commits, read in batch or as a stream.

A write puts one file for each task into the folder and, when all are there, adds
an entry to the log: the files, their rows and the least and largest value of
each column that has an order. What is not in the log isn't read, so a write that
fails or is given up leaves the table as it was. A read takes a partition for
each file; filters that Spark pushes down drop whole files by these values and
rows as they are read. As a stream, each entry of the log is a micro-batch's
offset.

Spark pushes filters into Python sources only with PUSHDOWN on. The folder is any
that Arrow's file systems reach; driver and executors have to share it. One
writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
LOG = "_log"
_COMPARE = {EqualTo: pc.equal, EqualNullSafe: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _entries(path: str) -> list[list[dict]]:
    """The log, oldest entry first."""
    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/{LOG}", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda f: f.base_name):
        with store.open_input_file(info.path) as f:
            out.append(json.loads(f.read()))
    return out


@dataclass
class Segment(InputPartition):
    path: str
    columns: list[str]
    filters: list[tuple[str, str, object]]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def _name(f: Filter) -> str:
    return type(f).__name__


def _understood(f: Filter) -> bool:
    plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
    if len(getattr(f, "attribute", ())) != 1:
        return False
    if isinstance(f, In):
        return all(map(plain, f.value))
    return isinstance(f, IsNotNull) or type(f) in _COMPARE and plain(f.value)


def _may_hold(f: Filter, bounds: dict[str, list]) -> bool:
    """Whether a file with these least and largest values can have a row that the filter keeps."""
    if f.attribute[0] not in bounds:
        return True
    low, high = bounds[f.attribute[0]]
    if low is None:
        return False  # nulls only
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value)
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return low <= f.value <= high
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return high > f.value or isinstance(f, GreaterThanOrEqual) and high == f.value
    if isinstance(f, (LessThan, LessThanOrEqual)):
        return low < f.value or isinstance(f, LessThanOrEqual) and low == f.value
    return True


def _kept(b: pa.RecordBatch, filters: list[tuple[str, str, object]]) -> pa.RecordBatch:
    for kind, column, value in filters:
        c = b.column(column)
        if kind == "IsNotNull":
            keep = c.is_valid()
        elif kind == "In":
            keep = pc.is_in(c, pa.array(value, c.type))
        else:
            keep = next(f for k, f in _COMPARE.items() if k.__name__ == kind)(c, pa.scalar(value, c.type))
        b = b.filter(keep)
    return b


def _batches(part: Segment | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # a table without files
        return
    store, path = _open(part.path)
    with store.open_input_file(path) as f, pa.ipc.open_file(f) as file:
        for k in range(file.num_record_batches):
            yield _kept(file.get_batch(k), part.filters).select(part.columns)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns, self.filters = path, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if _understood(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Segment]:
        files = [f for entry in _entries(self.path) for f in entry if all(_may_hold(x, f["bounds"]) for x in self.filters)]
        told = [(_name(f), f.attribute[0], list(f.value) if isinstance(f, In) else getattr(f, "value", None)) for f in self.filters]
        return [Segment(f"{self.path}/{f['file']}", self.columns, told) for f in files]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns = path, schema.names

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"entries": len(_entries(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(f"{self.path}/{f['file']}", self.columns, []) for entry in _entries(self.path)[start["entries"] : end["entries"]] for f in entry]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        name, rows, bounds, sink = f"part-{uuid.uuid4().hex}.arrow", 0, {}, None
        for b in iterator:
            if sink is None:
                out = store.open_output_stream(f"{root}/{name}")
                sink = pa.ipc.new_file(out, b.schema)
            sink.write_batch(b)
            rows += b.num_rows
            for c, kind in zip(b.schema.names, b.schema.types, strict=True):
                if pa.types.is_integer(kind) or pa.types.is_string(kind):
                    found = pc.min_max(b.column(c)).as_py()
                    ends = [x for x in (*bounds.get(c, ()), found["min"], found["max"]) if x is not None]
                    bounds[c] = [min(ends), max(ends)] if ends else [None, None]
        if sink is None:
            return Written([])
        sink.close()
        out.close()
        return Written([{"file": name, "rows": rows, "bounds": bounds}])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        old = _entries(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        store.create_dir(f"{root}/{LOG}", recursive=True)
        if self.overwrite and old:
            store.delete_dir_contents(f"{root}/{LOG}")
        with store.open_output_stream(f"{root}/{LOG}/{0 if self.overwrite else len(old):012d}.json") as f:
            f.write(json.dumps(files).encode())
        if self.overwrite:
            self._remove([x for entry in old for x in entry])

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([f for m in messages if m is not None for f in m.files])

    def _remove(self, files: list[dict]) -> None:
        store, root = _open(self.path)
        for f in files:
            store.delete_file(f"{root}/{f['file']}")


class Segments(DataSource):
    """spark.dataSource.register(Segments); df.write.format("segments").mode("append").save(path); spark.read.format("segments").schema(..).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"), schema)

    def streamReader(self, schema: StructType) -> _StreamReader:  # noqa: N802
        return _StreamReader(self.options["path"].rstrip("/"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].rstrip("/"), overwrite)
