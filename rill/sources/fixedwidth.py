"""Headerless little-endian fixed-width rows: int32 (`i`), float32 (`f`), int64 (`L`) and CHAR(n) (`c<n>`).

A layout is text such as ``"n_nationkey i, n_name c25, n_regionkey i"``. Files are read in byte ranges cut at
row borders, so one large file is read by many tasks; pyarrow's file systems reach local and remote stores.
CHAR values are padded with spaces when written and stripped of trailing spaces and NULs when read. The format
has no NULL: a null is refused on writing. A trailing part of a row is an error.

As a stream, a file is read from where the last batch ended it, so files may be added and may grow by whole rows; the
offset holds each file's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

_NUMPY = {"i": "<i4", "f": "<f4", "L": "<i8"}
_SPARK = {"i": T.IntegerType(), "f": T.FloatType(), "L": T.LongType()}


@dataclass(frozen=True)
class Layout:
    names: tuple[str, ...]
    kinds: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> Layout:
        pairs = [field.split() for field in text.split(",")]
        return cls(tuple(p[0] for p in pairs), tuple(p[1] for p in pairs))

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, _NUMPY.get(k) or f"S{int(k[1:])}") for n, k in zip(self.names, self.kinds, strict=True)])

    @property
    def schema(self) -> T.StructType:
        fields = (
            T.StructField(n, _SPARK.get(k, T.StringType()), False, {"width": self.dtype[n].itemsize})
            for n, k in zip(self.names, self.kinds, strict=True)
        )
        return T.StructType(list(fields))

    def decode(self, data: bytes) -> pa.RecordBatch:
        rows = np.frombuffer(data, self.dtype)
        columns = []
        for name, kind in zip(self.names, self.kinds, strict=True):
            if kind in _NUMPY:
                columns.append(pa.array(np.ascontiguousarray(rows[name])))
            else:
                columns.append(_stripped(np.ascontiguousarray(rows[name])))
        return pa.RecordBatch.from_arrays(columns, list(self.names))

    def encode(self, batch: pa.RecordBatch) -> bytes:
        rows = np.zeros(batch.num_rows, self.dtype)
        for name, kind in zip(self.names, self.kinds, strict=True):
            column = batch.column(name)
            if column.null_count:
                raise ValueError(f"{name}: the fixed-width format has no NULL")
            if kind in _NUMPY:
                rows[name] = column.to_numpy(zero_copy_only=False)
            else:
                rows[name] = _padded(column, int(kind[1:]), name)
        return rows.tobytes()


def _padded(column: pa.Array, width: int, name: str) -> np.ndarray:
    """Values as bytes of `width`, filled with spaces."""
    raw = column.cast(pa.binary())
    longest = pc.max(pc.binary_length(raw)).as_py() or 0
    if longest > width:
        raise ValueError(f"{name}: {longest} bytes do not fit CHAR({width})")
    if column.type == pa.string() and pc.all(pc.string_is_ascii(column)).as_py():
        raw = pc.ascii_rpad(column, width, " ").cast(pa.binary())
        return np.frombuffer(b"".join(raw.to_pylist()), f"S{width}")
    return np.array([v.ljust(width) for v in raw.to_pylist()], f"S{width}")


def _stripped(values: np.ndarray) -> pa.Array:
    """Strings of fixed-width bytes, without the spaces and NULs at their ends."""
    raw = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    filled = (raw != 32) & (raw != 0)
    ends = np.where(filled.any(axis=1), raw.shape[1] - filled[:, ::-1].argmax(axis=1), 0)
    kept = raw[np.arange(raw.shape[1]) < ends[:, None]]
    offsets = np.append(0, np.cumsum(ends)).astype(np.int32)
    text = pa.StringArray.from_buffers(len(values), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes()))
    text.validate(full=True)
    return text


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


def _files(path: str, width: int) -> dict[str, int]:
    """Sizes of the data files of a file or folder."""
    from pyarrow import fs

    store, where = _filesystem(path)
    found = store.get_file_info(where)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.is_file else store.get_file_info(fs.FileSelector(where, recursive=True))
    sizes = {f.path: f.size for f in files if f.is_file and f.base_name[0] not in "._"}
    for name, size in sizes.items():
        if size % width:
            raise ValueError(f"{name}: {size} bytes are no whole number of {width}-byte rows")
    return sizes


def _ranges(sizes: dict[str, int], begun: dict[str, int], step: int) -> list[_Range]:
    return [_Range(f, a, min(n, a + step)) for f, n in sorted(sizes.items()) for a in range(begun.get(f, 0), n, step)] or [_Range("", 0, 0)]


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, layout: Layout, path: str, rows_per_task: int):
        self.layout, self.path, self.rows_per_task = layout, path, rows_per_task

    @property
    def step(self) -> int:
        return self.layout.dtype.itemsize * self.rows_per_task

    def read(self, partition):
        step = 65536 * self.layout.dtype.itemsize
        if not partition.path:
            return
        store, _ = _filesystem(self.path)
        with store.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.stop, step):
                yield self.layout.decode(f.read_at(min(step, partition.stop - at), at))


class _Reader(_Reading, DataSourceReader):
    def partitions(self):
        return _ranges(_files(self.path, self.layout.dtype.itemsize), {}, self.step)


class _StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self):
        return {}

    def latestOffset(self):
        return _files(self.path, self.layout.dtype.itemsize)

    def partitions(self, start, end):
        return _ranges(end, start, self.step)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Writing:
    """Each task writes a file of its own under a name that only a commit makes visible to readers."""

    def __init__(self, layout: Layout, path: str):
        self.layout, self.path = layout, path

    def write(self, iterator):
        from pyspark import TaskContext

        context, (store, where) = TaskContext.get(), _filesystem(self.path)
        store.create_dir(where, recursive=True)
        name, rows = f"{where}/_part-{context.partitionId():05d}-{context.taskAttemptId()}", 0
        with store.open_output_stream(name) as out:
            for batch in iterator:
                out.write(self.layout.encode(batch))
                rows += batch.num_rows
        return _Written(name, rows)

    def commit(self, messages, *_):
        store, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                store.move(m.path, f"{folder}/{name[1:]}.bin")

    def abort(self, messages, *_):
        store, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class _Writer(_Writing, DataSourceArrowWriter):
    pass


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    pass


class FixedWidthSource(DataSource):
    """Options: `path`, `layout`, `rowsPerTask`."""

    @classmethod
    def name(cls):
        return "fixedwidth"

    def _layout(self) -> Layout:
        return Layout.parse(self.options["layout"])

    def schema(self):
        return self._layout().schema

    def _reading(self) -> tuple[Layout, str, int]:
        return self._layout(), self.options["path"], int(self.options.get("rowsPerTask", 1_000_000))

    def reader(self, schema):
        return _Reader(*self._reading())

    def streamReader(self, schema):
        return _StreamReader(*self._reading())

    def writer(self, schema, overwrite):
        return _Writer(self._layout(), self.options["path"])

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self._layout(), self.options["path"])


def read_fixed_width(spark: SparkSession, path: str, layout: str, rows_per_task: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(FixedWidthSource)
    return spark.read.format("fixedwidth").option("layout", layout).option("rowsPerTask", rows_per_task).load(path)


def stream_fixed_width(spark: SparkSession, path: str, layout: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """The same files as a stream."""
    spark.dataSource.register(FixedWidthSource)
    return spark.readStream.format("fixedwidth").option("layout", layout).option("rowsPerTask", rows_per_task).load(path)


def write_fixed_width(df: DataFrame, path: str, layout: str) -> None:
    """Write the layout's columns of `df`, one file a partition; the folder must be new."""
    df.sparkSession.dataSource.register(FixedWidthSource)
    fields = [df[f.name].cast(f.dataType) for f in Layout.parse(layout).schema]
    (df.select(*fields).write.format("fixedwidth").option("layout", layout).mode("append").save(path))


def export_sorted(df: DataFrame, path: str, layout: str, order: list[str], parts: int = 16) -> None:
    """Write `df` in `parts` files at most, each a range of the order and sorted."""
    write_fixed_width(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), path, layout)
