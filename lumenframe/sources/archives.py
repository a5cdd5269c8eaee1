"""Array archives and named files as Spark data sources: read in ranges of rows, written whole or not at all."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one task's range and of one batch, and rows of one written archive.
RANGE_ROWS, BATCH_ROWS, ARCHIVE_ROWS = 1 << 16, 4096, 1 << 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a local path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _archives(store: fs.FileSystem, path: str) -> list[str]:
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no such file or folder: {path}")
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.endswith(".npz") and not f.base_name.startswith(("_", ".")))


def _head(member: io.BufferedIOBase, where: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and the bytes before the data of an array's file; pickled and column-major arrays are errors."""
    version = np.lib.format.read_magic(member)
    shape, column_major, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
    if kind.hasobject:
        raise ValueError(f"{where}: pickled objects")
    if column_major and len(shape) > 1:
        raise ValueError(f"{where}: not in row order")
    return shape, kind, member.tell()


@dataclass
class RowRange(InputPartition):
    path: str
    low: int
    high: int


class ArrayReader(DataSourceReader):
    """Ranges of rows of the archives; a task opens only the arrays that the schema names, and reads only its range of them."""

    def __init__(self, path: str, schema: T.StructType, rows: int) -> None:
        self.path, self.kinds, self.rows = path, [f for f in schema if f.name != "path"], rows

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        out: list[InputPartition] = []
        for name in _archives(store, root):
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                lengths = set()
                for k in self.kinds:
                    if f"{k.name}.npy" not in z.namelist():
                        raise ValueError(f"{name}: no array {k.name}")
                    with z.open(f"{k.name}.npy") as member:
                        shape = _head(member, f"{name}: {k.name}")[0]
                        lengths |= {shape[0]} if shape else set()
                if len(lengths) > 1:
                    raise ValueError(f"{name}: arrays of lengths {sorted(lengths)}")
                n = lengths.pop() if lengths else 1
            out += [RowRange(name, low, min(low + self.rows, n)) for low in range(0, n, self.rows)]
        return out or [RowRange("", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition.low == partition.high:
            return
        store, _ = _store(self.path)
        types = [to_arrow_type(k.dataType) for k in self.kinds]
        with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            members = []
            for k in self.kinds:
                member = z.open(f"{k.name}.npy")
                shape, kind, begin = _head(member, k.name)
                each = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize if shape else kind.itemsize
                if shape:
                    member.seek(begin + partition.low * each)  # a stored array is skipped to, a compressed one read through
                members.append((member, shape, kind, each, None if shape else np.frombuffer(member.read(each), kind)[0]))
            for low in range(partition.low, partition.high, BATCH_ROWS):
                n, cells = min(BATCH_ROWS, partition.high - low), []
                for (member, shape, kind, each, single), t in zip(members, types, strict=True):
                    values = np.frombuffer(member.read(n * each), kind).reshape(n, *shape[1:]) if shape else np.repeat(single, n)
                    cells.append(pa.array(values.tolist(), t))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), *cells], ["path", *(k.name for k in self.kinds)])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class StagedWriter(DataSourceArrowWriter):
    """Tasks write below a staging folder of the job's own; the commit moves what finished tasks name and drops the rest.

    A task that dies leaves nothing behind but a file in the staging folder, which no reader sees; its second attempt
    writes another one. If the job fails, the staging folder is deleted.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, root = _store(self.path)
        return store, root, f"{root}/_staged-{self.job}"

    def commit(self, messages: list[Written | None]) -> None:
        store, root, staged = self._places()
        done = [name for m in messages if m for name in m.files]
        targets = [name.rsplit("~", 1)[0] for name in done]
        if len(set(targets)) < len(targets):
            store.delete_dir(staged)
            raise ValueError("two tasks wrote a file of one name")
        store.create_dir(root)
        old = {f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
        for name, target in zip(done, targets, strict=True):
            if not self.overwrite and f"{root}/{target}" in old:
                raise ValueError(f"{target} exists")
            store.move(f"{staged}/{name}", f"{root}/{target}")
        for path in old - {f"{root}/{t}" for t in targets} if self.overwrite else ():
            store.delete_file(path)
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, _, staged = self._places()
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class ArrayWriter(StagedWriter):
    """Archives of at most ``rows`` rows, an array for each column; list columns of one length become matrices."""

    def __init__(self, path: str, overwrite: bool, schema: T.StructType, rows: int) -> None:
        super().__init__(path, overwrite)
        self.names, self.rows = [f.name for f in schema], rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staged = self._places()
        store.create_dir(staged)
        task, files, held, n = uuid.uuid4().hex, [], [], 0

        def flush() -> None:
            nonlocal n
            table = pa.Table.from_batches(held).combine_chunks()
            arrays = {}
            for name in self.names:
                column = table[name].combine_chunks()
                if column.null_count or pa.types.is_list(column.type) and column.flatten().null_count:
                    raise ValueError(f"{name}: nulls have no place in an array")
                if pa.types.is_list(column.type):
                    sizes = set(np.diff(column.offsets.to_numpy()).tolist())
                    if len(sizes) > 1:
                        raise ValueError(f"{name}: rows of {len(sizes)} lengths")
                    arrays[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
                else:
                    arrays[name] = np.array(column.to_pylist()) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
            name = f"part-{task}-{len(files):05}.npz~{task}"
            with store.open_output_stream(f"{staged}/{name}") as f:
                data = io.BytesIO()
                np.savez(data, **arrays)
                f.write(data.getbuffer())
            files.append(name)
            held.clear()
            n = 0

        for b in iterator:
            at = 0
            while at < len(b):
                take = min(self.rows - n, len(b) - at)
                held.append(b.slice(at, take))
                at, n = at + take, n + take
                if n == self.rows:
                    flush()
        if n:
            flush()
        return Written(files)


class LineWriter(StagedWriter):
    """A text file for each name: the lines of rows (name, line) in the order in which they come, those of a name together."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staged = self._places()
        store.create_dir(staged)
        task, files, now, out = uuid.uuid4().hex, [], None, None
        try:
            for b in iterator:
                for name, line in zip(b["name"].to_pylist(), b["line"].to_pylist(), strict=True):
                    if name != now:
                        if out:
                            out.close()
                        if not name or "/" in name or "~" in name or name.startswith(("_", ".")) or f"{name}~{task}" in files:
                            raise ValueError(f"no name for a file, or one whose lines aren't together: {name!r}")
                        files.append(f"{name}~{task}")
                        now, out = name, store.open_output_stream(f"{staged}/{name}~{task}")
                    out.write((line or "").encode() + b"\n")
        finally:
            if out:
                out.close()
        return Written(files)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenframe_arrays"

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], schema, int(self.options.get("rows", RANGE_ROWS)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], overwrite, schema, int(self.options.get("rows", ARCHIVE_ROWS)))


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenframe_lines"

    def writer(self, schema: T.StructType, overwrite: bool) -> LineWriter:
        if [(f.name, f.dataType) for f in schema] != [("name", T.StringType()), ("line", T.StringType())]:
            raise ValueError("rows must be name string, line string")
        return LineWriter(self.options["path"], overwrite)


def read_arrays(spark: SparkSession, path: str, schema: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Archives (.npz) of a file or folder as a table of path and the arrays that ``schema`` names, ``rows`` rows a task.

    Arrays run along their first dimension; a matrix gives array columns; an array without dimensions is repeated in
    every row. Only named arrays are opened. Arrays of unequal length, missing, pickled and column-major ones are errors.
    Every worker must reach ``path`` through Arrow's file systems; ``readers.array_files`` reads stores that only Spark does.
    """
    spark.dataSource.register(ArraySource)
    return spark.read.format("lumenframe_arrays").schema(f"path string, {schema}").option("rows", rows).load(path)


def write_arrays(df: DataFrame, path: str, mode: str = "append", rows: int = ARCHIVE_ROWS) -> None:
    """``df`` as archives below ``path``, each of at most ``rows`` rows: all of them or, if the job fails, none."""
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("lumenframe_arrays").mode(mode).option("rows", rows).save(path)


def write_lines(df: DataFrame, path: str, order: list[str], mode: str = "append") -> None:
    """Rows (name, line, ...) as a text file for each name, lines in the given order: all files or none."""
    df.sparkSession.dataSource.register(LineSource)
    sorted_ = df.repartition("name").sortWithinPartitions("name", *order).select("name", "line")
    sorted_.write.format("lumenframe_lines").mode(mode).save(path)


def write_scores(scores: DataFrame, classes: list[str], path: str, mode: str = "append") -> None:
    """``scores_<video>.csv`` for each video: a header, start_sec with three and a column for each class with six decimals."""
    table = scores.groupBy("video", "start_sec").pivot("class", classes).agg(F.first("score"))
    cells = F.concat_ws(",", F.format_string("%.3f", "start_sec"), *(F.when(F.col(f"`{c}`").isNotNull(), F.format_string("%.6f", F.col(f"`{c}`"))).otherwise("") for c in classes))
    body = table.select(F.format_string("scores_%s.csv", F.col("video").cast("string")).alias("name"), cells.alias("line"), "start_sec")
    head = body.select("name").distinct().select("name", F.lit(",".join(["start_sec", *classes])).alias("line"), F.lit(None).cast(dict(body.dtypes)["start_sec"]).alias("start_sec"))
    write_lines(head.unionByName(body), path, ["start_sec"], mode)


def write_splits(items: DataFrame, path: str, mode: str = "append") -> None:
    """``<split>.txt`` for each split: its distinct videos in order."""
    write_lines(items.select(F.format_string("%s.txt", "split").alias("name"), F.col("video").cast("string").alias("line")).distinct(), path, ["line"], mode)
