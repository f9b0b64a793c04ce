"""Dense score matrices of 32-bit floats as a data source: read by ranges of rows, written as files of rows.

A matrix is one file of ``n * n`` numbers, or a folder of files that hold successive rows and
are named by them. Files are reached through ``pyarrow.fs``, so a path may be local or a URI of
any store it knows. Several matrices of one size are read together, row range by row range.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a read task takes at once, and that a partition reads in all.
CHUNK, PARTITION = 8 << 20, 64 << 20
KINDS = {"big": ">f4", "little": "<f4"}
PART = re.compile(r"rows-(\d+)-(\d+)\.f32$")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file:" + path)


def _kind(options: dict) -> str:
    order = options.get("order", "big")
    if order not in KINDS:
        raise ValueError(f"no such byte order: {order}")
    return KINDS[order]


@dataclass
class Rows(InputPartition):
    """Rows ``begin`` to ``end`` of a matrix, which start in ``file`` at row ``first``."""

    model: int
    file: str
    first: int
    begin: int
    end: int
    n: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.options = _kind(options), dict(options)
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.low, self.high = float(options.get("low", 0)), float(options.get("high", 1))

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """``file, first row, size`` of each file of a matrix; files of rows are whole and follow one another."""
        store, inner = _store(path)
        about = store.get_file_info(inner)
        if about.type == pafs.FileType.NotFound:
            raise ValueError(f"{path}: no such matrix")
        if about.is_file:
            return [(path, 0, about.size)]
        found = sorted((int(m[1]), int(m[2]), f) for f in store.get_file_info(pafs.FileSelector(inner)) if (m := PART.search(f.path)))
        if [b for b, _, _ in found] != [0, *[e for _, e, _ in found]][: len(found)] or not found:
            raise ValueError(f"{path}: files of rows do not follow one another")
        n = found[-1][1]
        for begin, end, f in found:
            if f.size != 4 * n * (end - begin):
                raise ValueError(f"{f.path}: {f.size} bytes instead of {4 * n * (end - begin)}")
        return [(f"{path.rstrip('/')}/{f.base_name}", begin, f.size) for begin, _, f in found]

    def partitions(self) -> list[Rows]:
        out, sizes = [], set()
        for model, path in enumerate(self.paths):
            files = self.files(path)
            total = sum(size for _, _, size in files)
            n = int(self.options.get("n", 0)) or int(np.sqrt(total // 4) + 0.5)
            if total != 4 * n * n:
                raise ValueError(f"{path}: {total} bytes, which is no matrix of {n} x {n}")
            sizes.add(n)
            step = max(1, PARTITION // (4 * n))
            for file, first, size in files:
                rows = size // (4 * n)
                out += [Rows(model, file, first, first + at, first + min(rows, at + step), n) for at in range(0, rows, step)]
        if len(sizes) > 1:
            raise ValueError(f"matrices of different sizes: {sorted(sizes)}")
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        store, inner = _store(p.file)
        step = max(1, CHUNK // (4 * p.n))
        with store.open_input_file(inner) as file:
            for begin in range(p.begin, p.end, step):
                rows = min(p.end, begin + step) - begin
                raw = file.read_at(4 * p.n * rows, 4 * p.n * (begin - p.first))
                if len(raw) != 4 * p.n * rows:
                    raise ValueError(f"{p.file}: ends in row {begin + len(raw) // (4 * p.n)}")
                values = np.frombuffer(raw, self.kind).astype("<f4")
                if not ((values >= self.low) & (values <= self.high)).all():
                    bad = begin + int(np.flatnonzero(~((values >= self.low) & (values <= self.high)))[0]) // p.n
                    raise ValueError(f"{p.file}, row {bad}: a value outside {self.low} to {self.high}")
                offsets = pa.array(np.arange(0, (rows + 1) * p.n, p.n, dtype=np.int32)) if p.n else pa.array(np.zeros(rows + 1, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, p.model, np.int32)), pa.array(np.arange(begin, begin + rows)), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["model", "i", "values"]
                )


@dataclass
class Written(WriterCommitMessage):
    begin: int
    end: int
    file: str


class MatrixWriter(DataSourceArrowWriter):
    """Each task writes the successive rows it gets; they count only once all tasks have ended."""

    def __init__(self, options: dict, overwrite: bool):
        self.kind, self.path, self.overwrite = _kind(options), options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = _store(self.path)
        store.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tmp"
        begin = end = None
        with store.open_output_stream(f"{inner}/{name}") as out:
            for batch in iterator:
                for i, values in zip(batch.column("i").to_pylist(), batch.column("values")):
                    if end is not None and i != end:
                        raise ValueError(f"row {i} follows row {end - 1}: rows must be sorted, each there once")
                    begin, end = i if begin is None else begin, i + 1
                    out.write(np.asarray(values.values, np.float32).astype(self.kind).tobytes())
        return Written(begin if begin is not None else -1, end if end is not None else -1, name)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = _store(self.path)
        own = sorted((m.begin, m.end, m.file) for m in messages if m and m.begin >= 0)
        if [b for b, _, _ in own] != [0, *[e for _, e, _ in own]][: len(own)]:
            self.abort(messages)
            raise ValueError(f"rows are missing or there twice: {[(b, e) for b, e, _ in own]}")
        old = [f.path for f in store.get_file_info(pafs.FileSelector(inner)) if PART.search(f.path)]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path}: a matrix is there already")
        for path in old:
            store.delete_file(path)
        for begin, end, file in own:
            store.move(f"{inner}/{file}", f"{inner}/rows-{begin:012d}-{end:012d}.f32")
        for m in messages:
            if m and m.begin < 0:
                store.delete_file(f"{inner}/{m.file}")

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = _store(self.path)
        for m in messages:
            if m and store.get_file_info(f"{inner}/{m.file}").is_file:
                store.delete_file(f"{inner}/{m.file}")


class MatrixSource(DataSource):
    """Format ``f32matrix``. Options: ``order`` (``big`` or ``little``), ``n``, ``low``, ``high``, ``paths`` (a JSON list, instead of a path)."""

    @classmethod
    def name(cls) -> str:
        return "f32matrix"

    def schema(self) -> str:
        return "model int, i long, values array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def read_matrices(spark: SparkSession, paths: list[str], order: str = "big", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``model, i, values``: the rows of one or more matrices of one size, numbered by their place in ``paths``.

    A file that is no square, matrices of different sizes, and a value outside
    the range (NaN too) end the query.
    """
    spark.dataSource.register(MatrixSource)
    return spark.read.format("f32matrix").options(paths=json.dumps(paths), order=order, low=low, high=high).load()


def matrix_cells(rows: DataFrame) -> DataFrame:
    """``model, i, j, p`` and ``scaled = (1 - p) * 1e7``, one row a number."""
    cells = rows.select("model", "i", F.posexplode("values").alias("j", "p"))
    return cells.select("model", "i", F.col("j").cast("long").alias("j"), F.col("p").cast("double").alias("p")).withColumn("scaled", ((1 - F.col("p")) * 1e7).cast("long"))


def write_matrix(cells: DataFrame, path: str, order: str = "big", overwrite: bool = False) -> None:
    """Write ``i, j, p`` as one matrix, in the byte order asked for; a task holds one row of it.

    Every row must have a number for every ``j`` from 0 on, all rows the same;
    otherwise the write ends without a matrix.
    """
    spark = cells.sparkSession
    spark.dataSource.register(MatrixSource)
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.col("p").cast("float").alias("p")))).alias("c"), F.count("*").alias("n"), F.count_distinct("j").alias("d"))
    width = cells.agg((F.max("j") + 1).alias("width"), F.min("j").alias("least"))
    whole = (F.col("n") == F.col("width")) & (F.col("d") == F.col("n")) & (F.col("least") == 0)
    checked = rows.crossJoin(F.broadcast(width)).withColumn("values", F.when(whole, F.col("c.p")).otherwise(F.raise_error(F.concat(F.lit("not a whole row: "), F.col("i").cast("string")))))  # one row
    ordered = checked.select(F.lit(0).alias("model"), F.col("i").cast("long").alias("i"), "values").repartitionByRange("i").sortWithinPartitions("i")
    ordered.write.format("f32matrix").option("order", order).mode("overwrite" if overwrite else "append").save(path)
