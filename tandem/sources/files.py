"""Readers of the file formats that feed the engine, and the writers that match them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import MatrixSource, matrix_cells


def read_side_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``archive:sequence side v0 v1 ...``, two an item -> ``archive, sequence, vec_l, vec_r``."""
    parts = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    rows = parts.select(
        F.split(F.col("f")[0], ":")[0].cast("int").alias("archive"),
        F.split(F.col("f")[0], ":")[1].cast("int").alias("sequence"),
        F.col("f")[1].alias("side"),
        F.expr("slice(f, 3, size(f) - 2)").cast("array<double>").alias("v"),
    )
    both = rows.groupBy("archive", "sequence").pivot("side", ["l", "r"]).agg(F.first("v"))
    return both.withColumnsRenamed({"l": "vec_l", "r": "vec_r"})


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``word v0 v1 ...`` -> ``word, vec``; a heading of two numbers is skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) > 2")
    return parts.select(F.col("f")[0].alias("word"), F.expr("slice(f, 2, size(f) - 1)").cast("array<double>").alias("vec"))


def read_id_values(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Lines ``id value`` parted by white space."""
    parts = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    return parts.select(F.col("f")[0].alias("id"), F.col("f")[1].cast(kind).alias("value"))


def read_text_histograms(spark: SparkSession, path: str) -> DataFrame:
    """One file of numbers an item -> ``path, histo``; a file is one row, as its numbers are one array."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("histo"))


def read_binary_histograms(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One file of big-endian float32 an item -> ``path, histo``; a length that is no multiple of 4 ends the query."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(raw, ">f4").astype(float) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["path", "histo"])

    return rows.mapInArrow(decode, "path string, histo array<double>")


def read_pair_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines ``id1 id2 v12 v21`` of several models -> ``id1, id2, model, v12, v21``.

    A pair that is missing in some file, or twice in one, ends the query.
    """
    rows = None
    for model, path in enumerate(paths):
        part = spark.read.text(path).where("trim(value) <> ''").select(F.lit(model).alias("model"), F.split(F.trim("value"), r"\s+").alias("f"))
        rows = part if rows is None else rows.unionByName(part)
    named = rows.select(F.col("f")[0].alias("id1"), F.col("f")[1].alias("id2"), "model", F.col("f")[2].cast("double").alias("v12"), F.col("f")[3].cast("double").alias("v21"))
    whole = named.groupBy("id1", "id2").agg(F.count("*").alias("n"), F.array_agg(F.struct("model", "v12", "v21")).alias("values"))
    checked = whole.withColumn("values", F.when(F.col("n") == len(paths), F.col("values")).otherwise(F.raise_error(F.concat(F.lit("pair not in every file: "), "id1", F.lit(" "), "id2"))))
    return checked.select("id1", "id2", F.inline("values"))


def read_score_matrix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """A dense n x n matrix of big-endian float32 in [0, 1] -> ``i, j, p`` and ``scaled = (1 - p) * 1e7``; see ``matrix``."""
    spark.dataSource.register(MatrixSource)
    return matrix_cells(spark.read.format("f32matrix").option("n", n).load(path)).drop("model")


def discover_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, name, length, modified`` of all files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, name`` of the files that a list file names, one a line; blank lines and comments (``#``) are passed over."""
    rows = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and path not like '#%'")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).distinct()


def pictures(files: DataFrame, sides: DataFrame | None = None, orient: str | None = None) -> DataFrame:
    """``id, archive, sequence, path, name`` (and ``orient``) of ``files(path, name)`` that are pictures of an archive.

    A picture lies in a folder that is its archive's number, and the digits at
    the start of its name, or after a first word, are its sequence; its id is
    both, with a slash. Other files give no row. ``sides(id, width, height)``
    tells which are upright (``v``); with ``orient`` only those are kept, and
    pictures without sides go.
    """
    archive = F.regexp_extract("path", r"/(\d+)/[^/]+$", 1)
    sequence = F.regexp_extract("name", r"^(?:[A-Za-z]+[_-]?)?0*(\d+)[^/]*\.(?i:jpe?g)$", 1)
    named = files.select("path", "name", archive.alias("archive"), sequence.alias("sequence")).where("archive <> '' and sequence <> ''")
    rows = named.select(F.concat_ws("/", F.col("archive").cast("int"), "sequence").alias("id"), F.col("archive").cast("int").alias("archive"), F.col("sequence").cast("int").alias("sequence"), "path", "name")
    if sides is None:
        return rows
    turned = rows.join(sides.select("id", F.when(F.col("height") > F.col("width"), "v").otherwise("h").alias("orient")), "id", "left" if orient is None else "inner")
    return turned if orient is None else turned.where(F.col("orient") == orient)


def import_directory(spark: SparkSession, path: str, known: DataFrame, archive: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The pictures below a folder that ``known(id)`` lacks, and ids that two of its files claim; contents are not read.

    Of several files with one id none is imported. ``archive`` limits the import to one.
    """
    found = pictures(discover_files(spark, path))
    found = found if archive is None else found.where(F.col("archive") == archive)
    twice = found.groupBy("id").agg(F.count("*").alias("files")).where("files > 1")
    return found.join(twice, "id", "left_anti").join(known.select("id"), "id", "left_anti"), twice


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The pair table, one folder an orientation; written rows carry no order."""
    pairs.write.partitionBy("orient").mode("errorifexists").parquet(path)


def write_neighbours(pairtop: DataFrame, path: str) -> None:
    """The neighbour table, one folder a tag, with its tag counts beside it."""
    pairtop.write.partitionBy("tag").mode("errorifexists").parquet(f"{path}/pairtop")
    pairtop.groupBy("tag").agg(F.count("*").alias("ct")).write.mode("errorifexists").parquet(f"{path}/tags")


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    rows.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)
