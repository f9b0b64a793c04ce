"""Helpers the corpus operators share: shared-folder tables and document keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is read from ``spark.checkpoint.dir``. Only a local session (tests) gets
    a temporary folder when the setting is absent; a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Later steps neither recompute it nor depend on a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more, once what was made of them is written itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Keys that ``join_by_weight`` broadcasts.
HOT = 2000


def join_by_weight(rows: DataFrame, marks: DataFrame, keys: list[str], weight: str, hot: int | None = None) -> DataFrame:
    """``rows`` inner-joined with ``marks``, a written table of one row a key that tells how many rows have it.

    The ``hot`` keys of most rows meet their rows by a broadcast of so many
    marks, the others by a join on the key. So no key of that join has more than
    one in ``hot`` of all rows, and a key with a third of them stays where it lies.
    """
    most = marks.orderBy(F.desc(weight), *keys).limit(HOT if hot is None else hot)  # bounds both broadcasts
    rest = rows.join(F.broadcast(most.select(*keys)), keys, "left_anti")
    cold = marks.join(F.broadcast(most.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(most), keys).unionByName(rest.join(cold.hint("merge"), keys))


#: Bits of the filter that ``key_filter`` broadcasts, as a row for each 64 that has any.
FILTER_BITS = 1 << 23


def key_filter(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (long) may be among ``keys(filter_key)``, and those whose key is surely not.

    At most FILTER_BITS / 64 rows are broadcast, whatever ``keys`` holds, so what
    need not meet them by a shuffle stays where it lies. With more keys than bits
    nearly all rows pass, which is only slower. Both parts keep the columns of ``rows``.
    """
    place = F.pmod("filter_key", F.lit(FILTER_BITS))
    cells = keys.select(F.floor(place / 64).cast("int").alias("filter_cell"), (place % 64).cast("int").alias("bit"))
    cells = cells.groupBy("filter_cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("filter_mask"))
    own = F.pmod(key, F.lit(FILTER_BITS))
    here = rows.withColumns({"filter_own": F.floor(own / 64).cast("int"), "filter_bit": (own % 64).cast("int")})
    met = (F.col("filter_own") == F.col("filter_cell")) & F.expr("(shiftright(filter_mask, filter_bit) & 1) = 1")
    passing, others = (here.join(F.broadcast(cells), met, how).drop("filter_own", "filter_bit") for how in ("left_semi", "left_anti"))
    return passing, others


def held_out(doc_id: Column | str) -> Column:
    """True for the third of the documents that no model may learn from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_digest(text: Column | str) -> Column:
    """16 bytes that name a text; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(text.cast("binary")))
