"""Cutting lineage in iterative operators, through the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt_in_order(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """``rows`` written in a range exchange on group and order, with the partition's number in ``__part``.

    So the rows of a group lie in successive partitions, in order, and no task
    holds a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()))


def before_parts(parts: DataFrame, group: str, **sums: str) -> DataFrame:
    """``parts`` (one row a group and partition) with running sums of columns over the partitions before, 0 at first."""
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *[F.coalesce(F.sum(column).over(earlier), F.lit(0)).alias(name) for name, column in sums.items()])


def summed_before(rows: DataFrame, group: str, weight: str, *order: str | Column, name: str = "before") -> DataFrame:
    """With each row the sum of ``weight`` over the rows of its group before it, without one task holding a group, as in ``numbered``."""
    dealt = dealt_in_order(rows, group, *order)
    sums = dealt.groupBy(group, "__part").agg(F.sum(weight).alias("__n"))
    before = before_parts(sums, group, __before="__n").select(group, "__part", "__before")
    inside = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return dealt.join(before, [group, "__part"]).withColumn(name, F.col("__before") + own).drop("__part", "__before")


def numbered(rows: DataFrame, group: str, *order: str | Column, name: str = "place") -> DataFrame:
    """Number the rows of each group from 0 in a total order, without one task holding a group.

    Each partition of a range exchange numbers its own rows, and the counts of
    the partitions before it (one row a partition and group) are added.
    ``group`` is not null.
    """
    dealt = dealt_in_order(rows, group, *order)
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = before_parts(counts, group, __before="__n").select(group, "__part", "__before")
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    return dealt.join(before, [group, "__part"]).withColumn(name, F.col("__before") + own).drop("__part", "__before")


def owed(rows: DataFrame, group: str, owes: Column, pays: Column, *order: str | Column, name: str = "paid") -> DataFrame:
    """Walk each group in order: a row that ``owes`` adds one to the debt, a row that ``pays`` settles one if there is any.

    ``name`` tells which rows settle one. The debt after a row is the running sum
    of what was owed less what could have been paid, above the lowest it has been;
    sums and lows are taken inside the partitions of a range exchange, and those
    of the partitions before (one row each) are added. So no task walks a group.
    """
    dealt = dealt_in_order(rows.withColumns({"__owes": owes.cast("int"), "__pays": pays.cast("int")}), group, *order)
    inside = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("__owes") - F.col("__pays")
    walked = dealt.withColumn("__sum", F.sum(step).over(inside)).withColumn("__low", F.min("__sum").over(inside))
    parts = walked.groupBy(group, "__part").agg(F.sum(step).alias("__step"), F.min("__sum").alias("__least"))
    parts = before_parts(parts, group, __base="__step")
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "__part", "__base", F.coalesce(F.min(F.col("__least") + F.col("__base")).over(earlier), F.lit(0)).alias("__floor"))
    met = walked.join(parts, [group, "__part"])
    # The lowest so far, the start of the walk included, before this row: what it lowers further was paid without debt.
    before_low = F.coalesce(F.lag("__low").over(Window.partitionBy(group, "__part").orderBy(*order)) + F.col("__base"), F.lit(0))
    lowest = F.least(F.lit(0), F.col("__floor"), before_low)
    debt = F.col("__base") + F.col("__sum") + F.col("__pays") - lowest  # with this row's own, before it pays
    return met.withColumn(name, (F.col("__pays") == 1) & (debt > 0)).drop("__part", "__owes", "__pays", "__sum", "__low", "__base", "__floor")
