"""Algebra of ranked lists: rows ``qid, rank, id, value``, rank from 0 in each list.

Every operation states its order in full, so results never depend on how rows
arrive. Windows are partitioned by ``qid``; a list is as long as its limit, not
as the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists shorter than twice this are never rotated.
SHORT_HALF = 10
#: Longest block that moves to the front.
STRATUM = 100


def _whole(*by: str):
    return Window.partitionBy(*by)


def reranked(rows: DataFrame, *order: Column | str, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``rank`` from 0 by the given order."""
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def to_list(rows: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    """Rows ``qid, id, value`` as ranked lists, the first ``limit`` of each."""
    out = reranked(rows, *order, "id")
    return out.where(F.col("rank") < limit) if limit else out


def union_first(lists: DataFrame) -> DataFrame:
    """Lists numbered by ``list_no`` one after the other; the first occurrence of an id wins."""
    first = Window.partitionBy("qid", "id").orderBy("list_no", "rank")
    kept = lists.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return reranked(kept, "list_no", "rank").select("qid", "rank", "id", "value")


def split_by(lists: DataFrame, ids: DataFrame) -> DataFrame:
    """``kept`` (in ``ids(id)``) and ``backup`` lists, each ranked anew under ``part``."""
    known = ids.select("id").distinct().withColumn("__in", F.lit(True))
    told = lists.join(known, "id", "left").withColumn("part", F.when(F.col("__in"), "kept").otherwise("backup"))
    return reranked(told.withColumnRenamed("rank", "__old"), "__old", by=("qid", "part")).select("qid", "part", "rank", "id", "value")


def invert_values(lists: DataFrame) -> DataFrame:
    """Largest plus smallest plus one less the value; with negatives, three times the smallest is taken off."""
    w = _whole("qid")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return lists.withColumn("value", F.when(low < 0, high - 3 * low + 1 - F.col("value")).otherwise(high + low + 1 - F.col("value")))


def invert_shifted(lists: DataFrame) -> DataFrame:
    """The other inversion in use: the spread plus one less the value."""
    w = _whole("qid")
    return lists.withColumn("value", F.max("value").over(w) - F.min("value").over(w) + 1 - F.col("value"))


def invert_list(rows: DataFrame) -> DataFrame:
    """Of a list sorted by value: the larger end plus ten less each value, over all rows."""
    top = rows.agg(F.max("value").alias("__top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("value", F.col("__top") + 10 - F.col("value")).drop("__top")  # one row


def _stratum(n: Column) -> Column:
    return F.least(F.lit(STRATUM), F.floor(n / 2).cast("int"))


def stratify(lists: DataFrame, skew: float) -> DataFrame:
    """A block of up to STRATUM rows from place ``skew * n`` moves to the front; short lists stay."""
    while skew > 1:
        skew /= 2
    n = F.count("*").over(_whole("qid"))
    start, old = F.floor(F.col("__n") * skew).cast("int"), F.col("__old")
    end = F.least(start + _stratum(F.col("__n")), F.col("__n"))
    moved = F.when((F.floor(F.col("__n") / 2) >= SHORT_HALF) & (old >= start) & (old < end), 0).otherwise(1)
    rows = lists.withColumnRenamed("rank", "__old").withColumn("__n", n)
    return reranked(rows.withColumn("__moved", moved), "__moved", "__old").select("qid", "rank", "id", "value")


def reverse(lists: DataFrame, skew: float | None = None) -> DataFrame:
    """From the end to the front, values inverted.

    With ``skew`` a block of up to STRATUM rows that ends at place ``skew * n``
    comes first, then what lies after it, then what lies before it.
    """
    rows = lists.withColumnRenamed("rank", "__old").withColumn("__n", F.count("*").over(_whole("qid")))
    old = F.col("__old")
    if skew is None:
        part = F.lit(0)
    else:
        place = F.floor(F.col("__n") * skew).cast("int")
        start = F.when(place == F.col("__n"), 0).otherwise(place)
        block = (old <= start) & (old > start - _stratum(F.col("__n")))
        part = F.when(F.floor(F.col("__n") / 2) < SHORT_HALF, 0).when(block, 0).when(old > start, 1).otherwise(2)
    turned = reranked(rows.withColumn("__part", part), "__part", F.desc("__old")).select("qid", "rank", "id", "value")
    w = _whole("qid")
    return turned.withColumn("value", F.max("value").over(w) - F.min("value").over(w) + 1 - F.col("value"))


def alternate(lists: DataFrame) -> DataFrame:
    """Lists numbered by ``list_no`` taken turn by turn: by rank, then list; the first occurrence of an id wins."""
    first = Window.partitionBy("qid", "id").orderBy("rank", "list_no")
    kept = lists.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return reranked(kept.withColumnRenamed("rank", "__old"), "__old", "list_no").select("qid", "rank", "id", "value")


def round_robin(lists: DataFrame, most: int = 200) -> DataFrame:
    """Turn by turn, at most ``most + 1`` rows; values count down from twice the total length."""
    total = lists.groupBy("qid").agg((F.count("*") * 2).alias("__total"))
    merged = alternate(lists).where(F.col("rank") <= most)
    return merged.join(total, "qid").select("qid", "rank", "id", (F.col("__total") - F.col("rank")).alias("value"))


def centre_out(lists: DataFrame, target: int, wrap: bool = False) -> DataFrame:
    """By distance from rank ``target``, the lower rank first; with ``wrap`` around the ends."""
    n = F.count("*").over(_whole("qid"))
    old = F.col("__old")
    gap = F.abs(old - target)
    rows = lists.withColumnRenamed("rank", "__old").withColumn("__n", n)
    if wrap:
        gap = F.least(F.pmod(old - target, F.col("__n")), F.pmod(target - old, F.col("__n")))
        below = F.pmod(target - old, F.col("__n")) == gap
        return reranked(rows.withColumn("__gap", gap).withColumn("__side", F.when(below, 0).otherwise(1)), "__gap", "__side", "__old").select("qid", "rank", "id", "value")
    return reranked(rows.withColumn("__gap", gap), "__gap", "__old").select("qid", "rank", "id", "value")


def weighted_pick(lists: DataFrame, draw: float, limit: int | None = None) -> DataFrame:
    """The row in whose stretch of the running weight the draw (0 to 1) falls, weights being the values."""
    rows = lists.where(F.col("rank") < limit) if limit else lists
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("__end", F.sum("value").over(run)).withColumn("__all", F.sum("value").over(_whole("qid")))
    goal = F.col("__all") * draw
    return told.where((F.col("__end") > goal) & (F.col("__end") - F.col("value") <= goal)).select("qid", "rank", "id", "value")


def mask_by_histogram(lists: DataFrame, histogram: list[int]) -> DataFrame:
    """Weights from a histogram laid along the list; rows on an empty bin go."""
    n = F.count("*").over(_whole("qid"))
    bins = F.array(*[F.lit(h).cast("long") for h in histogram])
    rows = lists.withColumn("__n", n)
    told = rows.withColumn("weight", F.get(bins, F.floor(F.col("rank") * (F.lit(float(len(histogram))) / F.col("__n"))).cast("int")))
    return reranked(told.where("weight >= 1").withColumnRenamed("rank", "__old"), "__old").select("qid", "rank", "id", F.col("weight").alias("value"))


def combo(target: DataFrame, lists: DataFrame, best_target: int = 200, best: int = 800) -> DataFrame:
    """The best of one list that are among the best of another, under ``part`` kept, and the others as backup; both inverted."""
    wanted = target.where(F.col("rank") < best_target).select("qid", "id").distinct().withColumn("__in", F.lit(True))
    told = lists.where(F.col("rank") < best).join(wanted, ["qid", "id"], "left").withColumn("part", F.when(F.col("__in"), "kept").otherwise("backup"))
    out = reranked(told.withColumnRenamed("rank", "__old"), "__old", by=("qid", "part"))
    w = _whole("qid", "part")
    return out.withColumn("value", F.max("value").over(w) - F.min("value").over(w) + 1 - F.col("value")).select("qid", "part", "rank", "id", "value")


def vote_merge(lists: DataFrame, sweep: int) -> DataFrame:
    """Ids by the number of lists that have them among their first ``sweep``, then turn by turn.

    If all ids got equally many votes, lists are swept once more at double depth.
    """
    def votes(depth: int) -> DataFrame:
        return lists.where(F.col("rank") < depth).groupBy("qid", "id").agg(F.count("*").alias("votes"), F.min(F.struct("rank", "list_no")).alias("place"))

    once, twice = votes(sweep), votes(2 * sweep)
    even = once.groupBy("qid").agg((F.min("votes") == F.max("votes")).alias("__even"))
    told = once.join(even, "qid").where("not __even").drop("__even").unionByName(twice.join(even, "qid").where("__even").drop("__even"))
    ranked = reranked(told, F.desc("votes"), "place.rank", "place.list_no")
    return ranked.select("qid", "rank", "id", F.col("votes").alias("value"))


def priority(lists: DataFrame, *flags: str) -> DataFrame:
    """Rows with the first flag, then those with the second only, and so on; rows with none go."""
    level = F.coalesce(*[F.when(F.col(f), F.lit(i)) for i, f in enumerate(flags)])
    told = lists.withColumn("__level", level).where("__level is not null").withColumnRenamed("rank", "__old")
    return reranked(told, "__level", "__old").select("qid", "rank", "id", "value")
