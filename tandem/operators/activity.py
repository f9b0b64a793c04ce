"""Analytics of interaction logs: ``id, create_time, browser_id, rating, user_time`` and more."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered

#: Dwell ratio thresholds, with the colour columns for longer and for shorter dwells.
RATIO_LADDER = (
    (0.8, "b9", "b2"), (0.7, "b8", "b2"), (0.6, "b8", "b4"), (0.5, "b7", "b4"), (0.4, "b7", "b6"), (0.35, "b9", "b7"),
    (0.3, "b6", "b8"), (0.26, "b4", "b9"), (0.24, "b9", "b9"), (0.22, "b9", "b4"), (0.2, "b8", "b4"), (0.18, "b4", "b4"),
    (0.16, "b7", "b4"), (0.1, "b5", "b4"),
)
RATIO_ELSE = ("b5", "b0")
HISTORY = 10


def in_time(by: str = "browser_id"):
    """A user's rows in order; a user's rows are the unit that a window sorts."""
    return Window.partitionBy(by).orderBy("create_time", "id")


def micros(column: Column | str) -> Column:
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def last_n(log: DataFrame, n: int = HISTORY, by: str = "browser_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("create_time"), F.desc("id"))
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def last_value(log: DataFrame, column: str, by: str = "browser_id") -> DataFrame:
    """The latest value of a column per key, as one aggregate without a sort."""
    return log.groupBy(by).agg(F.max(F.struct("create_time", "id", column)).alias("m")).select(by, f"m.{column}")


def gaps(log: DataFrame, gap_millis: int = 20_000, by: str = "browser_id") -> DataFrame:
    """Per user: rows, first and last time, longest gap and the number of gaps longer than ``gap_millis``."""
    gap = (micros("create_time") - micros(F.lag("create_time").over(in_time(by)))) / 1000
    return log.withColumn("gap", F.floor(gap)).groupBy(by).agg(
        F.count("*").alias("n"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"),
        F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("longest_gap"), F.count_if(F.col("gap") > gap_millis).alias("breaks"),
    )


def sessions(log: DataFrame, gap_millis: int = 20_000, by: str = "browser_id") -> DataFrame:
    """Runs of rows without a gap longer than ``gap_millis``: ``session`` from 0, its bounds and size."""
    gap = micros("create_time") - micros(F.lag("create_time").over(in_time(by)))
    new = F.when(gap > gap_millis * 1000, 1).otherwise(0)
    told = log.withColumn("__new", new).withColumn("session", F.sum("__new").over(in_time(by).rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy(by, "session").agg(F.min("create_time").alias("started"), F.max("create_time").alias("ended"), F.count("*").alias("n"))


def speeding_up(log: DataFrame, compare: int = 4, rating: int = 3) -> DataFrame:
    """Per user whether the last ``compare`` rows all have ``rating`` and times that never grow towards now."""
    recent = last_n(log, compare)
    lists = recent.groupBy("browser_id").agg(F.array_sort(F.collect_list(F.struct("rn", "user_time", "rating"))).alias("h"))
    steps = F.expr("forall(sequence(0, size(h) - 2), i -> get(h, i).user_time <= get(h, i + 1).user_time)")
    flag = F.when(F.size("h") < compare, False).otherwise(F.forall("h", lambda x: x["rating"] == rating) & steps)
    return lists.select("browser_id", flag.alias("speeding_up"))


def dwell_class(log: DataFrame, history: int = HISTORY) -> DataFrame:
    """Each row's time against the whole average of the ``history`` rows up to it."""
    w = in_time().rowsBetween(1 - history, 0)
    value, mean = F.col("user_time"), F.col("mean_time")
    told = log.withColumn("mean_time", F.floor(F.avg("user_time").over(w)).cast("int"))
    return told.select("id", "browser_id", "user_time", "mean_time", _dwell(value, mean).alias("dwell"))


def _dwell(value: Column, mean: Column) -> Column:
    return (
        F.when(value > mean * 2, "longest").when(value > F.floor(mean * 1.5), "longer").when(value > F.floor(mean * 1.25), "long")
        .when(value < F.floor(mean * 0.5), "shorter").when(value < F.floor(mean * 0.75), "short").otherwise("centre")
    )


#: What a dwell class does to the skew: raises it to a power, or a base to it.
SKEW_POWERS, SKEW_BASES = {"long": 2.0, "longer": 3.0, "longest": 4.0}, {"short": 2.0, "shorter": 3.0}


def skew(log: DataFrame, history: int = HISTORY) -> DataFrame:
    """``id, browser_id, skew``: how unusual each row's time is among the ``history`` rows up to it, stirred into [0, 1).

    The distance from the whole mean over the largest such distance (0 counts as
    2) loses its whole part, gains 1, and is raised by the row's dwell class; what
    is behind the point counts, taken from 1 where the row took longer than the
    one before.
    """
    w = in_time().rowsBetween(1 - history, 0)
    value, mean = F.col("user_time"), F.col("mean_time")
    told = log.withColumns({"mean_time": F.floor(F.avg("user_time").over(w)).cast("int"), "low": F.min("user_time").over(w), "high": F.max("user_time").over(w), "before": F.lag("user_time").over(in_time())})
    widest = F.greatest(mean - F.col("low"), F.col("high") - mean)
    ratio = F.abs(mean - value) / F.when(widest == 0, 2).otherwise(widest)
    ratio = ratio - F.floor(ratio) + 1.0
    stirred = F.when(value > 0, F.exp(ratio)).otherwise(ratio)
    for name, base in SKEW_BASES.items():
        stirred = F.when(F.col("dwell") == name, F.pow(F.lit(base), ratio)).otherwise(stirred)
    for name, power in SKEW_POWERS.items():
        stirred = F.when(F.col("dwell") == name, F.pow(ratio, F.lit(power))).otherwise(stirred)
    point = stirred - F.floor(stirred)
    longer = F.coalesce(value > F.col("before"), F.lit(False))
    return told.withColumn("dwell", _dwell(value, mean)).select("id", "browser_id", F.round(F.when(longer, 1.0 - point).otherwise(point), 6).alias("skew"))


#: Pointer speed, distance without drawing, and distance after an equal rating, above which a hand is restless; the rating it is judged by.
RESTLESS_SPEED, RESTLESS_DISTANCE, RESTLESS_AGAIN, OUTSIDE_RATING = 300, 200, 25, 4


def restless(log: DataFrame) -> DataFrame:
    """``id, browser_id, restless``, from ``rating, mouse_speed, mouse_dist, dot_count, pixels_outside``: the first rule that holds, or null."""
    same = F.col("rating") == F.lag("rating").over(in_time())
    rule = (
        F.when(F.col("mouse_speed") > RESTLESS_SPEED, "speed").when((F.col("mouse_dist") > RESTLESS_DISTANCE) & (F.col("dot_count") == 0), "distance")
        .when((F.col("rating") == OUTSIDE_RATING) & (F.col("pixels_outside") > 0), "outside").when(same & (F.col("mouse_dist") > RESTLESS_AGAIN), "again")
    )
    return log.select("id", "browser_id", rule.alias("restless"))


def ratio_columns(log: DataFrame, history: int = HISTORY) -> DataFrame:
    """The last row's distance from the recent average over the largest such distance, and the colour column it leads to.

    ``skew`` is the same ratio, 0 where all times are equal.
    """
    recent = last_n(log, history)
    told = recent.groupBy("browser_id").agg(F.max_by("user_time", F.struct(-F.col("rn"))).alias("last"), F.avg("user_time").alias("mean"), F.min("user_time").alias("low"), F.max("user_time").alias("high"))
    widest = F.greatest(F.col("mean") - F.col("low"), F.col("high") - F.col("mean"))
    told = told.withColumn("ratio", F.when(widest == 0, F.lit(0.0)).otherwise(F.round(F.abs(F.col("last") - F.col("mean")) / widest, 6))).withColumn("longer", F.col("last") > F.col("mean"))
    column = None
    for least, longer, shorter in RATIO_LADDER:
        pick = F.when(F.col("longer"), longer).otherwise(shorter)
        column = F.when(F.col("ratio") > least, pick) if column is None else column.when(F.col("ratio") > least, pick)
    column = column.otherwise(F.when(F.col("longer"), RATIO_ELSE[0]).otherwise(RATIO_ELSE[1]))
    return told.select("browser_id", "last", "ratio", "longer", column.alias("colour_column"))


def sliding(log: DataFrame, sizes: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Running means of the last rows, one column a size."""
    means = {f"mean_{n}": F.round(F.avg("user_time").over(in_time().rowsBetween(1 - n, 0)), 6) for n in sizes}
    return log.withColumns(means).select("id", "browser_id", *means)


def same_method(log: DataFrame, n: int = 5) -> DataFrame:
    """Whether the last ``n`` rows up to each one were all chosen by one method."""
    w = in_time().rowsBetween(1 - n, 0)
    full = F.count("*").over(w) == n
    return log.select("id", "browser_id", (full & (F.min("sel_method").over(w) == F.max("sel_method").over(w))).alias("same_method"))


def rating_histogram(log: DataFrame, buckets: int = 20) -> DataFrame:
    """Rows a user and rating; a null, negative or too large rating counts as 0."""
    valid = F.col("rating").between(0, buckets - 1)
    return log.groupBy("browser_id", F.when(valid, F.col("rating")).otherwise(0).alias("bucket")).agg(F.count("*").alias("n"))


def duration_buckets(log: DataFrame, column: str = "user_time") -> DataFrame:
    """Rows by fixed bounds of duration, with sum and whole average."""
    v = F.col(column)
    kind = F.when(v > 190, "longer").when(v > 170, "long").when(v < 130, "shorter").when(v < 150, "short").otherwise("centre")
    return log.groupBy(kind.alias("bucket")).agg(F.count("*").alias("n"), F.sum(v.cast("long")).alias("total"), F.floor(F.sum(v) / F.count("*")).alias("average"))


#: Values of a series in a block, and values of short series that one group takes up.
SERIES_BLOCK, SERIES_ROWS = 2048, 100_000


def _curve_lengths(pdf: pd.DataFrame) -> pd.DataFrame:
    """``browser_id, k, length``: what the pairs of one block with another add to a series' length at each step ``k``."""
    out = []
    for (user, n), own in pdf.groupby(["browser_id", "n"], sort=False):
        left, right = (own[own["side"] == side].sort_values("place") for side in (0, 1))
        if not len(left) or not len(right):
            continue
        p, v, w = left["place"].to_numpy(), left["v"].to_numpy(), right["v"].to_numpy()
        gap = int(right["place"].iloc[0] - p[0])  # places of a block follow one another
        steps = np.arange(max(1, gap - len(p) + 1), min(n // 3, gap + len(w) - 1) + 1)
        sums = np.zeros(len(steps))
        for at, k in enumerate(steps):
            # Left place x meets right place x + k - gap.
            begin, end = max(0, gap - k), min(len(p), len(w) + gap - k)
            each = (n - 1) / ((n - 1 - p[begin:end] % k) // k) / k / k / k
            sums[at] = (np.abs(w[begin + k - gap : end + k - gap] - v[begin:end]) * each).sum()
        out.append(pd.DataFrame({"browser_id": user, "k": steps, "length": sums}))
    return pd.concat(out) if out else pd.DataFrame({"browser_id": pd.Series([], dtype="int64"), "k": pd.Series([], dtype="int64"), "length": pd.Series([], dtype=float)})


def higuchi(log: DataFrame, column: str = "user_time", least: int = 10, block: int = SERIES_BLOCK) -> DataFrame:
    """Fractal dimension of each user's series: minus the slope of log curve length over log step, and its r squared.

    For each step k the mean over the k starts of the normalised length. Series
    of fewer than ``least`` values get 0. The work is the square of a series'
    length, so a series is cut into blocks, and pairs of blocks are measured
    apart: no row, group or window holds a series. Short ones share a group.
    """
    values = log.select("browser_id", "create_time", "id", F.col(column).cast("double").alias("v"))
    sizes = values.groupBy("browser_id").agg(F.count("*").alias("n"))
    placed = numbered(values.where("browser_id is not null"), "browser_id", "create_time", "id").join(sizes.where(F.col("n") >= least), "browser_id")
    groups = max(1, -(-placed.count() // SERIES_ROWS))
    short = F.concat(F.lit("short "), F.pmod(F.xxhash64("browser_id"), F.lit(groups)).cast("string"))
    key = F.when(F.col("n") <= block, short).otherwise(F.col("browser_id").cast("string"))
    own = placed.select("browser_id", "n", "v", F.col("place").cast("long").alias("place"), key.alias("key"), F.expr(f"cast(place div {block} as int)").alias("own"), F.expr(f"cast(n div 3 div {block} + 1 as int)").alias("far"), F.expr(f"cast((n - 1) div {block} as int)").alias("last"))
    lefts = own.select("*", F.lit(0).alias("side"), F.col("own").alias("a"), F.explode(F.expr("sequence(own, least(last, own + far))")).alias("b"))
    rights = own.select("*", F.lit(1).alias("side"), F.explode(F.expr("sequence(greatest(0, own - far), own)")).alias("a"), F.col("own").alias("b"))
    cells = lefts.unionByName(rights).select("key", "a", "b", "browser_id", "n", "place", "v", "side")
    sums = cells.groupBy("key", "a", "b").applyInPandas(_curve_lengths, "browser_id long, k long, length double").groupBy("browser_id", "k").agg(F.sum("length").alias("length"))
    points = sums.select("browser_id", F.log(F.col("k").cast("double")).alias("x"), F.log(F.greatest("length", F.lit(1e-300))).alias("y"))
    fits = points.groupBy("browser_id").agg((-F.regr_slope("y", "x")).alias("dimension"), F.regr_r2("y", "x").alias("r2"))
    return sizes.join(fits, "browser_id", "left").select("browser_id", "n", F.round(F.coalesce("dimension", F.lit(0.0)), 5).alias("dimension"), F.round(F.coalesce("r2", F.lit(0.0)), 5).alias("r2"))


def tumbling_counts(log: DataFrame, width: str = "1 hour") -> DataFrame:
    return log.groupBy("browser_id", F.window("create_time", width).alias("w")).agg(F.count("*").alias("n")).select("browser_id", F.col("w.start").alias("started"), "n")


def by_method(log: DataFrame, word: str, exact: bool = False) -> DataFrame:
    """Rows whose selection method, on either side of its colon, is ``word`` or contains it."""
    sides = [F.element_at(F.split("sel_method", ":"), 1), F.coalesce(F.get(F.split("sel_method", ":"), F.lit(1)), F.lit(""))]
    hit = [(s == word) if exact else s.contains(word) for s in sides]
    return log.where(hit[0] | hit[1])


def percent_seen(views: DataFrame, seen: DataFrame) -> DataFrame:
    """``browser_id, percent`` of the items ``views(id)`` that each browser of ``seen(browser_id, id)`` has seen."""
    size = views.select("id").distinct().agg(F.count("*").alias("size"))
    inside = seen.select("browser_id", "id").distinct().join(views.select("id").distinct(), "id", "left_semi").groupBy("browser_id").agg(F.count("*").alias("n"))
    return inside.crossJoin(F.broadcast(size)).select("browser_id", F.floor(F.col("n") * 100 / F.col("size")).cast("int").alias("percent"))  # one row
