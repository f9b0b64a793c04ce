"""Pairs of items: all pairs, directions, neighbours, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a block, about; two blocks meet under one key.
BLOCK_ITEMS = 2000
#: Blocks at least, so that small tables use all cores too.
LEAST_BLOCKS = 6


def ordered_pairs(items: DataFrame, group: str, order: str, blocks: int | None = None) -> DataFrame:
    """All pairs of a group with ``order`` rising; columns get ``_1`` and ``_2``.

    Items are dealt into blocks, and each pair of blocks of a group is one key
    of an equi-join. The number of blocks follows the largest group, so a key
    never has more than about BLOCK_ITEMS of either side; a row is copied once a
    block.
    """
    if blocks is None:
        largest = items.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        blocks = max(LEAST_BLOCKS, -(-largest // BLOCK_ITEMS))
    own = F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rest = [c for c in items.columns if c != group]
    dealt = items.withColumn("__own", own).withColumn("__other", others)
    dealt = dealt.withColumn("__lo", F.least("__own", "__other")).withColumn("__hi", F.greatest("__own", "__other"))
    left = dealt.select(group, "__lo", "__hi", F.col("__own").alias("__own_1"), *[F.col(c).alias(f"{c}_1") for c in rest])
    right = dealt.select(group, "__lo", "__hi", F.col("__own").alias("__own_2"), *[F.col(c).alias(f"{c}_2") for c in rest])
    met = left.join(right, [group, "__lo", "__hi"]).where(F.col(f"{order}_1") < F.col(f"{order}_2"))
    # Two rows of one block meet under every key of the block; only (own, own) counts for them.
    once = (F.col("__own_1") != F.col("__own_2")) | (F.col("__lo") == F.col("__hi"))
    return met.where(once).drop("__lo", "__hi", "__own_1", "__own_2")


def both_directions(pairs: DataFrame, forward: str = "d012", backward: str = "d021", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, other, value, position``: each canonical pair seen from both ends.

    ``value`` is the score with ``id`` on the left; ``position`` is where
    ``id`` stands in the canonical pair.
    """
    sides = F.explode(
        F.array(
            F.struct(F.col("id1").alias("id"), F.col("id2").alias("other"), F.col(forward).alias("value"), F.lit(1).alias("position")),
            F.struct(F.col("id2").alias("id"), F.col("id1").alias("other"), F.col(backward).alias("value"), F.lit(2).alias("position")),
        )
    )
    return pairs.select(*keep, sides.alias("s")).select(*keep, "s.*")


def neighbours(pairs: DataFrame, item_id: str) -> DataFrame:
    """``other, position`` of every pair that ``item_id`` takes part in; one scan, no join."""
    found = pairs.where((F.col("id1") == item_id) | (F.col("id2") == item_id))
    first = F.col("id1") == item_id
    return found.withColumns({"other": F.when(first, F.col("id2")).otherwise(F.col("id1")), "position": F.when(first, 1).otherwise(2)})


def score_collection(pairs: DataFrame, item_id: str, collection: DataFrame, invert: bool = False) -> DataFrame:
    """``other, value`` of ``item_id`` on the left against the ids of ``collection(id)``; inverted: the largest plus ten, less each."""
    from .ranked import invert_list

    sides = both_directions(pairs.where((F.col("id1") == item_id) | (F.col("id2") == item_id))).where(F.col("id") == item_id)
    found = sides.select(F.col("other"), "value").join(collection.select(F.col("id").alias("other")), "other", "left_semi")
    return invert_list(found) if invert else found


def two_hop_pairs(pairs: DataFrame, first: str, second: str, view: DataFrame | None = None) -> DataFrame:
    """Pairs that touch a neighbour of ``first`` or ``second`` but neither of the two, themselves once.

    The pair itself makes no neighbours. With ``view(id)`` both ends of a pair must be in it.
    """
    anchors = [first, second]
    touching = pairs.where(F.col("id1").isin(anchors) | F.col("id2").isin(anchors))
    touching = touching.where(~(F.col("id1").isin(anchors) & F.col("id2").isin(anchors)))
    near = touching.select(F.when(F.col("id1").isin(anchors), F.col("id2")).otherwise(F.col("id1")).alias("near")).distinct()
    away = pairs.where(~F.col("id1").isin(anchors) & ~F.col("id2").isin(anchors)).select("id1", "id2")
    one = away.join(near.withColumnRenamed("near", "id1"), "id1", "left_semi").select("id1", "id2")
    two = away.join(near.withColumnRenamed("near", "id2"), "id2", "left_semi").select("id1", "id2")
    found = one.unionByName(two).distinct()
    return found if view is None else resolved(found, view)


def bipartite_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with id1 in ``left(id)`` and id2 in ``right(id)``."""
    return pairs.join(left.select(F.col("id").alias("id1")), "id1", "left_semi").join(right.select(F.col("id").alias("id2")), "id2", "left_semi")


def enrich(pairs: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Both ends' columns, as ``<column>_1`` and ``<column>_2``; pairs with a missing or differently oriented end go."""
    one = items.select(F.col("id").alias("id1"), F.col("orient").alias("orient_1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    two = items.select(F.col("id").alias("id2"), F.col("orient").alias("orient_2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return pairs.join(one, "id1").join(two, "id2").where("orient_1 = orient_2").drop("orient_2").withColumnRenamed("orient_1", "orient")


def resolved(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs whose both ends are known ``items(id)``."""
    known = items.select("id").distinct()
    return pairs.join(known.withColumnRenamed("id", "id1"), "id1", "left_semi").join(known.withColumnRenamed("id", "id2"), "id2", "left_semi")


def told_by_existence(pairs: DataFrame, **tables: DataFrame) -> DataFrame:
    """``pairs(id1, id2)`` with one boolean a named table: whether it holds the pair."""
    for name, table in tables.items():
        known = table.select("id1", "id2").distinct().withColumn(name, F.lit(True))
        pairs = pairs.join(known, ["id1", "id2"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return pairs


def both_scores(pairs: DataFrame) -> DataFrame:
    """``id, total, n``: for each item the sum of its scores in both directions, over all its pairs."""
    ends = F.explode(F.array("id1", "id2")).alias("id")
    return pairs.select(ends, (F.col("d012") + F.col("d021")).alias("both")).groupBy("id").agg(F.sum("both").alias("total"), F.count("*").alias("n"))


def degrees(lists: DataFrame) -> DataFrame:
    """``id, degree``: how many edges of neighbour lists ``id, other`` touch each id, from either end."""
    return lists.select(F.explode(F.array("id", "other")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def unseen_flips(seen: DataFrame, approved: DataFrame) -> DataFrame:
    """Seen pairs turned round, where the turned pair is neither approved nor seen."""
    flipped = seen.select(F.col("id2").alias("id1"), F.col("id1").alias("id2")).distinct()
    return flipped.join(approved.select("id1", "id2"), ["id1", "id2"], "left_anti").join(seen.select("id1", "id2"), ["id1", "id2"], "left_anti")


def band_neighbours(pairs: DataFrame, centre: Column | int, half_width: int, outside: bool = False) -> DataFrame:
    """``id, other, value`` of directed scores inside [centre - w, centre + w], or outside it."""
    sides = both_directions(pairs)
    centre = centre if isinstance(centre, Column) else F.lit(centre)
    inside = F.col("value").between(centre - half_width, centre + half_width)
    return sides.where(~inside if outside else inside).select("id", "other", "value")


def time_near(log: DataFrame, asks: DataFrame, millis: int = 2000) -> DataFrame:
    """For ``asks(ask_id, id1, id2, at)`` the log row of that pair created within ``millis``; null if there is none or more.

    An equi-join on the pair with the band as a condition; ``log`` has ``id, id1, id2, create_time``.
    """
    near = log.select("id", "id1", "id2", "create_time").join(asks, ["id1", "id2"], "right")
    gap = F.abs(F.unix_micros(F.col("create_time").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")))
    hit = F.when(gap <= millis * 1000, F.col("id"))
    return near.groupBy("ask_id").agg(F.count(hit).alias("n"), F.max(hit).alias("found")).select("ask_id", F.when(F.col("n") == 1, F.col("found")).alias("found_id"))
