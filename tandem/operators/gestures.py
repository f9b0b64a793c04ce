"""Searches by strokes drawn over two pictures, and the shape of strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import vectors as V

from . import blocks, tiles
from .shared import checkpointed

#: Fixed values. Directions in degrees (0 to the right, down positive): a stroke within FLAT of either horizontal is
#: flat; others push by BASE plus SLOPE for each degree from START.
FLAT, BASE = 10.0, 2.0
PUSHES = {"lr/down": (10.0, 90.0, 10.0, -0.01), "rl/down": (90.0, 170.0, 180.0, 0.01), "lr/up": (-90.0, -10.0, -20.0, -0.05), "rl/up": (-170.0, -90.0, -90.0, 0.05)}
#: Neighbours looked up at least, as a power of two.
LOOKED_UP = 6
#: Fixed value: components of a projected vector are halved until they are at most this.
CEILING = 0.2


def pushes(angle: Column, distance: Column, centers: Column, dots: Column, dots1: Column, dots2: Column) -> tuple[Column, Column, Column]:
    """The kind of a stroke, and how far it pushes each side.

    A flat stroke shorter than the distance of the two centres draws both sides
    inwards, each by its share of the dots; the shorter, the more.
    """
    flat = (F.abs(angle) < FLAT) | (F.abs(angle) > 180 - FLAT)
    inward = flat & (distance < centers)
    kind, push = F.when(inward, "in"), F.lit(BASE)
    for name, (low, high, start, slope) in PUSHES.items():
        here = (angle > low) & (angle < high)
        kind = kind.when(here, name)
        push = F.when(here, BASE + slope * (angle - start)).otherwise(push)
    short = 1 - distance / centers
    share = F.when(short < 1, -short).otherwise(short)
    return kind.otherwise("flat"), *[F.when(inward, n / dots * share).otherwise(push) for n in (dots1, dots2)]


def folded(vector: Column, ceiling: float = CEILING) -> Column:
    """Components without their sign, halved until at most ``ceiling``; so a projection stays where the vectors lie."""
    def halved(x: Column) -> Column:
        over = F.abs(x) / F.lit(ceiling)
        return F.when(over > 1, F.abs(x) * F.pow(F.lit(0.5), F.ceil(F.log2(over)))).otherwise(F.abs(x))

    return F.transform(vector, halved)


def projected(start: Column, end: Column, push: Column) -> Column:
    """Beyond ``end`` as seen from ``start``: the more push, the further."""
    return folded(F.zip_with(start, end, lambda x, y: push * y - x))


def stroke_search(strokes: DataFrame, items: DataFrame, seen: DataFrame, k: int = 20, vector: str = "vec") -> DataFrame:
    """``ask, side, kind, rank, id, distance``: for each stroke the first picture and the ``k`` for the second, no id twice.

    ``strokes`` has ``ask, id1, id2, from_side, to_side`` (1 or 2), ``angle,
    distance, centers, dots, dots1, dots2``; ``items`` has ``id, orient`` and the
    vector, ``seen`` has ``ask, id``. An inward stroke moves both vectors towards
    each other and takes the nearest of the one and the ``k`` nearest of the
    other. Any other stroke is projected from its first picture beyond its second;
    the nearest there is the first answer, and is projected from the second
    picture in turn. Strokes to the right go by cosine, others by Poincare
    distance. A stroke that starts and ends on one side, or lacks a picture,
    gives no row. All strokes of a direction are compared at once, tile by tile.
    """
    kind, one, two = pushes(*[F.col(c) for c in ("angle", "distance", "centers", "dots", "dots1", "dots2")])
    told = strokes.where("from_side <> to_side").select("ask", "id1", "id2", (F.col("from_side") == 1).alias("right"), kind.alias("kind"), one.alias("push1"), two.alias("push2"))
    for n in (1, 2):
        told = told.join(items.select(F.col("id").alias(f"id{n}"), F.col(vector).alias(f"v{n}"), *([F.col("orient")] if n == 1 else [])), f"id{n}")
    inward = F.col("kind") == "in"
    begin, end = (F.when(F.col("right") | inward, F.col(a)).otherwise(F.col(b)) for a, b in (("v1", "v2"), ("v2", "v1")))
    told = told.withColumns({"begin": begin, "end": end})
    told = told.withColumn("first", F.when(inward, folded(V.extrapolate(F.col("v1"), F.col("v2"), F.col("push1")))).otherwise(projected(F.col("begin"), F.col("end"), F.col("push1"))))
    told = checkpointed(told)
    met = _open_neighbours(told, "first", items, seen, 1, vector)
    picked = told.join(met.select("ask", F.col("id").alias("pick"), F.col("distance").alias("pick_distance")), "ask").join(items.select(F.col("id").alias("pick"), F.col(vector).alias("pick_vec")), "pick")
    second = F.when(inward, folded(V.extrapolate(F.col("v2"), F.col("v1"), F.col("push2")))).otherwise(projected(F.col("end"), F.col("pick_vec"), F.col("push2")))
    picked = checkpointed(picked.withColumn("second", second))
    others = _open_neighbours(picked, "second", items, seen.select("ask", "id").unionByName(picked.select("ask", F.col("pick").alias("id"))), k, vector)
    firsts = picked.select("ask", F.when(F.col("right") | inward, 1).otherwise(2).alias("side"), "kind", F.lit(1).alias("rank"), F.col("pick").alias("id"), F.col("pick_distance").alias("distance"))
    seconds = others.join(told.select("ask", "kind", F.when(F.col("right") | inward, 2).otherwise(1).alias("side")), "ask").select("ask", "side", "kind", F.col("rank").cast("int").alias("rank"), "id", "distance")
    return firsts.unionByName(seconds)


def _open_neighbours(asks: DataFrame, column: str, items: DataFrame, seen: DataFrame, k: int, vector: str) -> DataFrame:
    """``ask, rank, id, distance`` of the ``k`` nearest of the same orientation that the ask has not seen.

    As many more are looked up as an ask has seen, so that what is left is
    whole; asks are looked up together unless some have seen far more.
    """
    counts = seen.groupBy("ask").agg(F.count_distinct("id").alias("n"))
    need = F.greatest(F.lit(LOOKED_UP), F.ceil(F.log2(F.coalesce("n", F.lit(0)) + k)).cast("int"))
    sized = checkpointed(asks.select("ask", "orient", "right", column).join(counts, "ask", "left").withColumn("need", need))
    found = None
    for need, right in sorted(map(tuple, sized.select("need", "right").distinct().collect())):  # a logarithm of row counts, and a direction: few
        own = sized.where((F.col("need") == need) & (F.col("right") == right)).select(F.concat(F.lit("\n"), F.col("ask").cast("string")).alias("id"), "orient", F.col(column).alias(vector))
        # An ask is none of the items: keys of either sign.
        sides = [rows.withColumn("key", sign * (F.pmod(F.xxhash64("id"), F.lit(1 << 62)) + 1)) for rows, sign in ((own, 1), (items.select("id", "orient", vector), -1))]
        near = tiles.best(*sides, "orient", "key", 1 << need, blocks.near_scores("cosine_distance" if right else "poinca", vector), descending=False, kind="double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return asks.where("false").select("ask", F.lit(1).alias("rank"), F.lit("").alias("id"), F.lit(0.0).alias("distance"))
    flat = found.select(F.substring("id", 2, 1 << 30).cast(asks.schema["ask"].dataType).alias("ask"), F.col("other").alias("id"), F.col("value").alias("distance")).join(seen.select("ask", "id"), ["ask", "id"], "left_anti")
    w = Window.partitionBy("ask").orderBy("distance", "id")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("ask", "rank", "id", "distance")


def stroke_shapes(dots: DataFrame) -> DataFrame:
    """``stroke, dots, length, reach, straightness, turning, turns, closure, elongation`` of ``stroke, n, x, y`` in order of ``n``.

    ``length`` is that of the path and ``reach`` that from the first dot to the
    last; ``turning`` adds the signed angles between steps in degrees, ``turns``
    their sizes; ``closure`` is 1 for a closed path; ``elongation`` is the ratio
    of the box's sides. Dots that do not move count, but do not turn. A stroke of
    one dot has length 0 and null ratios. Window sums, no row of many dots.
    """
    along = Window.partitionBy("stroke").orderBy("n")
    steps = dots.select("stroke", "n", "x", "y", (F.col("x") - F.lag("x").over(along)).alias("dx"), (F.col("y") - F.lag("y").over(along)).alias("dy"))
    moved = F.coalesce((F.col("dx") != 0) | (F.col("dy") != 0), F.lit(False))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(moved, F.col(c)), ignorenulls=True).over(before) for c in ("dx", "dy")]
    turned = steps.withColumns({"px": last[0], "py": last[1]})
    turn = F.when(moved & F.col("px").isNotNull(), F.degrees(F.atan2(F.col("px") * F.col("dy") - F.col("py") * F.col("dx"), F.col("px") * F.col("dx") + F.col("py") * F.col("dy"))))
    told = turned.withColumns({"turn": turn, "step": F.coalesce(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(0.0))})
    ends = told.groupBy("stroke").agg(
        F.count("*").alias("dots"), F.sum("step").alias("length"), F.min(F.struct("n", "x", "y")).alias("a"), F.max(F.struct("n", "x", "y")).alias("b"),
        F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turning"), F.coalesce(F.sum(F.abs("turn")), F.lit(0.0)).alias("turns"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
    )
    reach = F.sqrt((F.col("b.x") - F.col("a.x")) * (F.col("b.x") - F.col("a.x")) + (F.col("b.y") - F.col("a.y")) * (F.col("b.y") - F.col("a.y")))
    told = ends.withColumn("reach", reach).withColumn("straightness", F.when(F.col("length") > 0, F.col("reach") / F.col("length")))
    elongation = F.when(F.least("w", "h") > 0, F.greatest("w", "h") / F.least("w", "h"))
    return told.select("stroke", "dots", "length", "reach", "straightness", "turning", "turns", (1 - F.col("straightness")).alias("closure"), elongation.alias("elongation"))
