"""All-pairs vector metrics and exact neighbours by matrix products over pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.vectors import POINCARE_FLOOR

from . import tiles

def pair_metrics(items: DataFrame, block_items: int | None = None) -> DataFrame:
    """``id, sequence, orient, vec, vec_l, vec_r`` -> all pairs of an orientation, ``seq1 < seq2``.

    Gives ``cosine`` (0/0: 1, x/0: 0), ``distance``, and both directional scores
    ``d012, d021``. Items stream past blocks of them (``tiles``), and pairs leave a
    task a tile's piece at a time, so neither a task nor what is shuffled grows
    with the pairs. Vectors hold no nulls and have one length.
    """
    def choose(a, b, first):
        dot, na, nb = a["vec"] @ b["vec"].T, (a["vec"] * a["vec"]).sum(1), (b["vec"] * b["vec"]).sum(1)

        def cosine(i, j, forward):
            up, bottom = dot[i, j], np.sqrt(na)[i] * np.sqrt(nb)[j]
            return np.divide(up, bottom, out=np.where(up == 0, 1.0, 0.0), where=bottom != 0)

        return None, _scores(a, b) | {"cosine": cosine, "distance": lambda i, j, forward: np.sqrt(np.maximum(0, na[i] + nb[j] - 2 * dot[i, j]))}

    return tiles.chosen_pairs(items.select("id", "orient", "sequence", "vec", "vec_l", "vec_r"), "orient", "sequence", choose, f"{SCORES}, cosine double, distance double", block_items)


def pair_scores(items: DataFrame) -> DataFrame:
    """``id1, id2, orient, seq1, seq2, d012, d021`` of all pairs, as ``pair_metrics`` gives them."""
    return tiles.chosen_pairs(items.select("id", "orient", "sequence", "vec_l", "vec_r"), "orient", "sequence", lambda a, b, first: (None, _scores(a, b)), SCORES)


SCORES = "orient string, seq1 int, seq2 int, d012 long, d021 long"


def _scores(a: tiles.Side, b: tiles.Side) -> dict:
    ab, ba = tiles.score_of(a["vec_l"], b["vec_r"]), tiles.score_of(a["vec_r"], b["vec_l"])
    sa, sb = a["sequence"], b["sequence"]
    return {
        "orient": lambda i, j, forward: pa.repeat(a["__group"][0], len(i)),
        "seq1": lambda i, j, forward: np.where(forward, sa[i], sb[j]), "seq2": lambda i, j, forward: np.where(forward, sb[j], sa[i]),
        "d012": lambda i, j, forward: np.where(forward, ab[i, j], ba[i, j]).astype("int64"), "d021": lambda i, j, forward: np.where(forward, ba[i, j], ab[i, j]).astype("int64"),
    }


#: Rows of either side that meet in one group of ``nearest``.
BLOCK_ROWS = 2048


def _distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Every row of ``a`` against every row of ``b``, with the conventions of ``functions.vectors``."""
    dot, na, nb = a @ b.T, (a * a).sum(1)[:, None], (b * b).sum(1)
    if metric == "cosine_distance":
        bottom = np.sqrt(na) * np.sqrt(nb)
        return 1 - np.divide(dot, bottom, out=np.where(dot == 0, 1.0, 0.0), where=bottom != 0)
    square = np.maximum(0, na + nb - 2 * dot)
    if metric == "cartes":
        return np.sqrt(square)
    if metric == "poinca":
        x = np.maximum(1.0, 1 + 2 * square / (np.maximum(POINCARE_FLOOR, 1 - na) * np.maximum(POINCARE_FLOOR, 1 - nb)))
        return np.log(x + np.sqrt(x * x - 1))
    raise ValueError(f"no block kernel for {metric}")


def near_scores(metric: str, vector: str = "vec", places: int = 6) -> Callable[[tiles.Side, tiles.Side], np.ndarray]:
    """Rounded distances for ``tiles.best``."""
    return lambda a, b: _distances(metric, a[vector], b[vector]).round(places) + 0.0


def nearest(left: DataFrame, right: DataFrame, k: int, metric: str = "cosine_distance", group: str | None = None, vector: str = "vec", places: int = 6) -> DataFrame:
    """``id, rank, match_id, distance``: for each row of ``left(id, vec)`` its ``k`` nearest of ``right(id, vec)``, never itself.

    With ``group`` only rows of one group meet. Exact; distances are rounded to
    ``places`` and ties go to the smaller id. Both sides are dealt into blocks of
    about BLOCK_ROWS, and each pair of blocks returns k rows for each of its left
    rows; so a group never grows with the tables, and Spark cuts the candidates
    once more before the last shuffle. Vectors hold no nulls and have one length.
    """
    sizes = [max(1, -(-side.count() // BLOCK_ROWS)) for side in (left, right)]
    by = [F.col(group).alias("g") if group else F.lit(0).alias("g")]

    def dealt(side: DataFrame, own: str, other: str, n: int, copies: int) -> DataFrame:
        return side.select(*by, F.col("id").alias("id"), F.col(vector).alias("vec"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    a, b = dealt(left, "p", "q", sizes[0], sizes[1]), dealt(right, "q", "p", sizes[1], sizes[0])

    empty = pd.DataFrame({"id": pd.Series([], dtype=object), "match_id": pd.Series([], dtype=object), "distance": pd.Series([], dtype=float)})

    def run(one, two):
        if not len(one) or not len(two):
            return empty
        two = two.sort_values("id", ignore_index=True)
        ids, match = one["id"].to_numpy(), two["id"].to_numpy()
        far = _distances(metric, np.stack(one["vec"].to_list()).astype(float), np.stack(two["vec"].to_list()).astype(float)).round(places) + 0.0
        far[ids[:, None] == match] = np.inf
        edge = np.partition(far, min(k, len(match)) - 1, axis=1)[:, min(k, len(match)) - 1]
        i, j = np.nonzero((far <= edge[:, None]) & np.isfinite(far))
        order = np.lexsort((j, far[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        if not len(i):
            return empty
        return pd.DataFrame({"id": ids[i], "match_id": match[j], "distance": far[i, j]})

    kind = left.schema["id"].dataType.simpleString()
    found = a.groupBy("g", "p", "q").cogroup(b.groupBy("g", "p", "q")).applyInPandas(run, f"id {kind}, match_id {kind}, distance double")
    best = Window.partitionBy("id").orderBy("distance", "match_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "match_id", "distance")
