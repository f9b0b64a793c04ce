"""Named views: sets of item ids by a short definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered


def resolve(definition: str, items: DataFrame, words: DataFrame, coder: str = "m") -> DataFrame:
    """``id`` of the items of a view.

    ``all``; ``arch`` and archive numbers; ``kwd`` and words, any of which the
    coder gave the item; ``bad`` and a percentage, the items of lowest ``sum_d0``
    of each orientation; ``dummy``, none. Anything else is an error.
    """
    kind, *rest = definition.split()
    if kind == "all":
        return items.select("id")
    if kind == "dummy":
        return items.select("id").where("false")
    if kind == "arch":
        return items.where(F.col("archive").isin([int(a) for a in rest])).select("id")
    if kind == "kwd":
        hits = words.where((F.col("coder") == coder) & F.col("word").isin(rest)).select("id")
        return items.select("id").join(hits, "id", "left_semi")
    if kind == "bad" and len(rest) == 1:
        placed = numbered(items.select("id", "orient", "sum_d0"), "orient", "sum_d0", "id")
        sizes = placed.groupBy("orient").agg(F.floor(F.count("*") * float(rest[0]) / 100).alias("most"))
        return placed.join(F.broadcast(sizes), "orient").where("place < most").select("id")  # one row an orientation
    raise ValueError(f"no such view: {definition}")
