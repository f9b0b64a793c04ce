"""Score matrices in long form: ``model, i, j, p``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average(cells: DataFrame) -> DataFrame:
    """``i, j, total, mean`` over the models; summed in each task before the shuffle."""
    return cells.groupBy("i", "j").agg(F.round(F.sum("p"), 6).alias("total"), F.round(F.avg("p"), 6).alias("mean"))


def trusted_models(cells: DataFrame, low: float = 0.1, high: float = 0.98) -> DataFrame:
    """``model, mean, spread`` of the models that say something: mean inside [low, high], spread not 0."""
    told = cells.groupBy("model").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("spread"))
    return told.where((F.col("mean") >= low) & (F.col("mean") <= high) & (F.col("spread") > 1e-9))


def average_trusted(cells: DataFrame, low: float = 0.1, high: float = 0.98) -> DataFrame:
    """Averages over trusted models only.

    Which models those are is one row a model, so it goes to the cells and not
    the cells to it; the cells then move once, added up.
    """
    return average(cells.join(F.broadcast(trusted_models(cells, low, high).select("model")), "model", "left_semi"))  # one row a model


def percent_over(cells: DataFrame, cut: float) -> DataFrame:
    """Of each cell, the average and the share of models over ``cut``, in percent."""
    return cells.groupBy("i", "j").agg(
        F.round(F.avg("p"), 6).alias("mean"), F.round(F.avg(F.when(F.col("p") > cut, 100.0).otherwise(0.0)), 6).alias("percent")
    )


def row_and_column_means(cells: DataFrame) -> DataFrame:
    """``model, id, row_mean, column_mean`` without the diagonal; one pass, each cell counted for both its ends."""
    off = cells.where("i <> j")
    ends = F.explode(F.array(F.struct(F.col("i").alias("id"), F.col("p").alias("out"), F.lit(None).cast("double").alias("into")), F.struct(F.col("j").alias("id"), F.lit(None).cast("double").alias("out"), F.col("p").alias("into"))))
    return off.select("model", ends.alias("e")).groupBy("model", "e.id").agg(F.round(F.avg("e.out"), 6).alias("row_mean"), F.round(F.avg("e.into"), 6).alias("column_mean"))


def pair_averages(cells: DataFrame) -> DataFrame:
    """Both directions of each canonical pair on one row, averaged over the models: ``i < j, p12, p21``."""
    low, high = F.least("i", "j"), F.greatest("i", "j")
    rows = cells.where("i <> j").select(low.alias("lo"), high.alias("hi"), (F.col("i") < F.col("j")).alias("forward"), "p")
    return rows.groupBy("lo", "hi").agg(F.round(F.avg(F.when(F.col("forward"), F.col("p"))), 6).alias("p12"), F.round(F.avg(F.when(~F.col("forward"), F.col("p"))), 6).alias("p21"))
