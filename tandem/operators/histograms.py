"""Colour histograms of images given as pixels: ``id, r, g, b``, bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.colours import delta_e2000, rgb_to_hsv, rgb_to_lab

from .shared import checkpointed

#: Bins of grey, of saturation, of each of red, green and blue, and of each axis of the joint ones.
GREY_BINS, SATURATION_BINS, RGB_BINS, JOINT_BINS = 128, 128, 12, 16


def binned(value: Column, bins: int) -> Column:
    """Bin of a value in [0, 1]; the upper end belongs to the last bin."""
    return F.least(F.lit(bins - 1), F.floor(value * bins)).cast("int")


def colour_histograms(pixels: DataFrame, key: str = "id") -> DataFrame:
    """``key, kind, bin, n`` for the bins that occur, of five kinds: grey, saturation, rgb, hue x saturation, saturation x value.

    One pass: each pixel gives five rows that are counted before the shuffle.
    """
    r, g, b = (F.col(c).cast("double") for c in ("r", "g", "b"))
    hue, saturation, value = rgb_to_hsv(r, g, b)
    red, green, blue = (binned(c / 255.0, RGB_BINS) for c in (r, g, b))
    h, s, v = (binned(c, JOINT_BINS) for c in (hue, saturation, value))
    kinds = {
        "grey": binned(F.floor((r + g + b) / 3.0) / 255.0, GREY_BINS), "saturation": binned(saturation, SATURATION_BINS),
        "rgb": (red * RGB_BINS + green) * RGB_BINS + blue, "hs": h * JOINT_BINS + s, "sv": s * JOINT_BINS + v,
    }
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("bin")) for k, b in kinds.items()]))
    return pixels.select(key, each).groupBy(key, "kind", "bin").agg(F.count("*").alias("n"))


def widened(histograms: DataFrame, kind: str, bins: int, key: str = "id") -> DataFrame:
    """``key, histo``: the counts of one kind as an array of all its bins, zeros too."""
    own = histograms.where(F.col("kind") == kind).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return own.select(key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("histo"))


def image_colours(pixels: DataFrame, key: str = "id") -> DataFrame:
    """``key, n, r, g, b, ll, aa, bb, rgb_radius, lab_radius, contrast`` of each image, in whole numbers.

    Means of the bytes and of Lab; the mean distance of the pixels from those, as
    lengths in RGB and by the 2000 difference of whole Lab numbers; and the ratio
    of the lightest to the darkest, that at least 1. Pixels are counted by colour
    before any shuffle, so an image of any size has at most as many rows a task
    as it has colours; the second pass joins these with one row an image.
    """
    counted = checkpointed(pixels.where("r is not null and g is not null and b is not null").groupBy(key, "r", "g", "b").agg(F.count("*").alias("n")))
    lab = rgb_to_lab(*[F.col(c).cast("double") for c in ("r", "g", "b")])
    colours = counted.select(key, "r", "g", "b", "n", *[c.alias(name) for c, name in zip(lab, ("l_", "a_", "b_"))])
    n = F.col("n")
    means = colours.groupBy(key).agg(
        F.sum("n").alias("n"), *[F.floor(F.sum(F.col(c) * n) / F.sum("n")).cast("int").alias(c) for c in ("r", "g", "b")],
        *[(F.sum(F.col(c) * n) / F.sum("n")).cast("int").alias(name) for c, name in (("l_", "ll"), ("a_", "aa"), ("b_", "bb"))],
    )
    away = colours.join(means.select(key, *[F.col(c).alias(f"m_{c}") for c in ("r", "g", "b", "ll", "aa", "bb")]), key)
    rgb = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in ("r", "g", "b")), F.lit(0.0)))
    far = delta_e2000([F.col(f"m_{c}").cast("double") for c in ("ll", "aa", "bb")], [F.col(c).cast("int").cast("double") for c in ("l_", "a_", "b_")])
    radii = away.groupBy(key).agg(
        (F.sum(rgb * n) / F.sum("n")).cast("int").alias("rgb_radius"), (F.sum(far * n) / F.sum("n")).cast("int").alias("lab_radius"),
        (F.max("l_") / F.greatest(F.lit(1.0), F.min("l_"))).cast("int").alias("contrast"),
    )
    return means.join(radii, key).select(key, "n", "r", "g", "b", "ll", "aa", "bb", "rgb_radius", "lab_radius", "contrast")
