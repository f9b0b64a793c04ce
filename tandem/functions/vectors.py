"""Vector kernels as column expressions; vectors are ``array<double>``.

Sums run through higher-order functions, so they stay in the JVM. All inputs
are cast to double before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors of the two hyperbolic distances.
POINCARE_FLOOR, POINCARE_PLAIN_FLOOR = 1e-6, 1e-7


def as_double(vector: Column | str) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(vector, str) else vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


def cartesian(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0/0 counts as 1, and a product over a zero norm as 0."""
    top, bottom = dot(a, b), norm(a) * norm(b)
    return F.when(bottom != 0, top / bottom).when(top == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def hellinger(a: Column, b: Column) -> Column:
    """Squared differences of the roots of two histograms, each scaled by its mean."""
    mean_a, mean_b = total(a) / F.size(a), total(b) / F.size(b)
    return total(F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x / mean_a) - F.sqrt(y / mean_b), F.lit(2.0))))


def _poincare_ratio(a: Column, b: Column, floor: float) -> Column:
    alpha = F.greatest(F.lit(floor), F.lit(1.0) - dot(a, a))
    beta = F.greatest(F.lit(floor), F.lit(1.0) - dot(b, b))
    return F.greatest(F.lit(1.0), F.lit(1.0) + F.lit(2.0) * squared_distance(a, b) / (alpha * beta))


def poincare(a: Column, b: Column) -> Column:
    """Distance in the Poincare ball: arcosh of a ratio that is at least 1."""
    x = _poincare_ratio(a, b, POINCARE_FLOOR)
    return F.log(x + F.sqrt(x * x - 1.0))


def poincare_root(a: Column, b: Column) -> Column:
    """The batch tool's variant: a root where the other takes the logarithm."""
    x = _poincare_ratio(a, b, POINCARE_PLAIN_FLOOR)
    return F.sqrt(x + F.sqrt(x * x - 1.0))


METRICS = {
    "cosine": cosine_similarity,
    "cosine_distance": cosine_distance,
    "cartes": cartesian,
    "hellin": hellinger,
    "poinca": poincare,
    "poinca_root": poincare_root,
}


def metric(name: str, a: Column, b: Column, nan_as: float | None = 0.0) -> Column:
    """A kernel by name. A NaN becomes ``nan_as``; with None it ends the query."""
    value = METRICS[name](a, b)
    other = F.raise_error(F.lit(f"{name}: not a number")).cast("double") if nan_as is None else F.lit(nan_as)
    return F.when(F.isnan(value), other).otherwise(value)


def fold(a: Column, blocks: int) -> Column:
    """The mean over ``blocks`` equal consecutive parts, place by place."""
    width = F.floor(F.size(a) / blocks).cast("int")
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: total(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.get(a, i + k * width))) / blocks,
    )


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2.0)


def split_normalised(a: Column, first: int) -> tuple[Column, Column]:
    """The first ``first`` elements and the others, each at unit length."""
    return normalise(F.slice(a, 1, first)), normalise(F.slice(a, F.lit(first + 1), F.size(a) - first))


def extrapolate(a: Column, b: Column, factor: Column | float) -> Column:
    """From ``a`` towards ``b`` and beyond: ``a + factor * (b - a)``."""
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    return F.zip_with(a, b, lambda x, y: x + factor * (y - x))


#: Widths of stored vectors by kind and model; a kind's fallback stands under "".
MODEL_WIDTHS = {
    "histogram": {"histo_gss": 256, "histo_rgb": 1728, "histo_ml": 1984, "": 256},
    "imagenet": {"vgg16": 512, "densenet121": 1024, "mobilenetv2": 1280, "": 4},
    "pairnet": {"2": 2, "3": 3, "5": 5, "12": 12, "": 3},
}
MODEL_KINDS = {"1": "histogram", "2": "imagenet", "3": "pairnet"}


def vector_function(text: str) -> dict:
    """``func.type.model`` -> metric, kind, width; missing parts are cosine distance, imagenet and its fallback.

    A model may state its width as a number or after an underscore
    (``vgg16_4``); one that says nothing known has the kind's fallback width.
    """
    func, kind, model = [*text.split("."), "", ""][:3] if text else ("", "", "")
    kind = MODEL_KINDS.get(kind or "2")
    if kind is None or (func and func not in METRICS):
        raise ValueError(f"no such vector function: {text}")
    widths = MODEL_WIDTHS[kind]
    stated = model.removeprefix("pair").rsplit("_", 1)[-1]
    if kind == "imagenet" and stated.isdigit():
        width = int(stated)
    elif kind == "histogram" and model not in widths:
        number = int("0" + "".join(c for c in model if c.isdigit()))
        width = number if number in widths.values() else widths[""]
    else:
        width = widths.get(model.removeprefix("pair"), widths[""])
    return {"metric": func or "cosine_distance", "kind": kind, "width": width}
