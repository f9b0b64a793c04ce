"""A stored index for nearest neighbours: an inverted file whose lists are directories of one table.

Centroids are fitted on a bounded sample. Every vector is stored in the list of its nearest
centroid, with the leading dimensions apart from the whole vector. A search reads only the
lists nearest to its queries, ranks what they hold by the leading dimensions, which bound the
distance from below, and computes whole distances for those that can still be among the best.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks

#: Vectors that centroids are fitted on, at most, rounds of fitting, and lists at most: what driver and tasks hold is bounded.
SAMPLE, ROUNDS, MAX_LISTS = 20_000, 10, 4096
#: Leading dimensions that are compared first.
PREFIX = 16
#: Queries and stored vectors that meet in one group.
BLOCK = 2048


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Cosine distances are half the squared distances of unit vectors; a zero vector stays."""
    if metric == "l2":
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's rounds from vectors of the sample; an empty list starts again at the vector furthest from its own centroid."""
    rng = np.random.default_rng(3)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        far = _far(sample, centroids)
        own = far.argmin(1)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = sample[np.argsort(far.min(1))[::-1][: len(empty)]]
    return centroids


def build(items: DataFrame, path: str, metric: str = "cosine", lists: int | None = None, prefix: int = PREFIX, vector: str = "vec") -> None:
    """Store the index of ``items(id, vec)`` under ``path``, which every executor can reach.

    ``lists`` defaults to the square root of the rows. Vectors are of one length;
    null ones, and those with nulls or other than finite numbers, are left out.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"no such metric of an index: {metric}")
    fine = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = items.select("id", F.col(vector).cast("array<double>").alias("vec")).where(F.coalesce(fine, F.lit(False)))
    n = rows.count()
    lists = min(MAX_LISTS, lists or max(1, int(np.sqrt(n))))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["vec"]
    width = len(drawn.iloc[0]) if len(drawn) else 0
    centroids = fit_centroids(_prepared(np.stack(drawn.to_list()).astype(float), metric), lists) if width else np.zeros((0, 0))
    known = rows.sparkSession.sparkContext.broadcast(centroids)

    def place(frames):
        for pdf in frames:
            x = _prepared(np.stack(pdf["vec"].to_list()).astype(float), metric) if len(pdf) else np.zeros((0, width))
            far = _far(x, known.value) if len(pdf) else np.zeros((0, 1))
            yield pd.DataFrame({"id": pdf["id"], "head": list(x[:, :prefix]), "rest": list(x[:, prefix:]), "list": far.argmin(1).astype("int32")})

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInPandas(place, f"id {kind}, head array<double>, rest array<double>, list int")
    # A list goes to one writer each time it is dealt: large ones to several.
    placed.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(max(1, n // (lists * 100_000))))).sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    about = {"metric": metric, "prefix": prefix, "width": width, "rows": n, "centroids": centroids.tolist(), "id": kind}
    rows.sparkSession.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}/about")


class VectorIndex:
    """An index that ``build`` has stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        self.centroids = np.array(self.about["centroids"], float).reshape(-1, self.about["width"])
        schema = f"id {self.about['id']}, head array<double>, rest array<double>, list int"
        self.lists = spark.read.schema(schema).parquet(f"{path}/lists")

    def probes(self, queries: DataFrame, probes: int, vector: str = "vec") -> DataFrame:
        """``qid, vec, list``: each query once for each of its ``probes`` nearest lists."""
        known, metric = queries.sparkSession.sparkContext.broadcast(self.centroids), self.about["metric"]

        def run(frames):
            for pdf in frames:
                if not len(pdf):
                    continue
                x = _prepared(np.stack(pdf["vec"].to_list()).astype(float), metric)
                near = np.argsort(_far(x, known.value), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"qid": np.repeat(pdf["qid"].to_numpy(), near.shape[1]), "vec": [v for v, n in zip(x, near) for _ in n], "list": near.ravel().astype("int32")})

        kind = queries.schema["id"].dataType.simpleString()
        return queries.select(F.col("id").alias("qid"), F.col(vector).cast("array<double>").alias("vec")).where("vec is not null").mapInPandas(run, f"qid {kind}, vec array<double>, list int")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, vector: str = "vec") -> DataFrame:
        """``qid, rank, id, distance`` of the ``k`` nearest in the probed lists for each of ``queries(id, vec)``, never itself.

        Distances are rounded to 6 places, ties go to the smaller id. Lists and
        their visitors meet in blocks, so no group grows with the table.
        """
        asked = self.probes(queries, probes, vector)
        return self._ranked(asked, self.lists, k)

    def search_few(self, queries: DataFrame, k: int = 10, probes: int = 8, vector: str = "vec") -> DataFrame:
        """As ``search``, for so few queries that the lists they probe are named in the plan: no other directory is read."""
        asked = self.probes(queries, probes, vector)
        wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # MAX_LISTS numbers at most
        return self._ranked(asked, self.lists.where(F.col("list").isin(wanted)), k)

    def _ranked(self, asked: DataFrame, lists: DataFrame, k: int) -> DataFrame:
        prefix, cosine = self.about["prefix"], self.about["metric"] == "cosine"
        sizes = lists.groupBy("list").agg(F.count("*").alias("rows")).join(asked.groupBy("list").agg(F.count("*").alias("asks")), "list")
        sizes = F.broadcast(sizes.select("list", F.expr(f"cast(ceil(rows / {BLOCK}) as int)").alias("r"), F.expr(f"cast(ceil(asks / {BLOCK}) as int)").alias("a")))  # MAX_LISTS rows at most

        def dealt(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
            met = rows.join(sizes, "list")
            return met.withColumn("own", F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        a = dealt(asked, "a", "r", "qid").select("list", F.col("own").alias("i"), F.col("other").alias("j"), "qid", "vec")
        b = dealt(lists, "r", "a", "id").select("list", F.col("other").alias("i"), F.col("own").alias("j"), "id", "head", "rest")
        kinds = f"qid {asked.schema['qid'].dataType.simpleString()}, id {self.about['id']}, distance double"

        empty = pd.DataFrame({"qid": pd.Series([], dtype=object), "id": pd.Series([], dtype=object), "distance": pd.Series([], dtype=float)})

        def run(one, two):
            if not len(one) or not len(two):
                return empty
            two = two.sort_values("id", ignore_index=True)
            x, ids, qids = np.stack(one["vec"].to_list()), two["id"].to_numpy(), one["qid"].to_numpy()
            head, rest = np.stack(two["head"].to_list()), np.stack(two["rest"].to_list())
            far = _far(x[:, :prefix], head)
            far[qids[:, None] == ids] = np.inf
            cut, out = min(k, len(ids)), []
            for q in range(len(x)):
                # The nearest by the leading dimensions give a bound; all below it are compared whole.
                first = np.argpartition(far[q], cut - 1)[:cut]
                bound = (far[q][first] + ((rest[first] - x[q, prefix:]) ** 2).sum(1)).max()
                open_ = np.flatnonzero((far[q] <= bound + 1e-9) & np.isfinite(far[q]))
                whole = far[q][open_] + ((rest[open_] - x[q, prefix:]) ** 2).sum(1)
                told = (whole / 2 if cosine else np.sqrt(whole)).round(6) + 0.0
                best = np.lexsort((open_, told))[:k]
                out.append(pd.DataFrame({"qid": qids[q], "id": ids[open_[best]], "distance": told[best]}))
            return pd.concat(out)

        found = a.groupBy("list", "i", "j").cogroup(b.groupBy("list", "i", "j")).applyInPandas(run, kinds)
        w = Window.partitionBy("qid").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", F.col("rank").cast("int").alias("rank"), "id", "distance")

    def scanned(self, queries: DataFrame, probes: int = 8, vector: str = "vec") -> DataFrame:
        """One row ``share``: how much of the table a query reads on average."""
        sizes = self.lists.groupBy("list").agg(F.count("*").alias("rows"))
        met = self.probes(queries, probes, vector).groupBy("list").agg(F.count("*").alias("asks")).join(F.broadcast(sizes), "list")
        asks = queries.where(F.col(vector).isNotNull()).agg(F.count("*").alias("n"))
        return met.agg(F.sum(F.col("rows") * F.col("asks")).alias("read")).crossJoin(F.broadcast(asks)).select((F.col("read") / F.col("n") / self.about["rows"]).alias("share"))  # one row

    def probes_for(self, items: DataFrame, recall: float, k: int = 10, sample: int = 500, vector: str = "vec") -> int:
        """The least number of lists that must be probed for a recall, by the exact neighbours of a bounded sample of ``items``."""
        asked = items.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", F.col(vector).cast("array<double>").alias("vec"))
        metric = "cosine_distance" if self.about["metric"] == "cosine" else "cartes"
        exact = blocks.nearest(asked, items.select("id", F.col(vector).cast("array<double>").alias("vec")), k, metric)
        met = exact.select("id", F.col("match_id")).join(self.lists.select(F.col("id").alias("match_id"), "list"), "match_id").join(asked, "id").select("vec", "list")
        known, kind = items.sparkSession.sparkContext.broadcast(self.centroids), self.about["metric"]

        def run(frames):
            for pdf in frames:
                if len(pdf):
                    far = _far(_prepared(np.stack(pdf["vec"].to_list()).astype(float), kind), known.value)
                    own = far[np.arange(len(pdf)), pdf["list"].to_numpy()]
                    yield pd.DataFrame({"place": (far < own[:, None]).sum(1)})

        places = met.mapInPandas(run, "place long").groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # MAX_LISTS rows at most
        total, reached = sum(r["n"] for r in places), 0
        for r in places:
            reached += r["n"]
            if reached >= recall * total:
                return r["place"] + 1
        return 1
