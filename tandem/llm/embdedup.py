"""Near-duplicate vectors by cosine, through an inverted multi-index.

Each half of the vectors has its own codebook; the pairs of codewords form a
grid of cells, and a vector lives in the cell of its nearest pair. It visits
cells in the order of their distance (a multi-sequence traversal of the two
sorted codeword lists) until no partner is to be expected further away at the
target recall, and is compared with all vectors that live there. A pair counts
for both its ends, from whichever side it is found.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import forget, materialise
from .graph import connected_components

#: Vectors of a length that its codebooks are fitted on, at most: those of the smallest hash. All are indexed.
SAMPLE = 20_000
#: A length of fewer vectors has one cell, where they all meet.
LEAST_ROWS = 256
#: Codewords a half: at least, and at most, which bounds the cells a driver or task holds.
MIN_CODEWORDS, MAX_CODEWORDS = 8, 256
#: Homes of a cell, and visitors of it, that meet in one group; visitors compared at once there.
BLOCK, TILE = 4096, 1024


def codewords_for(n: int) -> int:
    """Codewords a half for ``n`` vectors: cells grow nearly as the rows, so that homes of a cell grow little; with more cells a vector visits more."""
    return int(np.clip((n / 64) ** 0.4, MIN_CODEWORDS, MAX_CODEWORDS))


class MultiIndex:
    """Two codebooks, and how much further than its home a vector's visits go."""

    def __init__(self, sample: np.ndarray, codewords: int, cosine: float, recall: float, rounds: int = 12):
        rng = np.random.default_rng(5)
        self.half = sample.shape[1] // 2
        self.books = [self._fit(part, codewords, rng, rounds) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.margin = self._calibrate(sample, cosine, recall, rng)

    @staticmethod
    def _distances(x, book):
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1), 0)

    def _fit(self, x, codewords, rng, rounds):
        if not x.shape[1]:
            return np.zeros((1, 0))
        book = x[rng.choice(len(x), min(codewords, len(x)), replace=False)]
        for _ in range(rounds):
            nearest = self._distances(x, book).argmin(1)
            for k in range(len(book)):
                if (own := x[nearest == k]).size:
                    book[k] = own.mean(0)
        return book

    def _halves(self, x):
        return self._distances(x[:, : self.half], self.books[0]), self._distances(x[:, self.half :], self.books[1])

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each row, and its visits in order of distance as (row, cell).

        For each left codeword, nearest first, ``turn`` is the next right codeword
        to pair it with; the nearest open pair of a row is its next cell, until
        that lies further than the home by more than the margin. All rows of a
        batch take each step together.
        """
        left, right = self._halves(x)
        i, j = left.argsort(1), right.argsort(1)
        a, b = np.take_along_axis(left, i, 1), np.take_along_axis(right, j, 1)
        b = np.concatenate([b, np.full((len(x), 1), np.inf)], 1)
        width, row, turn = right.shape[1], np.arange(len(x)), np.zeros(a.shape, np.int64)
        limit = a[:, 0] + b[:, 0] + self.margin
        home = i[:, 0] * width + j[:, 0] if len(x) else np.zeros(0, np.int64)
        rows, cells = [row[:0]], [row[:0]]
        while len(row):
            cost = a + np.take_along_axis(b, turn, 1)
            p = cost.argmin(1)
            at = np.arange(len(row))
            near = cost[at, p] <= limit
            at, p = at[near], p[near]
            rows.append(row[at])
            cells.append(i[at, p] * width + j[at, turn[at, p]])
            turn[at, p] += 1
            a, b, i, j, turn, row, limit = (z[at] for z in (a, b, i, j, turn, row, limit))
        return home, np.concatenate(rows), np.concatenate(cells)

    def _calibrate(self, sample, cosine, recall, rng) -> float:
        """How much further than its home a vector must look, so that of pairs turned apart
        exactly to ``cosine`` a share of ``recall`` is found from one side or the other."""
        x = sample[rng.choice(len(sample), 2000)]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True) + 1e-300
        gaps = []
        for one, two in ((x, cosine * x + np.sqrt(1 - cosine * cosine) * side), (cosine * x + np.sqrt(1 - cosine * cosine) * side, x)):
            (left, right), (l2, r2) = self._halves(one), self._halves(two)
            at = np.arange(len(x))
            gaps.append(left[at, l2.argmin(1)] - left.min(1) + right[at, r2.argmin(1)] - right.min(1))
        return float(np.quantile(np.minimum(*gaps), recall, method="higher")) + 1e-9


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column with a link, an edge to the smallest id it reaches inside this block."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    part = linked[np.ix_(rows, cols)]
    a, b = left[rows], right[cols]
    low = np.minimum(a, np.where(part, b, np.iinfo(np.int64).max).min(1)) if len(rows) else a
    while len(rows):
        low_b = np.minimum(b, np.where(part, low[:, None], np.iinfo(np.int64).max).min(0))
        new = np.minimum(low, np.where(part, low_b, np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return np.concatenate([a, b]), np.concatenate([low, low_b])
        low = new
    return a, a


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float))


def fit(vectors: DataFrame, cosine: float, recall: float, codewords: int | None = None) -> dict[int, MultiIndex]:
    """An index for each vector length of LEAST_ROWS vectors, each from its own bounded sample.

    A task fits one length; what reaches the driver are the codebooks.
    """

    def run(key, pdf):
        n, rows = map(int, key)
        index = MultiIndex(_unit(np.stack(pdf["v"]).astype(float)), codewords or codewords_for(rows), cosine, recall)
        return pd.DataFrame({"n": [n], "index": [pickle.dumps(index)]})

    sized = vectors.withColumn("n", F.size("v"))
    rows = sized.groupBy("n").agg(F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS)
    sample = sized.withColumn("at", F.row_number().over(Window.partitionBy("n").orderBy("tag", "node"))).where(F.col("at") <= SAMPLE)
    fitted = sample.join(rows, "n").groupBy("n", "rows").applyInPandas(run, "n int, index binary").collect()
    return {r["n"]: pickle.loads(r["index"]) for r in fitted}


def place(vectors: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """``node, tag, times, v`` -> ``node, tag, times, dims, home, visits, x`` with the vector packed in ``x``."""
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)
    kind = "<f4" if isinstance(vectors.schema["v"].dataType.elementType, FloatType) else "<f8"

    def run(batches):
        for batch in batches:
            raw = [np.asarray(v, kind).tobytes() for v in batch.column(3).to_pylist()]
            dims = np.array([len(x) // int(kind[2]) for x in raw])
            home, visits = np.zeros(len(raw), np.int32), [[0]] * len(raw)
            for n in set(dims.tolist()) & set(shared.value):
                at = np.flatnonzero(dims == n)
                home[at], row, cell = shared.value[n].traverse(_units([raw[i] for i in at], kind))
                order = np.argsort(row, kind="stable")
                for i, own in zip(at, np.split(cell[order], np.cumsum(np.bincount(row, minlength=len(at)))[:-1])):
                    visits[i] = own
            columns = [*batch.columns[:3], pa.array(dims, pa.int32()), pa.array(home), pa.array(visits, pa.list_(pa.int32())), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "tag", "times", "dims", "home", "visits", "x"])

    return vectors.select("node", "tag", "times", "v").mapInArrow(run, "node long, tag long, times long, dims int, home int, visits array<int>, x binary")


def _compare(cosine: float, kind: str):
    def run(key, pdf):
        asks, homes = pdf[pdf["visitor"]], pdf[~pdf["visitor"]]
        counts, edges = [], []
        if len(asks) and len(homes):
            a, b = _units(asks["x"].to_list(), kind), _units(homes["x"].to_list(), kind)
            an, at, am = (asks[c].to_numpy() for c in ("node", "tag", "times"))
            bn, bt, bm = (homes[c].to_numpy() for c in ("node", "tag", "times"))
            # Whether a home visits a visitor's home in turn: then both find the pair, and the smaller one counts it.
            own, column = np.unique(asks["home"].to_numpy(), return_inverse=True)
            width = np.array([len(v) for v in homes["visits"]])
            cells = np.concatenate(homes["visits"].to_list())
            to = np.minimum(np.searchsorted(own, cells), len(own) - 1)
            hit, row = own[to] == cells, np.repeat(np.arange(len(homes)), width)
            back = np.zeros((len(own), len(homes)), bool)
            back[to[hit], row[hit]] = True
            to_homes = np.zeros(len(homes), np.int64)
            for begin in range(0, len(asks), TILE):
                t = slice(begin, begin + TILE)
                linked = a[t] @ b.T >= cosine
                linked &= (an[t, None] != bn) | (at[t, None] != bt)
                if not linked.any():
                    continue
                first = (an[t, None] < bn) | ((an[t, None] == bn) & (at[t, None] < bt))
                counted = (linked & (first | ~back[column[t]])).astype(float)
                n = (counted @ bm).astype(np.int64)
                to_homes += (am[t] @ counted).astype(np.int64)
                has = np.flatnonzero(n)
                counts.append((an[t][has], at[t][has], n[has]))
                src, dst = _forest(linked, an[t], bn)
                edges.append((src[src != dst], dst[src != dst]))
            has = np.flatnonzero(to_homes)
            counts.append((bn[has], bt[has], to_homes[has]))
        told = [np.concatenate(z) for z in zip(*counts)] if counts else [np.zeros(0, np.int64)] * 3
        src, dst = [np.concatenate(z) for z in zip(*edges)] if edges else [np.zeros(0, np.int64)] * 2
        zero = np.zeros(len(src), np.int64)
        return pd.DataFrame({
            "src": np.concatenate([told[0], src]), "tag": np.concatenate([told[1], zero]), "n": np.concatenate([told[2], zero]),
            "dst": np.concatenate([np.full(len(told[0]), -1), dst]), "edge": np.arange(len(told[0]) + len(src)) >= len(told[0]),
        })

    return run


def vector_links(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, codewords: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``vectors(node, tag, times, v)``, distinct -> (``node, tag, n`` links to rows of other vectors, edges ``src, dst``).

    The index is built at every size, and all lengths go through one job, whose
    key names the length. A group gets about BLOCK homes and BLOCK visitors of
    one cell, whatever the cell holds; it returns counts and a spanning forest,
    never its pairs.
    """
    kind = "<f4" if isinstance(vectors.schema["v"].dataType.elementType, FloatType) else "<f8"
    placed = materialise(place(vectors, fit(vectors, cosine, recall, codewords)), "vector-places")
    homes = placed.groupBy("dims", F.col("home").alias("cell")).agg(F.count("*").alias("homes"))
    visitors = placed.select("dims", F.explode("visits").alias("cell")).groupBy("dims", "cell").agg(F.count("*").alias("visitors"))
    blocks = homes.join(visitors, ["dims", "cell"]).select("dims", "cell", F.expr(f"cast(ceil(homes / {BLOCK}) as int)").alias("h"), F.expr(f"cast(ceil(visitors / {BLOCK}) as int)").alias("p"))

    def dealt(rows: DataFrame, visitor: bool) -> DataFrame:
        own, other = ("p", "h") if visitor else ("h", "p")
        met = rows.join(blocks, ["dims", "cell"])
        met = met.withColumn(f"{own}_at", F.pmod("tag", own).cast("int")).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return met.select("dims", "cell", "h_at", "p_at", F.lit(visitor).alias("visitor"), "node", "tag", "times", "home", "visits", "x")

    asks = dealt(placed.select("node", "tag", "times", "dims", "home", F.explode("visits").alias("cell"), F.lit(None).cast("array<int>").alias("visits"), "x"), True)
    live = dealt(placed.withColumn("cell", F.col("home")), False)
    schema = "src long, tag long, n long, dst long, edge boolean"
    found = materialise(asks.unionByName(live).groupBy("dims", "cell", "h_at", "p_at").applyInPandas(_compare(cosine, kind), schema), "vector-links")
    forget(placed)
    links = found.where("not edge").groupBy(F.col("src").alias("node"), "tag").agg(F.sum("n").alias("n"))
    return links, found.where("edge").select("src", "dst").distinct()


def near_vectors(table: DataFrame, cosine: float = 0.95, recall: float = 0.999, codewords: int | None = None) -> DataFrame:
    """``vec_id, embedding`` -> ``vec_id, n_links, component_id, kept``, one row for each input row.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing, nor do rows without a vec_id. Equal vectors meet once, with their
    number, so a vector in a third of all rows costs one row; rows are told by
    128 bits of hash, so only distinct vectors move. Vectors link only with those
    of their own length. Other columns are not looked at; an empty table gives
    an empty result.
    """
    single = isinstance(table.schema["embedding"].dataType.elementType, FloatType)
    rows = table.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    fine = F.forall("v", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("v", lambda v: v != 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    tag = F.xxhash64("v").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    good = rows.where(usable).select("vec_id", "v", tag.alias("tag"), F.xxhash64(F.lit(7), "v").alias("tag2"))
    distinct = materialise(good.groupBy("tag", "tag2").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"), F.first("v").alias("v")), "vectors")
    links, edges = vector_links(distinct, cosine, recall, codewords)
    components = connected_components(edges, "vector-components")
    told = distinct.select("node", "tag", "tag2", "times").join(links, ["node", "tag"], "left").join(components, "node", "left")
    told = told.select("tag", "tag2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "tag", "tag2").join(told, ["tag", "tag2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
