"""Exact top-k by inner product over a bit-sliced index.

Each attribute (vector component) of a block of rows is stored as bitmaps, one
per binary digit, one bit per row; the packed blocks are the index. A query's
scores are formed as bitmaps too: every set digit of a query component adds
that attribute's slices at a shifted position, with carry-save adders made of
AND, OR and XOR over whole bitmaps. The best rows are then chosen from the most
significant score slice downward, and the rows tied at the boundary are
resolved by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a bit-sliced block and queries that meet it at once; they bound a task's memory.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 256
#: Scores are kept in this many bits, for any vector shorter than 2 ** 30.
SCORE_BITS = 160


def quantised(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, q``: floor(scale * x) of every component, in double; what does not fit a long becomes the nearest long.

    Vectors that are null, empty, or hold null or non-finite components are left
    out, and so are null ids. Rows that repeat a vec_id count once, with the
    smallest vector.
    """
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))


class BitSlicedBlock:
    """Rows of one block as bitmaps: ``slices[a][b]`` has digit b of attribute a, offset to be non-negative."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, digits: list[int], slices: np.ndarray):
        self.ids, self.low, self.digits = ids, low, digits
        self.words = -(-len(ids) // 64)
        ends = np.cumsum([0, *digits])
        self.slices = [list(slices[a:b]) for a, b in zip(ends, ends[1:])]
        self.inverted = [list(~slices[a:b]) for a, b in zip(ends, ends[1:])]
        self.alive = self.bitmap(np.arange(self.words * 64) < len(ids))

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BitSlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(axis=0)
        shifted = np.zeros((-(-len(ids) // 64) * 64, values.shape[1]), np.uint64)
        shifted[: len(ids)] = values.view(np.uint64) - low.view(np.uint64)  # below 2 ** 64 whatever the signs
        digits = [max(1, int(top).bit_length()) for top in shifted.max(axis=0)]
        slices = [cls.bitmap((column >> np.uint64(b)) & np.uint64(1)) for column, d in zip(shifted.T, digits) for b in range(d)]
        return cls(ids, low, digits, np.stack(slices))

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.ids.tobytes(), self.low.tobytes(), bytes(self.digits), np.concatenate([np.stack(own) for own in self.slices]).tobytes()

    @classmethod
    def unpack(cls, ids: bytes, low: bytes, digits: bytes, slices: bytes) -> BitSlicedBlock:
        maps = np.frombuffer(slices, np.uint64)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64), list(digits), maps.reshape(sum(digits), -1))

    @staticmethod
    def bitmap(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)

    def rows(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, least significant first, and the constant to add to them.

        A negative weight adds the inverted slices, so every term is positive:
        -w * v = w * (top - v) - w * top.
        """
        heap: list[list[np.ndarray]] = [[] for _ in range(SCORE_BITS + 1)]
        constant = sum(w * low for w, low in zip(query, self.low.tolist()))
        for weight, own, other, digits in zip(query, self.slices, self.inverted, self.digits):
            if weight < 0:
                constant += weight * ((1 << digits) - 1)
                weight, own = -weight, other
            shift = 0
            while weight:
                if weight & 1:
                    for b, bits in enumerate(own, shift):
                        heap[b].append(bits)
                weight >>= 1
                shift += 1
        out = []
        highest = max((b for b, column in enumerate(heap) if column), default=-1)
        for b in range(SCORE_BITS):
            column = heap[b]
            while len(column) > 2:  # three bitmaps of a place become one, and one carry
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                column.append(half ^ z)
                heap[b + 1].append((x & y) | (half & z))
            if len(column) == 2:
                x, y = column
                heap[b + 1].append(x & y)
                column = [x ^ y]
            if not column and b >= highest and not heap[b + 1]:
                break
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
        return out, constant

    def top(self, query: list[int], k: int, exclude: int) -> tuple[np.ndarray, list[int]]:
        """Rows (places in ``ids``) of the k best scores, ties to smaller ids, and the exact scores; not the id ``exclude``."""
        slices, constant = self.scores(query)
        tied = self.alive.copy()
        at = np.searchsorted(self.ids, exclude)
        if at < len(self.ids) and self.ids[at] == exclude:
            tied[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        sure = np.zeros_like(tied)
        found = 0
        for bits in reversed(slices):
            high = tied & bits
            n = found + int(np.bitwise_count(high).sum())
            if n > k:
                tied = high
            else:
                sure, found, tied = sure | high, n, tied & ~bits
                if n == k:
                    break
        chosen = np.concatenate([self.rows(sure), self.rows(tied)[: k - found]])
        word, bit = chosen >> 6, (chosen & 63).astype(np.uint64)
        score = [constant] * len(chosen)
        for b, bits in enumerate(slices):
            for i in np.flatnonzero((bits[word] >> bit) & np.uint64(1)):
                score[i] += 1 << b
        return chosen, score


def build_index(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``vec_id, q`` -> the index: ``dims, block, ids, low, digits, slices``, one row a block of about ``block_rows`` vectors of one length.

    Written once to the shared folder; any number of searches can use it.
    """
    size = rows.agg(F.count("*").alias("n")).first()["n"]
    blocks = max(1, -(-size // (block_rows or BLOCK_ROWS)))

    def run(key, pdf):
        built = BitSlicedBlock.build(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["q"].to_list()).astype(np.int64))
        return pd.DataFrame([(*key, *built.pack())], columns=["dims", "block", "ids", "low", "digits", "slices"])

    dealt = rows.select("vec_id", "q", F.size("q").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    return materialise(dealt.groupBy("dims", "block").applyInPandas(run, "dims int, block int, ids binary, low binary, digits binary, slices binary"), "topk-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, block_queries: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best vectors of ``index`` for every row of ``queries(vec_id, q)``.

    A query meets the vectors of its own length. Queries are dealt into blocks
    of about ``block_queries``; each pair of an index block and a query block is
    one group, which returns k rows a query. So a packed index block is copied
    once per query block, a query once per index block, and only k x blocks
    candidates a query are ranked at the end. Ranking is by the exact score; a
    score that does not fit a long is shown as the nearest long.
    """
    asked = queries.agg(F.count("*").alias("n")).first()["n"]
    groups = max(1, -(-asked // (block_queries or BLOCK_QUERIES)))
    last = index.agg(F.max("block").alias("b")).first()["b"] or 0
    blocks = index.withColumn("g", F.explode(F.expr(f"sequence(0, {groups - 1})")))
    asks = queries.select("vec_id", "q", F.size("q").alias("dims"), F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.expr(f"sequence(0, {last})")).alias("block"))

    def run(left, right):
        out = []  # a length may have no vectors in some block
        for row in left.itertuples():
            block = BitSlicedBlock.unpack(row.ids, row.low, row.digits, row.slices)
            for qid, q in zip(right["vec_id"].to_list(), right["q"].to_list()):
                chosen, score = block.top([int(w) for w in q], k, qid)
                out += [(qid, i, (s + (1 << SCORE_BITS)).to_bytes(SCORE_BITS // 8 + 1, "big"), max(-(1 << 63), min((1 << 63) - 1, s))) for i, s in zip(block.ids[chosen].tolist(), score)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "exact", "score"])

    # Scores as bytes of one length, in the order of the numbers, for those that no long can hold.
    found = blocks.groupBy("dims", "block", "g").cogroup(asks.groupBy("dims", "block", "g")).applyInPandas(run, "query_id long, vec_id long, exact binary, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_query(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries: the vectors whose id is divisible by ``every``; candidates: every other vector of the same length."""
    rows = materialise(quantised(embeddings), "topk-vectors")
    return search(build_index(rows), rows.where(F.col("vec_id") % every == 0), k)
