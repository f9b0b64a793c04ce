"""Passages that documents share with a benchmark, found by winnowed fingerprints.

Of every span of WINDOW words the smallest hash of its SPAN-word grams is kept,
the last of equal ones. The choice depends on the span alone, so a span that
stands in a document and in a benchmark item leaves the same fingerprint in
both, and none of WINDOW words or more is missed. An item of fewer words is one
shorter window; its length has fingerprints of its own.

Documents are read once. Their fingerprints are first looked up in a filter of a
fixed number of bits, so nearly only those that the benchmark has go on, each
with the words around it. These meet the benchmark's fingerprints by key; each
that stays is extended to the windows that hold it, which must equal a
benchmark window word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_by_weight, materialise
from .words import in_ranges, mix

#: Words of a window, and of the grams that fingerprints are made of.
WINDOW, SPAN = 10, 5
#: Bits of the filter that is broadcast: 2 MB at any size of the benchmark.
FILTER_BITS = 1 << 24
#: Bytes of text that a task takes up at once; a longer text stands alone.
CHUNK_BYTES = 4_000_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Lower case of A-Z, and the bytes of words: 0-9, a-z and everything beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in LOWER], bool)
CANDIDATE = pa.struct([("n", pa.int32()), ("print", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("words", pa.list_(pa.string()))])


@dataclass
class Text:
    """Words of several texts as places in one row of bytes."""

    raw: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, its first word; one entry more than texts
    hashes: np.ndarray

    def words(self, begin: int, end: int) -> list[str]:
        return [self.raw[a:b].tobytes().decode() for a, b in zip(self.starts[begin:end].tolist(), self.ends[begin:end].tolist())]


def read_words(column: pa.Array) -> Text:
    """The words of a column of strings; null has none."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    begin, end = int(offsets[0]), int(offsets[-1])
    raw = LOWER[np.frombuffer(column.buffers()[2], np.uint8)[begin:end]] if end > begin else np.zeros(0, np.uint8)
    offsets = offsets - begin
    inside, edge = IN_WORD[raw], np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # no word reaches into the next text
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    # The bytes of a word as the digits of a number, the same at any place: differences of one running sum.
    powers = np.cumprod(np.concatenate([[U64(1)], np.full(max(0, len(raw) - 1), U64(_BASE))])) if len(raw) else np.zeros(0, U64)
    sums = np.concatenate([[U64(0)], np.cumsum((raw.astype(U64) + U64(1)) * powers)])
    undo = np.cumprod(np.concatenate([[U64(1)], np.full(max(0, len(raw) - 1), U64(_INVERSE))])) if len(raw) else powers
    hashes = mix((sums[ends] - sums[starts]) * undo[starts] + (ends - starts).astype(U64))
    return Text(raw, starts, ends, np.searchsorted(starts, offsets), hashes)


def winnow(text: Text, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (first word) of the fingerprints of all spans of ``n`` words inside one text."""
    k = min(SPAN, n)
    width, grams = n - k + 1, len(text.hashes) - k + 1
    if len(text.hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    found = np.full(grams, U64(n))
    for i in range(k):
        found = found * U64(_BASE) + text.hashes[i : i + grams]
    found = mix(found)
    spans = grams - width + 1
    least, at = found[:spans].copy(), np.arange(spans)
    for i in range(1, width):
        here = found[i : i + spans]
        later = here <= least
        least[later] = here[later]
        at[later] = np.flatnonzero(later) + i
    ends = np.repeat(text.first[1:], np.diff(text.first))[:spans]  # of the text that a span starts in
    chosen = np.zeros(grams, bool)
    chosen[at[np.arange(spans) + n <= ends]] = True
    places = np.flatnonzero(chosen)
    return found[places], places


def bits(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each fingerprint in the filter."""
    mask = U64(FILTER_BITS - 1)
    return (prints & mask).astype(np.int64), ((prints >> U64(40)) & mask).astype(np.int64)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, n, print, words``: each window of each item (``words``), and each fingerprint of those (``print``).

    Items without a word give no row; an item's null id reads as an empty string.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            text = read_words(batch.column(1))
            rows = []
            for i, (begin, end) in enumerate(zip(text.first[:-1].tolist(), text.first[1:].tolist())):
                n = min(window, end - begin)
                if not n:
                    continue
                own = Text(text.raw, text.starts[begin:end], text.ends[begin:end], np.array([0, end - begin]), text.hashes[begin:end])
                rows += [(ids[i], n, None, " ".join(own.words(at, at + n))) for at in range(end - begin - n + 1)]
                rows += [(ids[i], n, p, None) for p in winnow(own, n)[0].view(np.int64).tolist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "n", "print", "words"), r)) for r in rows], pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("print", pa.int64()), ("words", pa.string())]))

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").mapInArrow(run, "item_id string, n int, print long, words string")


def _filter(prints: DataFrame) -> np.ndarray:
    """The filter as bytes; what reaches the driver is at most a number for each 64 bits of it."""
    low = F.col("print").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("print", 40).bitwiseAND(F.lit(FILTER_BITS - 1))
    places = prints.select(F.explode(F.array(low, high)).alias("place"))
    cells = places.groupBy(F.expr("place div 64").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("mask")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[cells["cell"].to_numpy(np.int64)] = cells["mask"].to_numpy(np.int64).view(np.uint64)
    return words.view(np.uint8)


def fingerprints(docs: DataFrame, lengths: list[int], seen: np.ndarray) -> DataFrame:
    """``doc_id, n_words, candidates``: of each document, the fingerprints that ``seen`` lets through, with the words around each.

    ``lengths`` are the window lengths that the benchmark has (ten at most for
    WINDOW). No shuffle; a document's words are held once, texts in chunks.
    """
    kept = docs.sparkSession.sparkContext.broadcast(seen.tobytes())

    def passes(places):
        look = np.frombuffer(kept.value, np.uint8)
        return (look[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for begin, end in in_ranges(sizes, CHUNK_BYTES):
                text = read_words(column.slice(begin, end - begin))
                found: list[list | None] = [None] * (end - begin)
                for n in lengths:
                    prints, places = winnow(text, n)
                    low, high = bits(prints)
                    hit = np.flatnonzero(passes(low) & passes(high))
                    owner = np.searchsorted(text.first, places[hit], side="right") - 1
                    k = min(SPAN, n)
                    for p, at, d in zip(prints[hit].view(np.int64).tolist(), places[hit].tolist(), owner.tolist()):
                        first, last = int(text.first[d]), int(text.first[d + 1])
                        left = max(first, at + k - n)
                        found[d] = found[d] or []
                        found[d].append({"n": n, "print": p, "at": at - first, "lead": at - left, "words": text.words(left, min(last, at + n))})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(np.diff(text.first), pa.int64()), pa.array(found, pa.list_(CANDIDATE))], names=["doc_id", "n_words", "candidates"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, candidates array<struct<n:int,print:bigint,at:int,lead:int,words:array<string>>>")


def _marked(rows: DataFrame, keys: list[str], marks: DataFrame, label: str) -> DataFrame:
    """``rows`` inner-joined with ``marks``, one row a key of those that occur in both, wherever a third of the rows may have one key."""
    weighed = materialise(rows.groupBy(*keys).agg(F.count("*").alias("__times")).join(marks, keys), label)
    return join_by_weight(rows, weighed, keys, "__times").drop("__times")


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans, n_hit, n_items, items_sha256``.

    Words are runs of 0-9, A-Z, a-z and characters beyond ASCII, with A-Z in
    lower case. ``spans`` are the hit words as ranges (``start`` to before
    ``stop``, from 0), joined where they meet; ``n_hit`` is their length.
    ``n_items`` counts the items that have a window in the document, and
    ``items_sha256`` is the checksum of their sorted, comma-joined ids.

    Null and empty texts have no words; an item without words hits nothing.
    Repeated rows and equal ids are judged row by row; items with equal ids
    count as one. Only ``doc_id``, ``item_id`` and the texts are read.
    """
    bench = materialise(benchmark_windows(benchmark, window), "bench-windows")
    prints = materialise(bench.where("print is not null").select("n", "print").distinct(), "bench-prints")
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # at most `window` numbers
    rows = materialise(fingerprints(docs, lengths, _filter(prints)).withColumn("row", F.monotonically_increasing_id()), "bench-rows")
    windows = materialise(bench.where("words is not null").select("n", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "bench-distinct")
    owners = materialise(bench.where("words is not null").distinct().join(windows, ["n", "words"]).select("window", "item_id"), "bench-owners")

    found = rows.where("candidates is not null").select("row", F.inline("candidates"))
    met = _marked(found, ["n", "print"], prints, "bench-met")
    # A window holds the gram: it starts at one of the words before it, or at its own first.
    each = "transform(sequence(0, least(lead, size(words) - n)), i -> struct(at - lead + i as start, array_join(slice(words, i + 1, n), ' ') as words))"
    extended = met.where("size(words) >= n").select("row", "n", F.expr(f"inline({each})"))
    hits = _marked(extended, ["n", "words"], windows, "bench-hits")

    hits = materialise(hits.select("row", "start", (F.col("start") + F.col("n")).alias("stop"), "window").distinct(), "bench-hits")
    along = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = hits.select("row", "start", "stop").distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = apart.withColumn("span", F.sum("new").over(along)).groupBy("row", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    sets = hits.groupBy("row").agg(F.array_sort(F.collect_set("window")).alias("windows"))
    per_row = materialise(spans.join(sets, "row").select("row", "spans", F.sha2(F.array_join("windows", ","), 256).alias("kind"), "windows"), "bench-spans")

    # Copies share their set of windows: items are looked up once a set.
    sets = per_row.groupBy("kind").agg(F.first("windows").alias("windows"), F.count("*").alias("__times"))
    items = sets.select("kind", "__times", F.explode("windows").alias("window")).join(owners, "window").groupBy("kind", "__times").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    items = materialise(items.select("kind", "__times", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "bench-sets")
    named = join_by_weight(per_row.select("row", "spans", "kind"), items, ["kind"], "__times").drop("kind", "__times")
    forget(bench, prints, windows, owners, hits)

    plain = rows.where("candidates is null").select("doc_id", "n_words", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    looked = rows.where("candidates is not null").select("row", "doc_id", "n_words").join(named, "row", "left").select(*plain.columns)
    hit: Column = F.expr("aggregate(coalesce(spans, array()), 0L, (n, x) -> n + x.stop - x.start)")
    return plain.unionByName(looked).select(
        "doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"), hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contaminated_passages(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
