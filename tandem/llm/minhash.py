"""Near-duplicate documents by weighted MinHash of word shingles, with thrown darts.

Every unit of an element's weight owns a strip along a rank axis; hashes throw
darts into the strip's fixed regions at unit density, so two documents that
share the element share its darts. Each dart has a rank and one of K
coordinates; a document keeps the earliest dart of each coordinate. Two
documents agree at a coordinate with probability equal to their weighted
Jaccard similarity, and a document of any size needs only about K log K darts.
Bands of the signature make candidates, whole texts verify them, and links are
contracted to classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_by_weight, materialise, text_digest
from .graph import connected_components, contracted
from .words import U64, mix, segment, text_chunks

#: Words a shingle, bands and coordinates a band. At similarity 0.8, 25 bands of 5
#: miss a pair with probability (1 - 0.8 ** 5) ** 25 = 5e-5.
SHINGLE, BANDS, ROWS = 5, 25, 5
#: Members of a bucket, on either side, that meet at once when a bucket holds several classes.
BLOCK = 256
#: Shingles whose columns are compared at once there.
COLUMNS = 4096
#: Regions of the rank axis below 1; above, each unit is a region.
RANKS = np.array([0, 1 / 8, 1 / 4, 1 / 2, 1.0])


def shingles(texts: list, n: int = SHINGLE) -> list[np.ndarray]:
    """64-bit hashes of each text's shingles of ``n`` words, in order and with repeats.

    Words are lower-cased and split at white space. A text of fewer words has one
    shingle of all of them; one without words has none.
    """
    words = segment(texts, "spaces")
    h = words.hashes()
    odd = mix(np.arange(1, n + 1, dtype=np.uint64)) | U64(1)
    whole = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        whole += h[j : j + len(whole)] * odd[j]
    whole = mix(whole)
    out = []
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= n:
            out.append(whole[a : b - n + 1])
        else:
            out.append(mix((h[a:b] * odd[: b - a]).sum(keepdims=True, dtype=np.uint64) + U64(b - a)) if b > a else h[:0])
    return out


def weighted(found: np.ndarray, multiset: bool) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(found, return_counts=True)
    return elements, counts.astype(float) if multiset else np.ones(len(elements))


def _poisson(area: float) -> np.ndarray:
    terms = np.cumprod(np.concatenate([[1.0], area / np.arange(1, 24)]))
    return np.cumsum(terms) * np.exp(-area)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int, boost: float = 1.0) -> np.ndarray:
    """One row of k darts (64-bit names) for each non-empty set of (elements, weights)."""
    out = np.zeros((len(sets), k), np.uint64)
    if not sets:
        return out
    units = [np.ceil(w).astype(np.int64) for _, w in sets]
    doc = np.repeat(np.arange(len(sets)), [int(u.sum()) for u in units])
    element = np.concatenate([np.repeat(e, u) for (e, _), u in zip(sets, units)])
    unit = np.concatenate([np.arange(u.sum()) - np.repeat(np.cumsum(u) - u, u) for u in units])
    part = np.minimum(1.0, np.concatenate([np.repeat(w, u) for (_, w), u in zip(sets, units)]) - unit)
    strip = mix(element + mix(unit.astype(np.uint64) + U64(77)))
    reach = boost * (k * np.log(k) + 2 * k) / np.array([w.sum() for _, w in sets])
    slot, rank, name = [], [], []
    live, ends = np.arange(len(doc)), reach[doc]  # units whose strips reach this far; they only become fewer
    region = 0
    while True:
        low = float(RANKS[region]) if region < len(RANKS) else float(region - len(RANKS) + 2)
        high = float(RANKS[region + 1]) if region + 1 < len(RANKS) else low + 1
        if not (further := ends > low).all():
            live, ends = live[further], ends[further]
        if not len(live):
            break
        cell = mix(strip[live] + mix(np.array([region], np.uint64)))
        darts = np.searchsorted(_poisson(high - low), (cell >> U64(11)).astype(float) / (1 << 53))
        which = np.repeat(np.arange(len(live)), darts)
        number = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[which] + (number.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15))
        height = (mix(dart + U64(1)) >> U64(11)).astype(float) / (1 << 53)
        hits = height < part[live[which]]
        dart, own = dart[hits], doc[live[which[hits]]]
        slot.append(own * k + (mix(dart + U64(2)) % U64(k)).astype(np.int64))
        rank.append(low + (dart >> U64(11)).astype(float) / (1 << 53) * (high - low))
        name.append(dart)
        region += 1
    slot, rank, name = np.concatenate(slot), np.concatenate(rank), np.concatenate(name)
    order = np.lexsort((rank, slot))
    slots, first = np.unique(slot[order], return_index=True)
    out.reshape(-1)[slots] = mix(name[order[first]]) | U64(1)
    # A dart beyond the reach proves nothing about its coordinate's earliest.
    late = slots[rank[order[first]] >= reach[slots // k]]
    short = np.unique(np.concatenate([np.flatnonzero((out == 0).any(1)), late // k]))
    if len(short):
        out[short] = dart_signatures([sets[i] for i in short], k, boost * 2)
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit bucket for each band of each signature; bands never share a bucket."""
    rows = signatures.shape[1] // bands
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), bands)).copy()
    for r in range(rows):
        keys = mix(keys + signatures[:, r::rows][:, :bands])
    return keys.view(np.int64)


def sign(docs: DataFrame, multiset: bool = True) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, digest, bands`` (no bands for a text without words)."""

    def run(batches):
        for batch in batches:
            bands = []
            for texts in text_chunks(batch.column(2)):
                found = shingles(texts)
                some = [i for i, x in enumerate(found) if len(x)]
                keys = band_keys(dart_signatures([weighted(found[i], multiset) for i in some], BANDS * ROWS))
                own = [None] * len(found)
                for i, row in zip(some, keys):
                    own[i] = row
                bands += own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])

    return docs.select("doc_id", text_digest("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def shingle_sets(texts: DataFrame, multiset: bool) -> DataFrame:
    """``node, text`` -> ``node, elements``: 64-bit names of the shingles, sorted; a repeat has a name of its own in a multiset."""

    def run(batches):
        for batch in batches:
            out = []
            for names in text_chunks(batch.column(1)):
                for found in shingles(names):
                    elements, counts = np.unique(found, return_counts=True)
                    if multiset:
                        turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        elements = mix(np.repeat(elements, counts) + turn.astype(np.uint64))
                    out.append(np.unique(elements).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "elements"])

    return texts.select("node", "text").mapInArrow(run, "node long, elements binary")


def shared_elements(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements every set on the left shares with every one on the right."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def cells(sets):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        known = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[known], kind="stable")
        return row[known][order], at[known][order]

    (row_a, at_a), (row_b, at_b) = cells(left), cells(right)
    total = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(common), COLUMNS):
        parts = []
        for row, at, n in ((row_a, at_a, len(left)), (row_b, at_b, len(right))):
            lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(common) - begin)), np.float32)
            part[row[lo:hi], at[lo:hi] - begin] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def _across(similarity: float):
    def run(key, pdf):
        asks, others = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        if not len(asks) or not len(others):
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        left, right = ([np.frombuffer(x, np.uint64) for x in side["elements"]] for side in (asks, others))
        shared = shared_elements(left, right).astype(float)
        together = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - shared
        near = (shared > 0) & (shared >= similarity * together - 1e-9)
        one, two = asks["class"].to_numpy(), others["class"].to_numpy()
        i, j = np.nonzero(near & (one[:, None] != two))
        # The classes that these links join, as a forest; the links themselves stay here.
        src, dst = contracted(np.maximum(one[i], two[j]), np.minimum(one[i], two[j]))
        return pd.DataFrame({"src": src, "dst": dst})

    return run


def links_across(named: DataFrame, texts: DataFrame, similarity: float, multiset: bool = True) -> DataFrame:
    """``src, dst``: classes to join, since a bucket has two texts of them with at least ``similarity``, from ``named(bucket, node, class)``.

    In each bucket the members outside its largest class ask, and meet all
    members; members of one class never meet, so a bucket of one class costs
    nothing. Both sides are dealt into blocks of about BLOCK, and every pair of
    blocks is one group, so no group grows with its bucket. The shingles of whole
    texts are compared there, and only a forest of classes leaves a group.
    """
    counts = named.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    mixed = mixed.select("bucket", "size", F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("s"), F.expr(f"cast(ceil((size + main.n) / {BLOCK}) as int)").alias("t"), F.col("main.class").alias("main"))
    mixed = materialise(mixed, "minhash-open")
    open_ = materialise(join_by_weight(named, mixed, ["bucket"], "size").withColumn("minor", F.col("class") != F.col("main")), "minhash-mixed")
    sets = shingle_sets(texts.join(open_.select("node").distinct().hint("merge"), "node", "left_semi"), multiset)
    met = open_.join(sets, "node")
    columns = ["bucket", "node", "class", "elements"]
    asks = F.when(F.col("minor"), F.expr("transform(sequence(0, s - 1), q -> struct(true as ask, cast(pmod(xxhash64(7, node), t) as int) as p, q as q))"))
    others = F.expr("transform(sequence(0, t - 1), p -> struct(false as ask, p as p, cast(pmod(xxhash64(node), s) as int) as q))")
    dealt = met.select(*columns, F.inline(F.concat(others, F.coalesce(asks, F.expr("array()").cast("array<struct<ask:boolean,p:int,q:int>>")))))
    found = materialise(dealt.groupBy("bucket", "p", "q").applyInPandas(_across(similarity), "src long, dst long").distinct(), "minhash-links")
    forget(mixed, open_)
    return found


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, multiset: bool = True) -> DataFrame:
    """``pairs(a, b)`` whose texts (``texts(node, text)``) have at least ``similarity``, as ``src, dst``."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, known = None, None
        for batch in batches:
            keep = []
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                nodes, left = part.column(1).to_pylist(), shingles(part.column(2).to_pylist())
                right_texts = part.column(3)
                for i, found in enumerate(left):
                    if nodes[i] != last:  # rows come sorted by b, so its shingles serve many rows
                        last, known = nodes[i], weighted(shingles([right_texts[i].as_py()])[0], multiset)
                    e, w = weighted(found, multiset)
                    _, at, bt = np.intersect1d(e, known[0], assume_unique=True, return_indices=True)
                    common = np.minimum(w[at], known[1][bt]).sum()
                    keep.append(bool(common > 0 and common >= similarity * (w.sum() + known[1].sum() - common) - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "src long, dst long")


def near_classes(docs: DataFrame, similarity: float = 0.8, multiset: bool = True) -> DataFrame:
    """``doc_id, class_id, digest`` for each row of ``docs(doc_id, text)``; class_id = smallest doc_id of its class.

    Similarity is the weighted Jaccard similarity of the shingles, a shingle
    weighing as often as it occurs, or without ``multiset`` once.
    Equal texts meet first and go on as one. In each bucket every text is
    compared with the bucket's first; then, in buckets that still hold several
    classes, texts of different classes are compared, in blocks, so no link found
    by the bands is lost, while a bucket of one class costs its size.
    Texts without words link with nothing; rows without a doc_id get no class.
    doc_id is taken to identify a text: different texts under one id are put into
    one class, and the one of the smallest digest stands for them where texts are
    verified. Other columns are not looked at; an empty table gives an empty result.
    """
    signed = materialise(sign(docs.where("doc_id is not null"), multiset), "minhash-signed")
    worded = signed.where("bands is not null")
    unique = materialise(worded.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "minhash-unique")
    entries = unique.select("node", F.explode("bands").alias("bucket"))
    heads = materialise(entries.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1"), "minhash-heads")
    members = materialise(join_by_weight(entries, heads, ["bucket"], "size"), "minhash-buckets")
    starred = materialise(members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "minhash-pairs")
    wanted = members.select("node").distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min_by("text", text_digest("text")).alias("text"))
    texts = materialise(texts, "minhash-texts")
    links = materialise(verified(starred, texts, similarity, multiset), "minhash-links")
    classes = connected_components(links, "minhash-classes")

    named = members.where("size > 2").join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("class"))
    more = links_across(named, texts, similarity, multiset)
    if more.limit(1).count():
        # ``more`` names classes; a text that is alone names its class itself.
        known = classes.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        classes = connected_components(known.unionByName(more), "minhash-classes")
    forget(heads, members, starred, texts, links, more)
    named = unique.select("digest", "node").join(classes, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    told = worded.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "digest")
    alone = signed.where("bands is null").select("doc_id", F.col("doc_id").alias("class_id"), "digest")
    return told.unionByName(alone).unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), text_digest("text").alias("digest")))


def near_query(docs: DataFrame) -> DataFrame:
    return near_classes(docs.select("doc_id", "text")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each class, the one of the smallest doc_id; all columns stay.

    Rows repeated with one doc_id and text count as one document; rows without a
    doc_id, which have no class, stay.
    """
    kept = near_classes(docs.select("doc_id", "text"), similarity).where("doc_id = class_id").select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest_kept")).distinct()
    rows = docs.withColumn("__digest", text_digest("text"))
    chosen = rows.join(kept, (F.col("doc_id") == F.col("__doc")) & F.col("__digest").eqNullSafe(F.col("__digest_kept")), "left_semi").dropDuplicates(["doc_id", "__digest"])
    return chosen.unionByName(rows.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
