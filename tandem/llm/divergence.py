"""How far the sources of a language differ in their words, from mergeable byte tries.

A task counts the terms of its documents in a trie for each language, whose
leaves hold a count for each source, and gives the leaves in the order of their
bytes; a trie that grows too large is given out and begun anew, as tries merge.
Tries merge by ranges of their prefixes: a range exchange puts all leaves of a
term into one task, however many terms begin alike. Terms that are kept flow on
in order: past a matrix that adds up pairs of sources, and past a limited ranking
of each source's own terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_by_weight, materialise

#: Documents of a language that a term must be in, and terms listed of a source.
MIN_DOCS, LISTED = 10, 10
#: Counters that a task holds before it gives its tries out; results never depend on it.
COUNTERS = 1_200_000
#: Sources on each side of a matrix of pairs.
BLOCK = 64
#: Bytes of terms in lower case; every other byte parts them.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAF = "struct<source:string,n:bigint>"


class RadixTrie:
    """Byte strings as paths, equal beginnings shared; each has a number, in the order of coming."""

    def __init__(self):
        self.root = [b"", -1, {}]  # edge, number of the string that ends here, nodes below by first byte (None: none)
        self.size = 0

    def add(self, term: bytes) -> int:
        node, at, end = self.root, 0, len(term)
        while at < end:
            if node[2] is None:
                node[2] = {}
            below = node[2].get(term[at])
            if below is None:  # a new leaf
                node[2][term[at]] = [term[at:], self.size, None]
                self.size += 1
                return self.size - 1
            edge = below[0]
            size = len(edge)
            if size > 1 and term[at : at + size] != edge:
                size = next(i for i in range(1, size) if term[at + i : at + i + 1] != edge[i : i + 1])
                below[:] = [edge[:size], -1, {edge[size]: [edge[size:], below[1], below[2]]}]
            node, at = below, at + size
        if node[1] < 0:
            node[1] = self.size
            self.size += 1
        return node[1]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """All strings with their numbers, in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            start, node = stack.pop()
            path = start + node[0]
            if node[1] >= 0:
                yield path, node[1]
            if node[2]:
                stack += [(path, node[2][b]) for b in sorted(node[2], reverse=True)]


class Counts:
    """Terms of one language: a trie, and for its leaves the documents and the occurrences by source."""

    def __init__(self):
        self.docs, self.sources = Counter(), defaultdict(Counter)

    def add(self, source: str, text: bytes) -> None:
        """A document is a term of no letters in its source; so sources without terms are known too."""
        terms = text.translate(TERMS).split()
        self.sources[source].update(terms)
        self.sources[source][b""] += 1
        self.docs.update(set(terms))

    def size(self) -> int:
        return sum(map(len, self.sources.values()))

    def leaves(self, lang: str) -> Iterator[pa.RecordBatch]:
        """``lang, term, docs, counters`` of each leaf, in the order of the terms' bytes."""
        trie = RadixTrie()
        number = {term: trie.add(term) for term in (b"", *self.docs)}
        terms, order = zip(*trie.walk())
        rank = np.empty(trie.size, np.int64)
        rank[list(order)] = np.arange(trie.size)
        names = list(self.sources)
        at = rank[[number[t] for s in names for t in self.sources[s]]]
        n = np.array([n for s in names for n in self.sources[s].values()], np.int64)
        source = np.repeat(np.arange(len(names)), [len(self.sources[s]) for s in names])
        sort = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=trie.size))
        counters = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(source[sort])), pa.array(n[sort])], ["source", "n"])
        columns = {
            "lang": pa.array([lang] * trie.size),
            "term": pa.array([t.decode() for t in terms]),
            "docs": pa.array([self.docs[t] for t in terms], pa.int64()),
            "counters": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), counters),
        }
        whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        yield from (whole.slice(i, 10_000) for i in range(0, whole.num_rows, 10_000))


def leaves(docs: DataFrame) -> DataFrame:
    """``lang, term, docs, counters`` of each task's tries. Null text, lang and source read as ''. No shuffle."""

    def run(batches):
        tries: dict[str, Counts] = defaultdict(Counts)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for lang, source, text in zip(*[c.to_pylist() for c in batch.slice(i, 256).columns]):
                    tries[lang].add(source, text)
                if sum(t.size() for t in tries.values()) > COUNTERS:
                    for lang in sorted(tries):
                        yield from tries[lang].leaves(lang)
                    tries.clear()
        for lang in sorted(tries):
            yield from tries[lang].leaves(lang)

    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*plain, F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"lang string, term string, docs long, counters array<{LEAF}>")


def merged_terms(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, part, term, source, n, total, first`` of the terms in at least ``min_docs`` documents of their language.

    ``part`` numbers the range of prefixes, ``total`` is the term's count in the
    language, and ``first`` marks one row of each term.
    """
    term = Window.partitionBy("lang", "term")
    here = found.where("term <> ''").repartitionByRange("lang", "term").withColumn("df", F.sum("docs").over(term)).where(F.col("df") >= min_docs)
    summed = here.select("lang", "term", F.inline("counters")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return summed.select("lang", F.spark_partition_id().alias("part"), "term", "source", "n", F.sum("n").over(term).alias("total"), F.row_number().over(term.orderBy("source")).alias("first")).withColumn("first", F.col("first") == 1)


def _share(count: str, all_counts: str) -> Column:
    """The share of ``count`` in billionths, smoothed; exact for any counts."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10)) * cast({count} + 2 as decimal(20))) div cast({all_counts} + 2 * v as decimal(20))")


def source_groups(found: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang, source, nn, v, big, code, blocks, rows``: every source of every language, with its counts over kept terms.

    One row a source, numbered by name in its language; the pairs of sources that
    are asked for are the square of these rows.
    """
    every = found.where("term = ''").select("lang", F.inline("counters")).select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("nn"), F.count("*").alias("rows"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("big"))
    named = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["nn", "rows", "v", "big"])
    by_lang = Window.partitionBy("lang")
    return named.withColumns({"code": F.row_number().over(by_lang.orderBy("source")) - 1, "blocks": F.expr(f"cast((count(*) over (partition by lang) + {block - 1}) div {block} as int)")})


def _pair_sums(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Sums over terms of what each two sources of a cell differ by; rows come by cell, those of no term first, then by term."""
    cell = None
    for batch in batches:
        lang, i, j, part = (batch.column(c).to_pylist() for c in ("lang", "i", "j", "part"))
        keys = list(zip(lang, i, j, part))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if cell is None or cell.key != keys[begin]:
                yield from [cell.sums(block)] if cell else []
                cell = Cell(keys[begin])
            cell.take(batch.slice(begin, end - begin))
    yield from [cell.sums(block)] if cell else []


class Cell:
    """Two blocks of sources over a range of terms."""

    def __init__(self, key: tuple):
        self.key, self.codes, self.zero, self.total = key, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.rest = None  # the rows of the last term, which the next batch may go on with
        self.terms = self.seen = 0  # terms of the range, and those that some source here has

    def take(self, batch: pa.RecordBatch) -> None:
        codes, share = batch.column("code").to_numpy().astype(np.int64), batch.column("share").fill_null(0).to_numpy()
        plain = batch.column("term").is_null().to_numpy(zero_copy_only=False)
        if plain.any():
            self.codes, self.zero = np.concatenate([self.codes, codes[plain]]), np.concatenate([self.zero, share[plain]])
            self.terms = int(batch.column("terms").to_numpy()[0])
            order = np.argsort(self.codes)
            self.codes, self.zero = self.codes[order], self.zero[order]
        rows = pa.table({"term": batch.column("term"), "code": codes, "share": share}).filter(pa.array(~plain))
        rows = pa.concat_tables([self.rest, rows]) if self.rest is not None else rows
        if rows.num_rows:
            terms = rows.column("term").combine_chunks().dictionary_encode()
            number = terms.indices.to_numpy()
            last = int(np.searchsorted(number, number[-1]))
            self.rest = rows.slice(last)
            self.add(number[:last], rows.slice(0, last))

    def add(self, number: np.ndarray, rows: pa.Table) -> None:
        """``number`` counts the terms of ``rows`` from 0 on."""
        if self.total is None:
            self.total = np.zeros((len(self.codes), len(self.codes)), np.int64)
        if len(number):
            terms = int(number[-1]) + 1
            shares = np.repeat(self.zero[:, None], terms, axis=1)
            shares[np.searchsorted(self.codes, rows.column("code").to_numpy()), number] = rows.column("share").to_numpy()
            self.count(shares)
            self.seen += terms

    def count(self, shares: np.ndarray, times: int = 1) -> None:
        for a in range(len(self.codes) - 1):
            apart = shares[a] - shares[a + 1 :]
            self.total[a, a + 1 :] += times * (apart * apart // (shares[a] + shares[a + 1 :])).sum(axis=1)

    def sums(self, block: int) -> pa.RecordBatch:
        if self.rest is not None:
            self.add(np.zeros(self.rest.num_rows, np.int64), self.rest)
        self.add(np.zeros(0, np.int64), pa.table({}))
        if self.terms > self.seen:  # only sources of other blocks have these
            self.count(self.zero[:, None], self.terms - self.seen)
        lang, i, j, _ = self.key
        a, b = np.triu_indices(len(self.codes), 1)
        # A cell of two blocks leaves the pairs inside a block to the cell of that block.
        asked = (self.codes[a] // block == i) & (self.codes[b] // block == j)
        a, b = a[asked], b[asked]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(self.codes[a]), pa.array(self.codes[b]), pa.array(self.total[a, b])], names=["lang", "a", "b", "value"])


def source_pairs(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang, source, item, value`` of each two sources of a language, in both directions.

    A term meets the sources in blocks: its rows are copied once per other block,
    so the work of a task is bounded and no pair of rows is formed. A source
    without a term of the range has the share of no occurrence there.
    """
    numbered = join_by_weight(kept.select("lang", "part", "term", "source", "n"), groups.select("lang", "source", "code", "blocks", "nn", "v", "rows"), ["lang", "source"], "rows")
    rows = numbered.select("lang", "part", "term", "code", "blocks", _share("n", "nn").alias("share"), F.lit(0).cast("long").alias("terms"))
    ranges = kept.groupBy("lang", "part").agg(F.count_if("first").alias("terms")).unionByName(groups.select("lang", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("terms")).distinct())
    none = groups.withColumn("none", F.lit(0)).select("lang", F.lit(None).cast("string").alias("term"), "code", "blocks", F.when(F.col("v") > 0, _share("none", "nn")).alias("share")).join(ranges, "lang")
    own = F.expr(f"cast(code div {block} as int)")
    cells = rows.unionByName(none).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = cells.select("lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "part", "term", "code", "share", "terms")
    keys = ["lang", "i", "j", "part"]
    sums = cells.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term")).mapInArrow(partial(_pair_sums, block=block), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.expr("array(struct(a as code, b as other), struct(b as code, a as other))")).alias("p"), "value").select("lang", "p.code", "p.other", "value")
    names = groups.select("lang", "code", "source")
    return both.join(names, ["lang", "code"]).join(names.select("lang", F.col("code").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "source", "item", "value")


def source_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the terms that each source has more often than its language, by how far."""
    rows = join_by_weight(kept.select("lang", "term", "source", "n", "total"), groups.select("lang", "source", "nn", "v", "big", "rows"), ["lang", "source"], "rows")
    rows = rows.select("lang", "source", F.col("term").alias("item"), _share("n", "nn").alias("p"), _share("total", "big").alias("q")).where("p > q")
    return rows.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def divergence_query(docs: DataFrame, min_docs: int = MIN_DOCS, listed: int = LISTED, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's other sources (``pair``) and its ``listed`` most telling terms (``term``).

    Null text, lang and source read as ''; only these three columns are read, and
    repeated rows count as often as they occur. A language without kept terms has
    pairs of value 0 and no terms; an empty table gives no rows.
    """
    found = materialise(leaves(docs), "divergence-leaves")
    kept = materialise(merged_terms(found, min_docs), "divergence-terms")
    groups = materialise(source_groups(found, kept, block), "divergence-sources")
    forget(found)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = source_terms(kept, groups).withColumn("rank", rank).where(F.col("rank") <= listed)
    pairs = source_pairs(kept, groups, block).withColumn("rank", rank)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
