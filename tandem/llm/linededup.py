"""Removal of repeated passages by chunks of lines that the content alone defines. Native functions only.

A gap between two lines is a boundary if a hash of the line before it or of the
line after it says so; the text's ends are boundaries too. The hashes have 64
bits, and each bit is a rule of its own with its own boundaries, so that a
passage of two or more lines is cut out whole by some of them wherever it
stands: its edges follow from its own lines. A chunk is what lies between two
successive boundaries of a rule: of 2 to LINES lines, with words on the first and
the last, and CHARS characters at least on lines with words; or one line of over
LONG_WORDS words. A chunk that occurs more than once in the corpus is kept at its first
occurrence (by doc_id, then place) and removed elsewhere, once its bytes are
compared. Blank lines, brackets, separators and other short lines make no chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_by_weight, key_filter, materialise

#: A single line of more words than this is a passage of its own.
LONG_WORDS = 50
#: Lines of a chunk at most (what a rule cuts longer, others cut shorter), characters at least on its lines with letters or digits.
LINES, CHARS = 16, 80
KEYS = ["h", "n"]


def _occurrences(docs: DataFrame, long_words: int, chars: int) -> DataFrame:
    """``doc_id, key, at, n, h`` of each chunk of ``n`` lines from line ``at`` on (from 0), with its hash; no text."""
    rows = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    # Each word but the last takes two characters at least, so short lines need no pattern; without the anchor it is tried at every character.
    long = f"length(line) > {2 * long_words} and line rlike '^\\\\s*+(?:\\\\S++\\\\s++){{{long_words}}}\\\\S'"
    lines = f"transform(split(text, '\n', -1), line -> struct(xxhash64(line) as h, if(line rlike '[\\\\p{{L}}\\\\p{{N}}]', length(line), 0) as w, {long} as long))"
    # A bit of gap i is set if its rule cuts there.
    gaps = "concat(array(-1L), transform(slice(e, 2, size(e)), (y, i) -> xxhash64(1, e[i].h) | xxhash64(2, y.h)), array(-1L))"
    # Bits of c[a]: rules that cut before line a and nowhere in the next k lines; those that cut then make a chunk.
    further = "transform(sequence(0, size(e) - k), a -> s.c[a] & ~m[a + k - 1])"
    ended = "filter(transform(c, (x, a) -> if((x & m[a + k]) <> 0, struct(a as at, k as n), null)), x -> x is not null)"
    cut = f"""aggregate(if(size(e) < 2, cast(array() as array<int>), sequence(2, least({LINES}, size(e)))), named_struct('c', slice(m, 1, size(e)), 'f', cast(array() as array<struct<at:int,n:int>>)),
        (s, k) -> transform(array({further}), c -> named_struct('c', c, 'f', concat(s.f, {ended})))[0], s -> s.f)"""
    worded = f"filter({cut}, x -> e[x.at].w > 0 and e[x.at + x.n - 1].w > 0 and aggregate(slice(e, x.at + 1, x.n), 0, (s, y) -> s + y.w) >= {chars})"
    chunks = f"transform({worded}, x -> struct(x.at as at, x.n as n, xxhash64(transform(slice(e, x.at + 1, x.n), y -> y.h)) as h))"
    single = "filter(transform(e, (x, i) -> if(x.long, struct(i as at, 1 as n, x.h as h), null)), x -> x is not null)"
    # Lines and gaps are bound to a lambda's name, or they would be made again for each use.
    bound = f"transform(array({lines}), e -> transform(array({gaps}), m -> concat({chunks}, {single}))[0])[0]"
    return rows.select("doc_id", F.xxhash64("text").alias("key"), F.inline(F.expr(bound)))


def _held(docs: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    """``row`` (all columns of ``docs`` as one) with what ``per_text`` (``doc_id, key, ...``) has of its text.

    Only texts that pass a filter of bounded size are shuffled; with ``left`` the
    others come along as they lie.
    """
    named = per_text.select(F.col("doc_id").alias("own_doc"), F.col("key").alias("own_key"), *[c for c in per_text.columns if c not in ("doc_id", "key")])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc"), F.xxhash64("row.text").alias("key"))
    passing, others = key_filter(rows, F.xxhash64("doc", "key"), per_text.select(F.xxhash64("doc_id", "key").alias("filter_key")))
    met = passing.join(named.hint("merge"), (F.col("doc") == F.col("own_doc")) & (F.col("key") == F.col("own_key")), how).drop("doc", "own_doc", "own_key")
    return met if how == "inner" else met.unionByName(others.drop("doc"), allowMissingColumns=True)


def _unlike(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``h, n`` of chunks in ``marked`` whose occurrences are not all of the same bytes."""
    places = marked.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "n", "h")).alias("places"))
    text = "transform(array(split(row.text, '\n', -1)), e -> transform(places, p -> struct(p.h as h, p.n as n, array_join(slice(e, p.at + 1, p.n), '\n') as bytes)))[0]"
    chunks = _held(docs, materialise(places, "line-places"), "inner").select(F.inline(F.expr(text)))
    return chunks.distinct().groupBy(*KEYS).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*KEYS)


def repeated_passages(docs: DataFrame, long_words: int = LONG_WORDS, chars: int = CHARS) -> DataFrame:
    """``doc_id, key, gone``: the runs of lines to remove from each text, as sorted ``at, n`` that do not overlap.

    Counting moves hashes only, added up before the shuffle, so a passage in a
    third of all documents is one row a task, and stays where it lies to be
    marked. Chunks of one text that lie together where they stand first are one
    run. Of runs that overlap but stand first in different places the longest
    goes and what is left of the others stays, since they may never have stood
    together; if none is longest, all stay.
    """
    found = materialise(_occurrences(docs, long_words, chars), "line-found")
    here = F.struct("doc_id", "key", "at")
    counted = materialise(found.groupBy(*KEYS).agg(F.count("*").alias("times"), F.min(here).alias("first")).where("times > 1"), "line-counts")
    marked = materialise(join_by_weight(found, counted, KEYS, "times").select("doc_id", "key", "at", *KEYS, "first"), "line-chunks")
    forget(found, counted)
    unlike = materialise(_unlike(docs, marked), "line-unlike")
    gone = marked.where(here != F.col("first")).join(unlike, KEYS, "left_anti").withColumns({"end": F.expr("at + n"), "shift": F.expr("first.at - at")})

    text = ["doc_id", "key"]
    source = [*text, "first.doc_id", "first.key", "shift"]
    before = Window.unboundedPreceding
    along = Window.partitionBy(*source).orderBy("at", "end")
    apart = F.coalesce(F.col("at") > F.max("end").over(along.rowsBetween(before, -1)), F.lit(True))
    runs = gone.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(along)).groupBy(*[F.col(c).alias(f"by{i}") for i, c in enumerate(source)], "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    runs = runs.groupBy(F.col("by0").alias("doc_id"), F.col("by1").alias("key")).agg(F.array_sort(F.collect_set(F.struct("at", F.expr("end - at").alias("n")))).alias("runs"))
    weaker = "exists(runs, q -> q <> r and q.n >= r.n and q.at < r.at + r.n and r.at < q.at + q.n)"
    return runs.select(*text, F.expr(f"filter(runs, r -> not {weaker})").alias("gone")).where("size(gone) > 0")


def dedup_lines(docs: DataFrame, long_words: int = LONG_WORDS, chars: int = CHARS) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``removed_chunks`` (unbroken runs of removed lines) and ``removed_lines``.

    All columns and rows stay, but for columns of these two names, which are
    replaced; only ``doc_id`` and ``text`` are read. A null text stays null and an
    empty one empty; a text whose every line is removed becomes empty. Rows equal
    in doc_id and text count as one document, so they get the same result; rows
    without a doc_id keep their text.
    """
    rows = _held(docs, materialise(repeated_passages(docs, long_words, chars), "line-gone"), "left")
    # What stays lies between neighbouring runs.
    end = "coalesce(get(gone, i - 1).at + get(gone, i - 1).n, 0)"
    left = f"flatten(transform(array(split(row.text, '\n', -1)), e -> transform(sequence(0, size(gone)), i -> slice(e, {end} + 1, coalesce(get(gone, i).at, size(e)) - {end})))[0])"
    out = [F.expr(f"if(gone is null, row.text, array_join({left}, '\n'))").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    return rows.select(
        *out,
        F.expr(f"if(gone is null, 0, size(filter(transform(gone, (g, i) -> i = 0 or g.at > {end}), x -> x)))").alias("removed_chunks"),
        F.expr("if(gone is null, 0, aggregate(gone, 0, (s, g) -> s + g.n))").alias("removed_lines"),
    )


def line_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", "removed_chunks", "removed_lines")
