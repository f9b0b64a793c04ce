"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Every partition packs its pieces by best-fit decreasing and compares its bin
count with a lower bound. Partitions whose count equals the bound are proven
optimal and stay. The others exchange documents: the pieces of their open bins
are dealt together into new partitions and packed again, until no gap is left
or a round saves nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 2048
#: Pieces a partition packs at once; the memory of a packing task is bounded by it.
GROUP_PIECES = 20_000
#: Fixed value: lower-case letters that canonical composition and the vocabulary's lower-casing leave as they are, in UTF-8.
LETTER = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
LETTERS = re.compile(LETTER + rb"+").fullmatch
#: Words of those and of ASCII without capitals.
PLAIN = re.compile(rb"(?:[\x00-\x40\x5b-\x7f]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Fixed value: how the vocabulary's pre-tokeniser splits such words.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|" + LETTER + rb"+|[0-9]|[^a-z0-9\xc3]+").findall
#: Fixed value: the marks that canonical composition joins to ASCII letters.
COMBINING = regex.compile("[\u0300-\u036f]").search
#: Words and pieces a worker remembers before it starts afresh; results never depend on it.
MEMO_ENTRIES = 450_000
#: What stands between pieces that are tokenised together, and how many those are.
MARK, JOINED = b"|", 32
SCHEMA_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Token ids of whole texts, special tokens included where a text spells them; equal words are tokenised once.

    Splitting at ASCII white space is safe: the vocabulary drops white space and
    no piece reaches over it. Only ASCII letters are lower-cased here, and none that
    a combining mark may join, so that the tokenizer's own normalisation decides
    everything else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for _, t in special.values()):
            raise ValueError("special tokens are only known as they are written")
        self.special = {text: np.array([i], "<u4").tobytes() for text, (i, _) in special.items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # Texts are parted at these before words are lower-cased, which may make new ones of what was none.
        self.tokenizer.encode_special_tokens = True
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        # The vocabulary's normaliser and pattern leave a piece of a plain word as it is; the model is shared.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        if len(self.words) + len(words) > MEMO_ENTRIES:
            self.words.clear()
        # A plain word falls into pieces exactly as the vocabulary splits it, letters alone into one; any other is one piece here.
        pieces = {w for w in words if LETTERS(w)}
        rest = [w for w in words if w not in pieces]
        split = {w: PIECES(w) for w in rest if PLAIN(w)}
        pieces.update(p for parts in split.values() for p in parts if p not in self.words)
        self.tokenise(list(pieces), self.plain)
        self.tokenise([w for w in rest if w not in split], self.tokenizer)
        for word, parts in split.items():
            self.words[word] = b"".join([self.words[p] for p in parts])

    def tokenise(self, pieces: list[bytes], tokenizer) -> None:
        """Many pieces in one string, with a mark between them whose single id parts the ids again."""
        plain = [p for p in pieces if MARK not in p]
        joined = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        found = tokenizer.encode_batch_fast([b" | ".join(some).decode() for some in joined], add_special_tokens=False)
        flat: list[int] = []
        for encoding in found:
            flat += encoding.ids
            flat.append(self.mark)
        ids = np.array(flat, "<u4")
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
        if len(ends) != len(plain):
            raise ValueError("the mark is not one token of its own")
        self.words.update(zip(plain, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]))
        for p in pieces:
            if MARK in p:
                self.words[p] = np.array(tokenizer.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens stand at the odd places of its parts."""
        parts = [self.parts.split(t) if t and any(s in t for s in self.special) else [t or ""] for t in texts]
        split = [self.split(p) for own in parts for p in own[::2]]
        found = [list(map(self.words.get, words)) for words in split]
        lacking = [list(compress(range(len(ids)), map(is_, ids, repeat(None)))) for ids in found]
        if new := {words[i] for words, places in zip(split, lacking) for i in places}:
            self.learn(list(new))
            for words, ids, places in zip(split, found, lacking):
                for i in places:
                    ids[i] = self.words[words[i]]
        plain = iter(found)
        for own in parts:
            yield b"".join(self.special[p] if i % 2 else b"".join(next(plain)) for i, p in enumerate(own))

    @staticmethod
    def split(text: str) -> list[bytes]:
        """Words in ASCII lower case; where a text has combining marks, only its ASCII words are."""
        raw = text.encode()
        # All of those marks begin with one of two bytes, which are sought much faster.
        if raw.isascii() or (b"\xcc" not in raw and b"\xcd" not in raw) or not COMBINING(text):
            return raw.lower().split()
        return [w.lower() if w.isascii() else w for w in raw.split()]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and a final 0, cut only if longer than ``capacity``.

    A null text counts as empty: one piece of one id. No shuffle.
    """

    def run(batches):
        enc = tokenizer(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA_PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the fullest bin with room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    open_rooms = 0  # bit r: some bin has r left
    bins, offsets, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        if fitting := open_rooms >> size:
            left = size + (fitting & -fitting).bit_length() - 1
            target = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            target, left, count = count, capacity, count + 1
        bins[i], offsets[i] = target, capacity - left
        left -= size
        if left:
            room[left].append(target)
            open_rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the threshold and rounding dual-feasible functions, a proven least bin count.

    Each maps lengths so that whatever fits into one bin still sums to at most
    one; so the sum over all lengths, rounded up, bounds the bins from below.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    # Threshold t: lengths over capacity - t count as a whole bin, those under t as nothing.
    total, items = np.cumsum(counts * size), np.cumsum(counts)
    for t in range(1, capacity // 2 + 1):
        whole = items[-1] - items[capacity - t]
        rest = total[capacity - t] - total[t - 1]
        best = max(best, int(whole - (-rest // capacity)))
    # Rounding by k: floor((k + 1) * x / capacity) / k, exact multiples keep their share.
    # Sums are in units of 1 / (k * capacity), so they stay whole numbers.
    for k in range(1, 65):
        scaled = (k + 1) * size
        units = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * units).sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy().astype(np.int64)
        # Longest first, ties by the piece; where an id is null, by its place.
        ties = [pc.fill_null(table[c], -1).to_numpy() for c in ("place", "start", "piece", "doc_id")]
        order = np.lexsort((*ties, -lengths))
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bins[order], offsets[order] = best_fit_decreasing(lengths[order], capacity)
        gap = int(bins.max()) + 1 - lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        for name, column in (("bin", bins), ("offset", offsets), ("gap", np.full(len(bins), gap)), ("fill", fill[bins])):
            table = table.append_column(name, pa.array(column, pa.int64()))
        return table

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``certified`` to ``doc_id, piece, start, length, ids_crc32``.

    Full pieces are sequences of their own. The others are dealt by a hash of
    the row and its place into groups of about ``group_pieces``, so neither a hot
    document nor a row that is repeated often meets in one group; only ids and
    lengths move. Groups whose count exceeds their bound exchange what lies in
    bins that are not full, until no gap is left, one such group is left, or a
    round saves nothing. ``certified``: the bin is full, or its group needs no
    fewer bins. A sequence_id holds the round, the group and the bin; full
    pieces have negative ones. An empty table gives an empty result; rows
    repeated exactly are packed as often as they occur.
    """
    names = pieces.columns
    # The place is written with the row, so a lost executor cannot deal it anew.
    pieces = materialise(pieces.withColumn("place", F.monotonically_increasing_id()), "pack-pieces")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", grp long, bin long, offset long, gap long, fill long"
    certified = (F.col("gap") <= 0) | (F.col("fill") == capacity)

    def packed(rows: DataFrame, count: int, rnd: int) -> DataFrame:
        groups = max(1, -(-count // group_pieces))
        dealt = rows.select(*names, "place", F.pmod(F.xxhash64(F.lit(rnd), *names, "place"), F.lit(groups)).alias("grp"))
        found = dealt.groupBy("grp").applyInArrow(_pack(capacity), schema)
        number = (F.lit((rnd + 1) << 51) + (F.col("grp") * (1 << 20)) + F.col("bin")).alias("sequence_id")
        return materialise(found.withColumn("sequence_id", number).withColumn("certified", certified), "pack-round")

    def bins(rows: DataFrame) -> int:
        # each bin has one piece at offset 0
        return rows.where("offset = 0").count()

    rest = pieces.where(F.col("length") < capacity)
    now, settled, rnd = packed(rest, rest.count(), 0), [], 0
    while True:
        loose = now.where("not certified")
        size = loose.agg(F.count("*").alias("rows"), F.countDistinct("grp").alias("groups")).first()
        if size["groups"] < 2:
            break
        rnd += 1
        again = packed(loose, size["rows"], rnd)
        if bins(again) >= bins(loose):
            break
        settled.append(now.where("certified"))
        now = again
    full = pieces.where(F.col("length") >= capacity).select(*names, (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    for rows in [*settled, now]:
        full = full.unionByName(rows.select(*names, "sequence_id", "offset", "certified"))
    return full


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Tokenise and pack a document table; the columns of the contract."""
    return pack(tokenised_pieces(docs, path))
