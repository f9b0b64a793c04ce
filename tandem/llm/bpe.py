"""Byte-level BPE encoding and decoding with exact merges in linear time.

A token sequence is the merge result of its bytes exactly if every two
neighbours stay apart when the merges run over just those two. So a piece is
covered greedily with the longest token at each place, stepping back to a
shorter one where neighbours would merge differently. One walk of an
Aho-Corasick automaton over the piece, bytes mapped to Latin-1, gives the longest
token at each place; whether two tokens may stand together is remembered per pair.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries a worker remembers before it starts afresh; results never depend on it.
MEMO_ENTRIES = 300_000
NEVER = 1 << 60
#: Texts that a worker returns at once.
SLICE = 256
#: Longer pieces are encoded each time they occur.
MEMO_BYTES = 64
#: Fixed value: the characters of Unicode's White_Space property, for a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words with at most one leading space, and runs of white space. No piece of the
#: byte-level patterns reaches over the edges of these, so each can be split alone.
WORDS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class BytePairEncoder:
    """Encodes pieces of text by the ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if self.merge(token) == [rank]:  # a token its own bytes do not merge into can only be a whole piece
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.cell = {rank: np.array([rank], "<u4").tobytes() for rank in self.token}
        self.size = {rank: len(token) for rank, token in self.token.items()}
        self.pairs: dict[int, bool] = {}
        self.base = max(self.token, default=0) + 1
        self.shorter_of: dict[int, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merges one by one; only for the short strings of one or two tokens."""
        parts, rank = [piece[i : i + 1] for i in range(len(piece))], self.rank
        costs = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < NEVER:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank.get(parts[at - 1] + parts[at], NEVER)
            if at < len(costs):
                costs[at] = rank.get(parts[at] + parts[at + 1], NEVER)
        return [rank[p] for p in parts]

    def may_follow(self, pair: int) -> bool:
        """Whether the two tokens stay apart when merged together; remembered."""
        if len(self.pairs) > MEMO_ENTRIES:
            self.pairs.clear()
        left, right = divmod(pair, self.base)
        known = self.pairs[pair] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def longest(self, text: str) -> list[int]:
        """The longest token that begins at each place, by one walk of the automaton over ``text``.

        Matches come in the order of their ends, so the last one that begins at a
        place is the longest.
        """
        found, size = [-1] * len(text), self.size
        for end, token in self.automaton.iter(text):
            found[end + 1 - size[token]] = token
        return found

    def shorter(self, token: int) -> int:
        """The longest token that begins ``token`` and is not it, or -1; remembered."""
        if (known := self.shorter_of.get(token)) is None:
            known = self.shorter_of[token] = next(iter(self.longest(self.token[token][:-1].decode("latin-1"))), -1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n, size = len(piece), self.size
        pairs, base = self.pairs, self.base
        longest = self.longest(piece.decode("latin-1"))
        dead: set[int] = set()  # places from which no valid covering goes on
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:
            end = at + size[token]
            if end not in dead:
                fits = last < 0 or pairs.get(pair := last * base + token)
                if fits or (fits is None and self.may_follow(pair)):
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter(token)
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = self.shorter(token)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        ids = b"".join([self.cell[x] for x in self.encode_piece(piece.encode())])
        return self.remember(self.pieces, piece, ids)

    def word(self, word: str) -> bytes:
        known, piece = self.pieces.get, self.piece
        ids = b"".join([known(p) or piece(p) for p in self.split(word)])
        return self.remember(self.words, word, ids)

    @staticmethod
    def remember(memo: dict, key: str, ids: bytes) -> bytes:
        if len(key) <= MEMO_BYTES:
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            memo[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, word = self.words.get, self.word
        return b"".join([known(w) or word(w) for w in WORDS.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One per Python worker, kept between tasks."""
    return BytePairEncoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``token_ids`` (packed little-endian uint32).

    Whole texts, split by ``pattern``; a null text counts as empty and has no
    ids. With ``decoded``, the same workers also turn the ids back into bytes.
    No shuffle; memory is one Arrow batch and the bounded memo.
    """
    if clash := {"n_tokens", "token_ids", "decoded"} & set(keep):
        raise ValueError(f"these columns would stand twice in the result: {sorted(clash)}")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    names = [*keep, "n_tokens", "token_ids", *["decoded"] * decoded]

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                ids = [enc.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                columns = [*part.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([enc.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{schema}, n_tokens long, token_ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the bytes its ids stand for (null ids: null)."""
    names = encoded.columns

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            found = batch.column(names.index(ids)).to_pylist()
            raw = pa.array([None if x is None else enc.decode(x) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, repeated rows too; an empty table gives an empty result."""
    both = encode(docs, path, pattern, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
