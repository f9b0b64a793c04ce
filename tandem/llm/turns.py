"""Repair of conversations whose turns are missing, blank, repeated, cut short or out of order.

A conversation is read as a string of one character a row: its role and its
fault. Equal strings are solved once. A string's cheapest edits follow from
those of its two halves, between all states of the grammar, so the recursion is
as deep as the logarithm of its length, and halves that occur again are
remembered. The edits go back to the conversations by their string and are
replayed over the rows, which flow through sorted and are never gathered.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_weight, materialise

#: States of ``(s?(ua)+)?``: begun, a system row read, a user row read, an assistant row read.
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of a role, from each state where it may stand.
STEPS = {"s": {BEGUN: SYSTEM}, "u": {BEGUN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What edits cost, and the states in which a conversation may end with what must be inserted there.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
ENDS = {BEGUN: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: Character of a row that must go; other rows have their role's initial (``x`` for any other), upper case if cut short.
GONE = "d"
#: Strings up to this length, and so many of them, are remembered by a worker; results never depend on it.
MEMO_LENGTH, MEMO_ENTRIES = 64, 50_000
#: White space, and what ends a sentence.
SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"


def _after_inserts() -> dict[int, list[tuple[int, int, str]]]:
    """From each state, those reached by rows inserted before the next row: state, cost, edits. A state is passed once at most."""
    found = {}
    for state in range(4):
        chain, here, cost, edits = [], state, 0, ""
        while here not in [c[0] for c in chain]:
            chain.append((here, cost, edits))
            here, cost, edits = (ASSISTANT if here == USER else USER), cost + INSERT, edits + "I"
        found[state] = chain
    return found


AFTER_INSERTS = _after_inserts()


def _one(row: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest cost and least edits of one row between each two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    role, cut = row.lower(), CUT * (row != row.lower())
    for state, chain in AFTER_INSERTS.items():
        for here, paid, edits in chain:
            ways = [(here, DELETE, "D")]
            if row != GONE:
                if here in STEPS.get(role, {}):
                    ways.append((STEPS[role][here], KEEP + cut, "K"))
                ways += [(STEPS[r][here], REROLE + cut, "R") for r in "ua" if here in STEPS[r]]
            for to, cost, edit in ways:
                found = (paid + cost, edits + edit)
                best[state, to] = min(best.get((state, to), found), found)
    return best


def _between(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    """As ``_one``, of several rows, from their halves.

    Edits of a half end with those of its last row, so of two that cost the same
    neither begins the other, and the least of the whole is made of the least of
    the halves.
    """
    return _short(rows) if len(rows) <= MEMO_LENGTH else _halves(rows)


def _halves(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    if len(rows) == 1:
        return _one(rows)
    # Left halves of a power of two: long regular conversations share them.
    middle = 1 << (len(rows) - 1).bit_length() - 1
    left, right = _between(rows[:middle]), _between(rows[middle:])
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for (a, b), (cost, edits) in left.items():
        for c in range(4):
            if (b, c) in right and ((a, c) not in best or cost + right[b, c][0] <= best[a, c][0]):
                found = (cost + right[b, c][0], edits + right[b, c][1])
                best[a, c] = min(best.get((a, c), found), found)
    return best


_short = lru_cache(MEMO_ENTRIES)(_halves)


def cheapest_edits(signature: str) -> tuple[int, str]:
    """The least cost and, of the edits with it, the least string: Delete, Insert, Keep, Rerole by initial."""
    if not signature:
        return 0, ""
    found = _between(signature)
    return min((found[BEGUN, to][0] + cost, found[BEGUN, to][1] + edits) for to, (cost, edits) in ENDS.items() if (BEGUN, to) in found)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a fifth of the rows damaged by the checksum of their key; nulls read as one space, but a null turn stays.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 takes its stops, 3
    repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), space).alias(c) for c in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``rows`` with the text's digest, and the order of a conversation: turn (null first), then role and digest of the text."""
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    return rows, [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest")]


def signatures(rows: DataFrame) -> DataFrame:
    """``conv_id, signature, gaps, blank, duplicate, truncated, illegal`` of each conversation in ``rows``.

    Rows are taken by turn, null turns first, ties by role and then by the MD5
    of the text. A row's first fault counts: blank (nothing but white space),
    duplicate (role and text stand earlier), truncated (the last character that
    is no white space is none of ``.!?``). One exchange on the conversation; of
    each row it moves the digest, not the text. The rows of a conversation are
    sorted by Spark; gathered is one character of each.
    """
    rows, order = _ordered(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))
    end = F.right(F.expr(f"trim(TRAILING '{SPACES}' FROM text)"), F.lit(1))
    marked = rows.select("conv_id", "turn", "role", "digest", (end == "").alias("blank"), (~end.isin(*STOPS)).alias("cut"), F.left("role", F.lit(1)).alias("initial"))
    along = Window.partitionBy("conv_id").orderBy(*order)
    marked = marked.repartition("conv_id").withColumns({"place": F.row_number().over(along), "before": F.lag("initial").over(along)})
    marked = marked.withColumn("again", F.col("place") > F.min("place").over(Window.partitionBy("conv_id", "role", "digest")))
    marked = marked.withColumn("fault", F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated").otherwise(""))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    bad = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return marked.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", letter.alias("letter")))), lambda x: x["letter"]), "").alias("signature"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if(bad).alias("illegal"),
    )


def audits(rows: DataFrame) -> DataFrame:
    """``signatures`` with the least ``cost`` and its least ``audit``; each distinct signature is solved once."""

    def solve(batches):
        for batch in batches:
            found = [cheapest_edits(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "times", "cost", "audit"])

    read = materialise(signatures(rows), "turn-signatures")
    distinct = read.groupBy("signature").agg(F.count("*").alias("times"))
    solved = materialise(distinct.mapInArrow(solve, "signature string, times long, cost long, audit string"), "turn-audits")
    return join_by_weight(read, solved, ["signature"], "times").drop("times")


class Replay:
    """The edits of one conversation, applied to its rows as they come."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.done, self.place, self.system = conv_id, audit, 0, 0, 0

    def _put(self, turn, role, text, edit):
        self.place += 1
        return self.conv_id, self.place - 1, turn, role, text, edit

    def _due(self) -> str:
        """The role whose turn it is; after a kept system row the roles start anew."""
        return ("user", "assistant")[(self.place - self.system) % 2]

    def inserts(self):
        while self.audit[self.done : self.done + 1] == "I":
            self.done += 1
            yield self._put(None, self._due(), "", "I")

    def row(self, turn, role, text):
        yield from self.inserts()
        edit = self.audit[self.done]
        self.done += 1
        if edit == "R":
            yield self._put(turn, self._due(), text, edit)
        elif edit == "K":
            self.system = int(self.system or (self.place == 0 and role[:1] == "s"))
            yield self._put(turn, role, text, edit)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, edit`` of the repaired rows: the edits of ``audited`` replayed over ``rows``.

    Rows come out in order: the conversations of a partition one after the other,
    each by place (from 0). Inserted rows have no turn; null roles and texts read
    as one space. Rows and edits meet by an exchange on the conversation and flow
    past in order, so a task holds one batch and one string of edits.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows, order = _ordered(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))
    edits = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("string").alias("digest"))
    both = edits.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "digest"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order).select("conv_id", "kind", "turn", "role", "text")

    def run(batches):
        now = None
        for batch in batches:
            out, ids = [], batch.schema.field("conv_id").type
            for conv_id, what, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if what:
                    out += now.row(turn, role, text)
                else:
                    out += now.inserts() if now else ()
                    now = Replay(conv_id, text)
            yield _turns(out, ids)
        if now:
            yield _turns(list(now.inserts()), ids)

    return both.mapInArrow(run, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def _turns(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv_id": ids, "place": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over the rows that ``repaired`` gives, in its order: ``role:text`` joined by newlines, as they flow past."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, sha, begun = None, hashlib.sha256(), False
        for batch in batches:
            out = []
            for conv_id, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")]):
                if place == 0:
                    out += [(now, sha.hexdigest())] if begun else []
                    now, sha, begun = conv_id, hashlib.sha256(), True
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], batch.schema.field("conv_id").type), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field("conv_id").type), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_query(conversations: DataFrame) -> DataFrame:
    """Damage, audit and repair; one row per original conversation, also where no row is left."""
    rows = damage(conversations)
    audited = materialise(audits(rows), "turn-audited")
    ids = conversations.select("conv_id").distinct()
    out = digests(repaired(rows, audited))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = ids.alias("i").join(audited.alias("a"), F.col("i.conv_id").eqNullSafe(F.col("a.conv_id")), "left").join(out.alias("o"), F.col("i.conv_id").eqNullSafe(F.col("o.conv_id")), "left")
    empty = F.sha2(F.lit(""), 256)
    return found.select("i.conv_id", *[F.coalesce(F.col(f"a.{c}"), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("a.audit", F.lit("")).alias("audit"), F.coalesce("o.repaired_sha256", empty).alias("repaired_sha256"))
