"""A small command language for searches: parsed, checked against the columns and tags at hand, and made one plan.

A command is a word and its arguments:

* ``p_avg COLUMN``: the best neighbours by a score column of the pairs; ``any`` is the mean of all of them
* ``p_negpos LOW HIGH``: by how far one score column lies above another
* ``pt_group GROUP...``: the tags of the groups, in an order drawn anew for each ask; the first that has an unseen pair
* ``pt_match TAG...``: likewise, in the order given
* ``pt_match fname PART...``: any tag that holds all the parts

All asks are answered together: sources that are tried in turn become numbered
lists, of which each ask keeps the first that has rows for it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import best_per_key


@dataclass(frozen=True)
class Catalog:
    """What commands may name: score columns, tags, and groups of tags."""

    columns: tuple[str, ...]
    tags: tuple[str, ...]
    groups: dict[str, tuple[str, ...]]

    @staticmethod
    def of(pairs: DataFrame, prefix: str, tops: DataFrame, groups: dict[str, tuple[str, ...]]) -> Catalog:
        """The columns of ``pairs`` with a prefix, and the tags of ``tops(tag)``, of which a table has few."""
        tags = [r["tag"] for r in tops.select("tag").distinct().orderBy("tag").collect()]
        return Catalog(tuple(c for c in pairs.columns if c.startswith(prefix)), tuple(tags), groups)


@dataclass(frozen=True)
class Command:
    """A checked command; ``names`` are columns, tags or parts of tags, as ``kind`` says."""

    kind: str
    names: tuple[str, ...]


def parse(text: str, catalog: Catalog) -> Command:
    """The command in ``text``, or a ValueError that says what is wrong.

    Tags and groups that are not there are passed over, as long as one is left.
    """
    kind, *names = text.split() or [""]
    if not names:
        raise ValueError(f"a command and at least one argument are needed: {text!r}")

    def column(name: str) -> str:
        if name != "any" and name not in catalog.columns:
            raise ValueError(f"no such score column: {name}; there are any, {', '.join(catalog.columns)}")
        return name

    def count(n: int) -> None:
        if len(names) != n:
            raise ValueError(f"{kind} takes {n} argument(s): {text!r}")

    def left(found: Iterable[str], what: str) -> tuple[str, ...]:
        found = tuple(dict.fromkeys(found))
        if not found:
            raise ValueError(f"no such {what}: {' '.join(names)}")
        return found

    if kind == "p_avg":
        count(1)
        return Command("score", (column(names[0]),))
    if kind == "p_negpos":
        count(2)
        return Command("difference", tuple(column(n.lower()) for n in names))
    if kind == "pt_group":
        return Command("drawn", left((t for g in names for t in catalog.groups.get(g, ()) if t in catalog.tags), "group"))
    if kind == "pt_match" and names[0] == "fname":
        return Command("drawn", left((t for t in catalog.tags if len(names) > 1 and all(p in t for p in names[1:])), "tag with these parts"))
    if kind == "pt_match":
        return Command("ordered", left((t for t in names if t in catalog.tags), "tag"))
    raise ValueError(f"no such command: {kind}; there are p_avg, p_negpos, pt_group and pt_match")


def first_source(candidates: DataFrame) -> DataFrame:
    """Of ``qid, source, id, value`` the rows of the smallest ``source`` that each ``qid`` has."""
    least = candidates.groupBy("qid").agg(F.min("source").alias("source"))
    return candidates.join(least, ["qid", "source"])


def neighbours(pairs: DataFrame, value: Column) -> DataFrame:
    """``qid, id, value``: both directions of ``id1, id2``, as one row an end; no row for a null value."""
    ends = F.explode(F.array(F.struct(F.col("id1").alias("qid"), F.col("id2").alias("id")), F.struct(F.col("id2").alias("qid"), F.col("id1").alias("id"))))
    return pairs.select(ends.alias("end"), value.cast("double").alias("value")).where("value is not null").select("end.qid", "end.id", "value")


def run(command: Command, asks: DataFrame, pairs: DataFrame, tops: DataFrame, seen: DataFrame, catalog: Catalog, k: int = 5, seed: int = 0) -> DataFrame:
    """``qid, rank, id, value, source`` of the ``k`` best unseen ids for each of ``asks(qid)``; ``source`` names the column or tag.

    ``pairs`` has ``id1, id2`` and the score columns, ``tops`` has ``id1, id2,
    tag, val`` and ``seen`` has ``qid, id``. Ties go to the smaller id; an ask
    that no source answers gives no row.
    """
    def scored(name: str) -> Column:
        return sum((F.col(c) for c in catalog.columns), F.lit(0)) / len(catalog.columns) if name == "any" else F.col(name)

    asked = asks.select("qid").distinct()
    if command.kind in ("score", "difference"):
        value = scored(command.names[-1]) - (scored(command.names[0]) if command.kind == "difference" else F.lit(0))
        found = neighbours(pairs, value).join(asked, "qid", "left_semi").withColumns({"source": F.lit(0), "name": F.lit(" ".join(command.names))})
    else:
        own = tops.where(F.col("tag").isin(list(command.names)))
        found = reduce(DataFrame.unionByName, [own.select(F.col(a).alias("qid"), F.col(b).alias("id"), F.col("val").cast("double").alias("value"), F.col("tag").alias("name")) for a, b in (("id1", "id2"), ("id2", "id1"))])
        found = found.where("qid <> id").distinct().join(asked, "qid", "left_semi")
        if command.kind == "drawn":
            found = found.withColumn("source", F.md5(F.concat_ws("|", F.lit(seed), "qid", "name")))
        else:
            found = found.withColumn("source", F.array_position(F.array(*[F.lit(t) for t in command.names]), F.col("name")))
    open_ = found.join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
    best = best_per_key(first_source(open_), "qid", k, F.desc("value"), "id")
    return best.select("qid", F.col("rank").cast("int").alias("rank"), "id", "value", F.col("name").alias("source"))


def run_or_fall_back(text: str, catalog: Catalog, asks: DataFrame, pairs: DataFrame, tops: DataFrame, seen: DataFrame, mixed: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """A command's answers, and those of ``mixed(qid, id, value)`` for asks it leaves open, or for all if it is refused."""
    spare = mixed.join(seen.select("qid", "id"), ["qid", "id"], "left_anti").join(asks.select("qid").distinct(), "qid", "left_semi")
    spare = best_per_key(spare, "qid", k, F.desc("value"), "id").select("qid", F.col("rank").cast("int").alias("rank"), "id", F.col("value").cast("double").alias("value"), F.lit("mixed").alias("source"))
    try:
        command = parse(text, catalog)
    except ValueError:
        return spare
    told = run(command, asks, pairs, tops, seen, catalog, k, seed)
    return told.unionByName(spare.join(told.select("qid").distinct(), "qid", "left_anti"))
