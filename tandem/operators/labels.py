"""Curated pair labels: filters, state changes, conflicts, training splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import base_id

from .shared import numbered, owed

APPROVED, REJECTED, OPEN, UNRESOLVED = 1, 2, 0, 5
#: An open label becomes an approval when it is set again after this many hours.
SETTLE_HOURS = 4


def is_bulk(curator: Column | str) -> Column:
    """Whether a label was set in bulk: the first letter of the curator is upper case."""
    first = F.substring(curator, 1, 1)
    return first != F.lower(first)


def filter_labels(labels: DataFrame, status: int | None = None, vertical: bool | None = None, bulk: bool | None = None) -> DataFrame:
    """Rows that meet every condition given."""
    if status is not None:
        labels = labels.where(F.col("status") == status)
    if vertical is not None:
        labels = labels.where(F.col("vertical") if vertical else ~F.col("vertical"))
    if bulk is not None:
        labels = labels.where(is_bulk("curator") if bulk else ~is_bulk("curator"))
    return labels


def parse_review(text: str) -> dict:
    """One review string taken apart: orientation v/h, sort mode, direction f/r, status digits, P/U/L filter, keywords.

    ``"vqf12 P tree,house"`` -> vertical, by quality, forward, status 1 or 2, people only, two keywords.
    """
    head, *rest = text.split()
    out = {"vertical": {"v": True, "h": False}.get(head[0]), "mode": head[1:2] or "0", "reverse": "r" in head[2:], "status": sorted({int(c) for c in head[2:] if c.isdigit()})}
    out["filter"] = next((w for w in rest if w in ("P", "U", "L")), None)
    out["keywords"] = [k for w in rest if w not in ("P", "U", "L") for k in w.split(",") if k]
    return out


def review(labels: DataFrame, text: str) -> DataFrame:
    """The labels that a review string asks for; U keeps bulk labels, L manual ones, P pairs whose ends differ in people."""
    ask = parse_review(text)
    rows = filter_labels(labels, vertical=ask["vertical"], bulk={"U": True, "L": False}.get(ask["filter"]))
    if ask["status"]:
        rows = rows.where(F.col("status").isin(ask["status"]))
    if ask["filter"] == "P":
        rows = rows.where(~F.col("match_people") & ~F.col("people"))
    return rows


def review_in_order(labels: DataFrame, text: str, words: DataFrame | None = None) -> DataFrame:
    """What ``review`` gives, with ``place`` from 0 in the order that the string asks for.

    History goes by time, quality by ``d0``, a first side by its pair, each
    forward or in reverse. With keywords, only pairs stay of which an end has one
    of them in ``words(id, word)``.
    """
    ask, rows = parse_review(text), review(labels, text)
    if ask["keywords"]:
        hits = words.where(F.col("word").isin(ask["keywords"])).select("id").distinct()
        ends = [rows.join(hits.withColumnRenamed("id", end), end, "left_semi").select("id1", "id2") for end in ("id1", "id2")]
        rows = rows.join(ends[0].unionByName(ends[1]).distinct(), ["id1", "id2"], "left_semi")
    order = [*{"h": ["create_time"], "q": ["d0"]}.get(ask["mode"], []), "id1", "id2"]
    return numbered(rows.withColumn("__g", F.lit(0)), "__g", *[F.desc(c) if ask["reverse"] else F.asc(c) for c in order]).drop("__g")


def apply_labels(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The label table after one change a pair: ``id1, id2, status, create_time`` -> the same and ``action``.

    A new pair is inserted. The same status again changes nothing, but an open
    one older than SETTLE_HOURS becomes an approval. An approval is not reopened;
    an open or approving change of anything but a rejection gives an approval;
    otherwise the new status holds, and a change between approval and rejection
    counts as flipped.
    """
    old, new = F.col("old.status"), F.col("new.status")
    later = (F.unix_micros(F.col("new.create_time").cast("timestamp")) - F.unix_micros(F.col("old.create_time").cast("timestamp"))) > SETTLE_HOURS * 3_600_000_000
    rows = current.select("id1", "id2", F.struct("status", "create_time").alias("old")).join(changes.select("id1", "id2", F.struct("status", "create_time").alias("new")), ["id1", "id2"], "full")
    settled = (old == new) & (new == OPEN) & later
    raised = (old != REJECTED) & new.isin(OPEN, APPROVED)
    kept = new.isNull() | ((old == new) & ~settled) | ((old == APPROVED) & (new == OPEN))
    status = F.when(old.isNull(), new).when(kept, old).when(settled | raised, APPROVED).otherwise(new)
    action = F.when(old.isNull(), "inserted").when(kept, "kept").when(old.isin(APPROVED, REJECTED) & status.isin(APPROVED, REJECTED) & (status != old), "flipped").otherwise("updated")
    time = F.when(old.isNull() | ~kept, F.col("new.create_time")).otherwise(F.col("old.create_time"))
    return rows.select("id1", "id2", status.alias("status"), time.alias("create_time"), action.alias("action"))


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and those rows of ``new`` whose keys it lacks; repeated keys of ``new`` are added once."""
    fresh = new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: the upsert of an append-only table."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def swap_screens(screens: DataFrame) -> DataFrame:
    """Session screens after a swap: depth 0 (current) and 1 (previous) change places; -1 stays."""
    return screens.withColumn("depth", F.when(F.col("depth") == 0, 1).when(F.col("depth") == 1, 0).otherwise(F.col("depth")))


def conflicts(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Pairs that are on both sides, whatever their order."""
    def canonical(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()

    return canonical(positives).join(canonical(negatives), ["id1", "id2"], "left_semi")


def training_labels(labels: DataFrame, seen: DataFrame) -> DataFrame:
    """``id1, id2, label, source``: approved pairs, reviewed rejects, and pairs seen but never labelled either way.

    Pairs that are both approved and rejected are left out.
    """
    marked = labels.groupBy("id1", "id2").agg(F.max(F.col("status") == APPROVED).alias("pos"), F.max(F.col("status") == REJECTED).alias("neg"))
    settled = marked.where("pos <> neg").select("id1", "id2", F.when(F.col("pos"), 1).otherwise(0).alias("label"), F.when(F.col("pos"), "approved").otherwise("rejected").alias("source"))
    judged = marked.where("pos or neg").select("id1", "id2")
    first = seen.select("id1", "id2").distinct().join(judged, ["id1", "id2"], "left_anti")
    return settled.unionByName(first.select("id1", "id2", F.lit(0).alias("label"), F.lit("seen").alias("source")))


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rn`` from 1 within each label; a label may hold nearly all rows, so no window sorts one whole."""
    return numbered(rows, "label", *order, name="rn").withColumn("rn", (F.col("rn") + 1).cast("int"))


def _split(rows: DataFrame, x: Column, every: int, test_pos: Column) -> DataFrame:
    """Rows numbered by ``rn`` within their label; every ``every``-th positive is a test row, negatives alternate, each side up to its target."""
    turn = F.when(F.col("label") == 1, F.lit(every)).otherwise(F.lit(2))
    side = F.when(F.col("rn") % turn == 0, "test").otherwise("train")
    placed = rows.crossJoin(F.broadcast(_sizes(rows).select(x.alias("x")))).withColumn("split", side)  # one row
    place = F.when(F.col("split") == "test", F.floor(F.col("rn") / turn)).otherwise(F.col("rn") - F.floor(F.col("rn") / turn))
    target = F.when((F.col("label") == 1) & (F.col("split") == "test"), test_pos).otherwise(F.col("x"))
    return placed.withColumn("place", place.cast("int")).where(F.col("place") <= target).select("id1", "id2", "label", "split", "place")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))


def split_plan_f(rows: DataFrame) -> DataFrame:
    """For few positives: X training rows a side, X / 3 positive and X negative test rows, X = positives / 1.333."""
    return _split(_ranked(rows, "id1", "id2"), F.floor(F.col("n_pos") / 1.333), 4, F.floor(F.col("x") / 3.0))


def split_plan_g(rows: DataFrame) -> DataFrame:
    """Balanced: X rows each of both labels in training and test, X = half the smaller side."""
    return _split(_ranked(rows, "id1", "id2"), F.floor(F.least("n_pos", "n_neg") / 2), 2, F.col("x"))


def split_vertex_disjoint(rows: DataFrame, side1: Column, side2: Column) -> DataFrame:
    """Pairs with both ends on the training (0) or the test side (1); pairs across go. No item is on both sides."""
    return rows.where(side1 == side2).withColumn("split", F.when(side1 == 1, "test").otherwise("train"))


def emit_train_test(rows: DataFrame, every: int = 4) -> DataFrame:
    """Examples in order of score, one a pair of base ids; every ``every``-th positive and every 2nd negative is a test row."""
    one = rows.withColumns({"b1": base_id(F.col("id1")), "b2": base_id(F.col("id2"))})
    first = Window.partitionBy("label", "b1", "b2").orderBy(F.desc("value"), "id1", "id2")
    unique = one.withColumn("n", F.row_number().over(first)).where("n = 1")
    ranked = _ranked(unique, F.desc("value"), "id1", "id2")
    turn = F.when(F.col("label") == 1, F.lit(every)).otherwise(F.lit(2))
    return ranked.select("id1", "id2", "label", "rn", F.when(F.col("rn") % turn == 0, "test").otherwise("train").alias("split"))


def emit_with_debt(rows: DataFrame, target: Column, every: int = 4) -> DataFrame:
    """Examples of both orientations in order of score: every ``every``-th positive is owed to the test side.

    The debt is carried until a positive of the ``target`` orientation comes, which
    settles one. Negatives of the target alternate; of the other orientation no
    row is a test row.
    """
    positives = _ranked(rows.where("label = 1"), F.desc("value"), "id1", "id2")
    positives = owed(positives, "label", F.col("rn") % every == 0, target, F.desc("value"), "id1", "id2", name="test")
    negatives = _ranked(rows.where("label = 0"), F.desc("value"), "id1", "id2").withColumn("test", target & (F.col("rn") % 2 == 0))
    return positives.unionByName(negatives).select("id1", "id2", "label", "rn", F.when(F.col("test"), "test").otherwise("train").alias("split"))


def emit_two_targets(rows: DataFrame, first: Column, every: int = 4, seed: int = 0) -> DataFrame:
    """``target, appended, id1, id2, label, rn, split``: examples for two targets, one orientation each.

    The first target gets the rows for which ``first`` holds, the second all
    others and, after them, those of the first in an order drawn by ``seed``,
    which are train rows there. ``rn`` counts by target, label and ``appended``;
    drawn rows are counted together.
    """
    told = rows.withColumn("__first", first)
    parts = []
    for target, own in ((1, told.where("__first")), (2, told.where("not __first"))):
        parts.append(emit_with_debt(own.drop("__first"), F.lit(True), every).select(F.lit(target).alias("target"), F.lit(False).alias("appended"), "id1", "id2", "label", F.col("rn").cast("long").alias("rn"), "split"))
    drawn = told.where("__first").select("id1", "id2", "label", F.lit(0).alias("g"), F.md5(F.concat_ws("|", F.lit(seed), "id1", "id2")).alias("h"))
    drawn = numbered(drawn, "g", "h", "id1", "id2")
    parts.append(drawn.select(F.lit(2).alias("target"), F.lit(True).alias("appended"), "id1", "id2", "label", (F.col("place") + 1).cast("long").alias("rn"), F.lit("train").alias("split")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Positives a negative that the two plans aim at, and how far below counts as even.
RATIO_F, RATIO_G, EVEN = 2 / 3, 1.0, 0.001


def balanced(rows: DataFrame, ratio: float = RATIO_F) -> DataFrame:
    """``id1, id2, label, place``: positives and negatives cut to ``ratio`` positives a negative, in order of the pair."""
    ranked = _ranked(rows, "id1", "id2")
    pos, neg = F.col("n_pos"), F.col("n_neg")
    keep_pos = F.when(pos > ratio * neg, F.floor(ratio * neg)).otherwise(pos)
    keep_neg = F.when(pos < (ratio - EVEN) * neg, F.floor(pos / ratio)).otherwise(neg)
    limits = _sizes(ranked).select(keep_pos.alias("keep_pos"), keep_neg.alias("keep_neg"))
    limit = F.when(F.col("label") == 1, F.col("keep_pos")).otherwise(F.col("keep_neg"))
    return ranked.crossJoin(F.broadcast(limits)).where(F.col("rn") <= limit).select("id1", "id2", "label", F.col("rn").alias("place"))  # one row


def padded(rows: DataFrame, scores: DataFrame, ratio: float = RATIO_F) -> DataFrame:
    """``rows(id1, id2, label)``, and where positives exceed ``ratio``, the pairs of lowest ``d012`` not in ``rows`` as further negatives.

    As many are added as the balance lacks: (positives - ratio * negatives) / ratio.
    """
    lacking = _sizes(rows).select(F.greatest(F.lit(0), F.floor((F.col("n_pos") - F.floor(ratio * F.col("n_neg"))) / ratio)).alias("lacking"))
    open_ = scores.select("id1", "id2", "d012").join(rows.select("id1", "id2"), ["id1", "id2"], "left_anti")
    worst = numbered(open_.withColumn("g", F.lit(0)), "g", "d012", "id1", "id2").crossJoin(F.broadcast(lacking)).where("place < lacking")  # one row
    return rows.select("id1", "id2", "label").unionByName(worst.select("id1", "id2", F.lit(0).alias("label")))


def time_midpoint(rows: DataFrame, time: str = "create_time") -> DataFrame:
    """One row, ``mid``: the time of the middle row; if others share it, the nearer of the times next to it (the later of two equally near)."""
    placed = numbered(rows.select(time).withColumn("g", F.lit(0)), "g", time)
    half = placed.agg(F.floor(F.count("*") / 2).alias("half"))
    at = placed.crossJoin(F.broadcast(half)).where(F.col("place") == F.col("half")).select(F.col(time).alias("at"), "half")  # one row
    met = placed.crossJoin(F.broadcast(at))  # one row
    same = F.col(time) == F.col("at")
    told = met.groupBy("at", "half").agg(
        F.min(F.when(same, F.col("place"))).alias("first"), F.max(F.when(same, F.col("place"))).alias("last"),
        F.min(F.when(F.col(time) > F.col("at"), F.col(time))).alias("later"), F.max(F.when(F.col(time) < F.col("at"), F.col(time))).alias("earlier"),
    )
    back, on = F.col("half") - F.col("first"), F.col("last") - F.col("half")
    return told.select(F.when(back + on == 0, F.col("at")).when(back <= on, F.coalesce("later", "earlier", "at")).otherwise(F.coalesce("earlier", "later", "at")).alias("mid"))


def split_by_time(labels: DataFrame, rejects: DataFrame) -> DataFrame:
    """``labels`` with ``half``: early before the middle time of ``rejects``, late from it on."""
    return labels.crossJoin(F.broadcast(time_midpoint(rejects))).withColumn("half", F.when(F.col("create_time") < F.col("mid"), "early").otherwise("late")).drop("mid")  # one row


def same_archive(rows: DataFrame) -> DataFrame:
    """Pairs whose ends are of one archive, balanced one to one."""
    archive = [F.substring_index(c, "/", 1) for c in ("id1", "id2")]
    return balanced(rows.where(archive[0] == archive[1]), RATIO_G)


def interleave(rows: DataFrame) -> DataFrame:
    """Positives and negatives in turn, up to the shorter side."""
    ranked = _ranked(rows, "id1", "id2")
    sized = ranked.crossJoin(F.broadcast(_sizes(ranked).select(F.least("n_pos", "n_neg").alias("n"))))  # one row
    return sized.where("rn <= n").select(((F.col("rn") - 1) * 2 + F.when(F.col("label") == 1, 0).otherwise(1)).cast("int").alias("place"), "id1", "id2", "label")


def rescore(labels: DataFrame, scores: DataFrame, items: DataFrame) -> DataFrame:
    """Labels with their current score and whether both ends agree on people; without a score, status UNRESOLVED."""
    people = items.select("id", "people")
    rows = labels.join(scores.select("id1", "id2", "d012"), ["id1", "id2"], "left")
    rows = rows.join(people.select(F.col("id").alias("id1"), F.col("people").alias("p1")), "id1", "left").join(people.select(F.col("id").alias("id2"), F.col("people").alias("p2")), "id2", "left")
    return rows.select("id1", "id2", F.when(F.col("d012").isNull(), UNRESOLVED).otherwise(F.col("status")).alias("status"), F.coalesce("d012", F.lit(-1).cast("long")).alias("d0"), F.coalesce(F.col("p1") == F.col("p2"), F.lit(False)).alias("match_people"))


def binary_metrics(rows: DataFrame, cut: float = 0.5, margin: float = 1.0) -> DataFrame:
    """Accuracy, precision, recall, F-score and contrastive loss of ``label, distance``; near (below ``cut``) means 1."""
    near = F.col("distance") < cut
    pos = F.col("label") == 1
    hinge = F.greatest(F.lit(0.0), margin - F.col("distance"))
    loss = F.when(pos, F.col("distance") * F.col("distance")).otherwise(hinge * hinge)
    found = rows.agg(F.avg(F.when(near == pos, 1.0).otherwise(0.0)).alias("accuracy"), F.count_if(near & pos).alias("tp"), F.count_if(near & ~pos).alias("fp"), F.count_if(~near & pos).alias("fn"), F.avg(loss).alias("loss"))
    return found.select(F.round("accuracy", 6).alias("accuracy"), "tp", "fp", "fn", F.round(F.expr("try_divide(2.0 * tp, 2 * tp + fp + fn)").cast("double"), 6).alias("f_score"), F.round("loss", 6).alias("loss"))
