"""Queries over search commands, drawn strokes and the stored vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tandem.operators import blocks, commands, gestures, vindex
from tandem.operators.shared import shared_folder
from tandem.sources import tables as S

from .registry import query
from .search import SEEN, _seen

#: Score columns of the pairs, and tags of four kinds by the first item's archive.
SCORED = "scored AS (SELECT id1, id2, d012 AS a_left, d021 AS a_right, d012 + d021 AS n_sum FROM pairs)"
TOPS = "tops AS (SELECT id1, id2, concat(CASE WHEN a.archive % 2 = 0 THEN 'nn_left_' ELSE 'nn_right_' END, a.archive % 4) AS tag, d012 AS val FROM pairs p JOIN items a ON a.id = p.id1 WHERE d012 > 1000000)"
GROUPS = {"lefts": ("nn_left_0", "nn_left_2", "nn_gone"), "rights": ("nn_right_1", "nn_right_3")}
COMMANDS = ("p_avg a_right", "p_avg any", "p_negpos a_right a_left", "pt_group lefts", "pt_match nn_right_3 nn_missing nn_left_0", "pt_match fname nn right", "p_avg a_missing")
SEED = 21


def _ask_sql(no: int, found: str) -> str:
    """The best five unseen of each ask, from the first of its sources."""
    return f"""SELECT {no} AS command, qid, CAST(rank AS INTEGER) AS rank, id, value, name AS source FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, id) AS rank FROM (
            SELECT *, min(source) OVER (PARTITION BY qid) AS least FROM ({found}) f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.qid = f.qid AND s.id = f.id)) WHERE source = least) WHERE rank <= 5"""


def _score_sql(value: str, name: str) -> str:
    return f"SELECT qid, id, value, 0 AS source, '{name}' AS name FROM (SELECT id1 AS qid, id2 AS id, CAST({value} AS DOUBLE) AS value FROM scored UNION ALL SELECT id2, id1, CAST({value} AS DOUBLE) FROM scored)"


def _tag_sql(tags: tuple[str, ...], source: str) -> str:
    names = ", ".join(f"'{t}'" for t in tags)
    return f"SELECT qid, id, value, {source} AS source, tag AS name FROM (SELECT id1 AS qid, id2 AS id, CAST(val AS DOUBLE) AS value, tag FROM tops UNION ALL SELECT id2, id1, CAST(val AS DOUBLE), tag FROM tops) WHERE tag IN ({names})"


DRAWN = f"md5(concat('{SEED}|', qid, '|', tag))"
SPARE = "SELECT qid, id, value, 0 AS source, 'mixed' AS name FROM (SELECT id1 AS qid, id2 AS id, CAST(n_sum AS DOUBLE) AS value FROM scored UNION ALL SELECT id2, id1, CAST(n_sum AS DOUBLE) FROM scored)"
ANSWERS = [
    _score_sql("a_right", "a_right"), _score_sql("(a_left + a_right) / 2", "any"), _score_sql("a_left - a_right", "a_right a_left"),
    _tag_sql(GROUPS["lefts"][:2], DRAWN), _tag_sql(("nn_right_3", "nn_left_0"), "CASE tag WHEN 'nn_right_3' THEN 1 ELSE 2 END"), _tag_sql(("nn_right_1", "nn_right_3"), DRAWN), SPARE,
]


@query(f"""WITH s AS ({SEEN}), {SCORED}, {TOPS}, spare AS ({_ask_sql(-1, SPARE)}), told AS ({" UNION ALL ".join(_ask_sql(n, f) for n, f in enumerate(ANSWERS))}),
    asks AS (SELECT id AS qid, n AS command FROM items, (SELECT unnest(range({len(ANSWERS)})) AS n))
    SELECT * FROM told UNION ALL SELECT a.command, s.qid, s.rank, s.id, s.value, s.source FROM spare s JOIN asks a ON a.qid = s.qid WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.command = a.command AND t.qid = a.qid)""", "items pairs")
def sigma_commands(spark, sf_dir):
    """Seven commands for every item, one of them refused; what a command leaves open is answered by the sum of scores."""
    items, seen = S.items(spark, sf_dir), _seen(spark, sf_dir)
    pairs = S.pairs(spark, sf_dir).select("id1", "id2", F.col("d012").alias("a_left"), F.col("d021").alias("a_right"), (F.col("d012") + F.col("d021")).alias("n_sum"))
    side = F.when(F.col("archive") % 2 == 0, "nn_left_").otherwise("nn_right_")
    tags = items.select(F.col("id").alias("id1"), F.concat(side, (F.col("archive") % 4).cast("string")).alias("tag"))
    tops = pairs.where("a_left > 1000000").join(tags, "id1").select("id1", "id2", "tag", F.col("a_left").alias("val"))
    catalog = commands.Catalog.of(pairs, "a_", tags, GROUPS)
    asks, mixed = items.select(F.col("id").alias("qid")), commands.neighbours(pairs, F.col("n_sum"))
    told = None
    for n, text in enumerate(COMMANDS):
        one = commands.run_or_fall_back(text, catalog, asks, pairs, tops, seen, mixed, seed=SEED).select(F.lit(n).alias("command"), "qid", "rank", "id", "value", "source")
        told = one if told is None else told.unionByName(one)
    return told


def _strokes(items):
    """A stroke over each item and one of those after it, of all directions and lengths."""
    n = F.col("sequence")
    rows = items.select(F.col("id").alias("ask"), F.col("id").alias("id1"), "orient", n.alias("at"), (n + 2 * (n % 5 + 1)).alias("sequence"))
    rows = rows.join(items.select("sequence", F.col("id").alias("id2")), "sequence")
    return rows.select(
        "ask", "id1", "id2", (F.col("at") % 2 + 1).cast("int").alias("from_side"), F.when(F.col("at") % 11 == 0, F.col("at") % 2 + 1).otherwise(2 - F.col("at") % 2).cast("int").alias("to_side"),
        (F.col("at") * 37 % 360 - 180).cast("double").alias("angle"), (F.col("at") % 60 * 5).cast("double").alias("distance"), F.lit(200.0).alias("centers"),
        (F.col("at") % 20 + 10).alias("dots"), (F.col("at") % 10 + 1).alias("dots1"), (F.col("at") % 9 + 1).alias("dots2"),
    )


FOLD = "list_transform({}, lambda x: CASE WHEN abs(x) / 0.2 > 1 THEN abs(x) * pow(0.5, ceil(log2(abs(x) / 0.2))) ELSE abs(x) END)"
#: Both distances of the search, rounded as it rounds them.
METRIC = """CASE WHEN {right} THEN round(1 - list_cosine_similarity({a}, {b}), 6) ELSE (SELECT round(ln(x + sqrt(x * x - 1)), 6) FROM (SELECT greatest(1, 1 + 2 * list_distance({a}, {b}) ** 2 / (greatest(1e-6, 1 - list_inner_product({a}, {a})) * greatest(1e-6, 1 - list_inner_product({b}, {b})))) AS x)) END"""


@query(f"""WITH seen AS ({SEEN}), v AS (SELECT id, orient, vec[1:7] AS v FROM items),
    strokes AS (SELECT a.id AS ask, a.id AS id1, b.id AS id2, a.orient, a.sequence % 2 = 0 AS right_, CASE WHEN a.sequence % 11 = 0 THEN a.sequence % 2 + 1 ELSE 2 - a.sequence % 2 END AS to_side, a.sequence % 2 + 1 AS from_side,
      CAST(a.sequence * 37 % 360 - 180 AS DOUBLE) AS ang, CAST(a.sequence % 60 * 5 AS DOUBLE) AS dist, (a.sequence % 20 + 10)::DOUBLE AS dots, a.sequence % 10 + 1 AS dots1, a.sequence % 9 + 1 AS dots2 FROM items a JOIN items b ON b.sequence = a.sequence + 2 * (a.sequence % 5 + 1)),
    kinds AS (SELECT *, CASE WHEN (abs(ang) < 10 OR abs(ang) > 170) AND dist < 200 THEN 'in' WHEN ang > 10 AND ang < 90 THEN 'lr/down' WHEN ang > 90 AND ang < 170 THEN 'rl/down' WHEN ang > -90 AND ang < -10 THEN 'lr/up' WHEN ang > -170 AND ang < -90 THEN 'rl/up' ELSE 'flat' END AS kind FROM strokes WHERE from_side <> to_side),
    pushed AS (SELECT *, CASE kind WHEN 'in' THEN dots1 / dots * (CASE WHEN dist > 0 THEN -1 ELSE 1 END) * (1 - dist / 200) WHEN 'lr/down' THEN 2 - 0.01::DOUBLE * (ang - 10) WHEN 'rl/down' THEN 2 + 0.01::DOUBLE * (ang - 180) WHEN 'lr/up' THEN 2 - 0.05::DOUBLE * (ang + 20) WHEN 'rl/up' THEN 2 + 0.05::DOUBLE * (ang + 90) ELSE 2 END AS p1, dots2 / dots * (CASE WHEN dist > 0 THEN -1 ELSE 1 END) * (1 - dist / 200) AS in2 FROM kinds),
    told AS (SELECT p.*, a.v AS v1, b.v AS v2, CASE WHEN right_ OR kind = 'in' THEN a.v ELSE b.v END AS begin_, CASE WHEN right_ OR kind = 'in' THEN b.v ELSE a.v END AS end_ FROM pushed p JOIN v a ON a.id = id1 JOIN v b ON b.id = id2),
    one AS (SELECT *, {FOLD.format("CASE WHEN kind = 'in' THEN list_transform(list_zip(v1, v2), lambda z: z[1] + p1 * (z[2] - z[1])) ELSE list_transform(list_zip(begin_, end_), lambda z: p1 * z[2] - z[1]) END")} AS w FROM told),
    far1 AS (SELECT o.ask, i.id, i.v, {METRIC.format(right="o.right_", a="o.w", b="i.v")} AS distance FROM one o JOIN v i USING (orient) WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.qid = o.ask AND s.id = i.id)),
    pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY distance, id) AS n FROM far1) WHERE n = 1),
    two AS (SELECT o.*, p.id AS pick, {FOLD.format("CASE WHEN kind = 'in' THEN list_transform(list_zip(v2, v1), lambda z: z[1] + in2 * (z[2] - z[1])) ELSE list_transform(list_zip(end_, p.v), lambda z: p1 * z[2] - z[1]) END")} AS w2 FROM one o JOIN pick p USING (ask)),
    far2 AS (SELECT o.ask, i.id, {METRIC.format(right="o.right_", a="o.w2", b="i.v")} AS distance FROM two o JOIN v i USING (orient) WHERE i.id <> o.pick AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.qid = o.ask AND s.id = i.id))
    SELECT t.ask, CASE WHEN right_ OR kind = 'in' THEN 1 ELSE 2 END AS side, kind, 1 AS rank, p.id, p.distance FROM told t JOIN pick p USING (ask)
    UNION ALL SELECT t.ask, CASE WHEN right_ OR kind = 'in' THEN 2 ELSE 1 END, kind, CAST(n AS INTEGER), f.id, f.distance FROM told t JOIN (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY distance, id) AS n FROM far2) f USING (ask) WHERE n <= 5""", "items")
def stroke_search(spark, sf_dir):
    """A stroke over every item, of all directions and lengths, by the first seven components."""
    items = S.items(spark, sf_dir)
    seen = _seen(spark, sf_dir).withColumnRenamed("qid", "ask")
    return gestures.stroke_search(_strokes(items), items.select("id", "orient", F.slice("vec", 1, 7).alias("vec")), seen, 5)


@query("""WITH d AS (SELECT archive AS stroke, sequence AS n, r::DOUBLE AS x, b::DOUBLE AS y, r - lag(r) OVER w AS dx, b - lag(b) OVER w AS dy FROM items WINDOW w AS (PARTITION BY archive ORDER BY sequence)),
    p AS (SELECT *, last_value(CASE WHEN dx <> 0 OR dy <> 0 THEN {'x': dx, 'y': dy} END IGNORE NULLS) OVER (PARTITION BY stroke ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM d),
    t AS (SELECT *, CASE WHEN (dx <> 0 OR dy <> 0) AND q IS NOT NULL THEN degrees(atan2(q.x * dy - q.y * dx, q.x * dx + q.y * dy)) END AS turn FROM p),
    e AS (SELECT stroke, count(*) AS dots, sum(coalesce(sqrt(dx * dx + dy * dy), 0)) AS length, arg_min(x, n) AS ax, arg_min(y, n) AS ay, arg_max(x, n) AS bx, arg_max(y, n) AS by_, coalesce(sum(turn), 0) AS turning, coalesce(sum(abs(turn)), 0) AS turns,
      max(x) - min(x) AS w, max(y) - min(y) AS h FROM t GROUP BY stroke), r AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS reach FROM e)
    SELECT stroke, dots, round(length, 6) AS length, round(reach, 6) AS reach, round(CASE WHEN length > 0 THEN reach / length END, 6) AS straightness, round(turning, 4) AS turning, round(turns, 4) AS turns,
      round(1 - CASE WHEN length > 0 THEN reach / length END, 6) AS closure, round(CASE WHEN least(w, h) > 0 THEN greatest(w, h) / least(w, h) END, 6) AS elongation FROM r""", "items")
def stroke_shapes(spark, sf_dir):
    """The colours of an archive's items as the dots of a stroke."""
    dots = S.items(spark, sf_dir).select(F.col("archive").alias("stroke"), F.col("sequence").alias("n"), F.col("r").cast("double").alias("x"), F.col("b").cast("double").alias("y"))
    told = gestures.stroke_shapes(dots)
    return told.select("stroke", "dots", *[F.round(c, 4 if c in ("turning", "turns") else 6).alias(c) for c in told.columns[2:]])


@query()
def index_recall(spark, sf_dir):
    """Of every item's ten exact cosine neighbours the share that the stored index finds, and the share of rows it reads."""
    items = S.items(spark, sf_dir).select("id", "vec")
    path = f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    vindex.build(items, path, "cosine")
    index = vindex.VectorIndex(spark, path)
    probes = index.probes_for(items, 0.95)
    found = index.search(items, 10, probes).select("qid", "id")
    exact = blocks.nearest(items, items, 10).select(F.col("id").alias("qid"), F.col("match_id").alias("id"))
    hit = exact.join(found, ["qid", "id"], "left_semi").groupBy().agg(F.count("*").alias("hit"))
    every = exact.groupBy().agg(F.count("*").alias("every"))
    return hit.crossJoin(every).crossJoin(index.scanned(items, probes)).select(F.round(F.col("hit") / F.col("every"), 4).alias("recall"), F.round("share", 4).alias("share"))  # one row each


@query()
def lsh_recall(spark, sf_dir):
    """The recall alone; the name is that of the projections which this index has replaced."""
    return index_recall(spark, sf_dir).select("recall")
