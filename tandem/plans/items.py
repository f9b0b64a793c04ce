"""Queries over items: scans, neighbours, colours, histograms, ids."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import colours as C
from tandem.functions import text as T
from tandem.functions import vectors as V
from tandem.operators import knn, labels, pairs, tiles
from tandem.operators import views as views_op
from tandem.sources import tables as S

from .registry import query

ANCHOR = "1/1"


def _first(spark, sf_dir):
    """The id of the item with vec_id 0, and of those with 2 and 4; one small lookup."""
    rows = S.items(spark, sf_dir).where(F.col("sequence").isin(1, 3, 5)).select("sequence", "id").orderBy("sequence").collect()  # three rows
    return [r["id"] for r in rows]


@query("SELECT id, archive, sequence FROM items", "items")
def scan_ids_in_order(spark, sf_dir):
    return S.items(spark, sf_dir).select("id", "archive", "sequence").distinct().orderBy("archive", "sequence", F.length("id"), "id")


@query("SELECT id, archive, orient FROM items WHERE archive IN (1, 3, 5) AND orient = 'v'", "items")
def pics_by_archive(spark, sf_dir):
    return S.items(spark, sf_dir).where(F.col("archive").isin(1, 3, 5) & (F.col("orient") == "v")).select("id", "archive", "orient").orderBy("archive", "id")


@query("SELECT id, sum_d0 FROM (SELECT id, sum_d0 FROM items ORDER BY sum_d0 DESC, id LIMIT 25)", "items")
def pics_by_sum_topk(spark, sf_dir):
    return S.items(spark, sf_dir).select("id", "sum_d0").orderBy(F.desc("sum_d0"), "id").limit(25)


@query("SELECT max(archive) AS archive FROM items", "items")
def max_group(spark, sf_dir):
    return S.items(spark, sf_dir).agg(F.max("archive").alias("archive"))


@query("SELECT DISTINCT archive FROM items", "items")
def distinct_groups(spark, sf_dir):
    return S.items(spark, sf_dir).select("archive").distinct()


CENTRED = """centred AS (SELECT *, aa - avg(aa) OVER (PARTITION BY orient) AS ca, bb - avg(bb) OVER (PARTITION BY orient) AS cb,
    r - avg(r) OVER (PARTITION BY orient) AS cr, g - avg(g) OVER (PARTITION BY orient) AS cg, b - avg(b) OVER (PARTITION BY orient) AS cbl FROM items)"""


def _centred(rows):
    """Colours about the mean of the orientation; the means are one row an orientation."""
    means = rows.groupBy("orient").agg(*[F.avg(c).alias(f"m_{c}") for c in ("aa", "bb", "r", "g", "b")])
    return rows.join(F.broadcast(means), "orient").withColumns({f"c_{c}": F.col(c) - F.col(f"m_{c}") for c in ("aa", "bb", "r", "g", "b")})


@query(f"""WITH {CENTRED} SELECT id, CAST(round(10000 * sqrt(ca * ca + cb * cb)) AS BIGINT) AS ab_radius,
    CAST(round(1000 * sqrt(cr * cr + cg * cg + cbl * cbl)) AS BIGINT) AS rgb_radius, CAST(round(degrees(atan2(ca, cb)), 0) AS INTEGER) AS ab_angle FROM centred""", "items")
def centroid_radii(spark, sf_dir):
    c = _centred(S.items(spark, sf_dir))
    a, b = F.col("c_aa"), F.col("c_bb")
    rgb = F.sqrt(F.col("c_r") * F.col("c_r") + F.col("c_g") * F.col("c_g") + F.col("c_b") * F.col("c_b"))
    return c.select("id", F.round(10000 * F.sqrt(a * a + b * b)).cast("long").alias("ab_radius"), F.round(1000 * rgb).cast("long").alias("rgb_radius"), F.round(F.degrees(F.atan2(a, b))).cast("int").alias("ab_angle"))


@query(f"""WITH {CENTRED}, told AS (SELECT id, CAST(round(degrees(atan2(ca, cb)), 0) AS INTEGER) AS ab_angle, CAST(round(10000 * sqrt(ca * ca + cb * cb)) AS BIGINT) AS ab_radius FROM centred)
    SELECT * FROM told WHERE ab_angle = (SELECT min(ab_angle) FROM told WHERE ab_angle >= 0)""", "items")
def pics_at_angle(spark, sf_dir):
    rows = centroid_radii(spark, sf_dir).select("id", "ab_angle", "ab_radius")
    wanted = rows.where("ab_angle >= 0").agg(F.min("ab_angle").alias("ab_angle"))
    return rows.join(F.broadcast(wanted), "ab_angle").select("id", "ab_angle", "ab_radius").orderBy("ab_radius", "id")  # one row


@query("""SELECT id, round(1 - list_cosine_similarity(vec, (SELECT vec FROM items WHERE sequence = 1)), 6) AS distance FROM items
    WHERE orient = 'v' AND sequence <> 1 AND sum_d0 % 10 <> 3 ORDER BY distance, id LIMIT 20""", "items")
def knn_cosine(spark, sf_dir):
    """Nearest neighbours of one item among the unseen items of its orientation."""
    items = S.items(spark, sf_dir)
    return knn.nearest_items(items, _first(spark, sf_dir)[0], seen=items.where("sum_d0 % 10 = 3"))


@query("""SELECT id, round(list_distance(vec, (SELECT vec FROM items WHERE sequence = 1)), 6) AS distance FROM items
    WHERE orient = 'v' AND sequence <> 1 AND archive <= 6 ORDER BY distance, id LIMIT 20""", "items")
def knn_l2(spark, sf_dir):
    items = S.items(spark, sf_dir)
    return knn.nearest_items(items, _first(spark, sf_dir)[0], view=items.where("archive <= 6"), metric="cartes")


LITERAL = [round(0.1 + 0.01 * (i % 7) - 0.02 * (i % 3), 4) for i in range(64)]


@query(f"SELECT id, round(1 - list_cosine_similarity(vec, {LITERAL}::DOUBLE[]), 6) AS distance FROM items ORDER BY distance, id LIMIT 15", "items")
def knn_literal(spark, sf_dir):
    return knn.nearest(S.items(spark, sf_dir), knn.literal(LITERAL), k=15)


@query("""WITH l AS (SELECT id, round(1 - list_cosine_similarity(vec_l, (SELECT vec_l FROM items WHERE sequence = 1)), 6) AS distance FROM items
      WHERE orient = 'v' AND sequence NOT IN (1, 3) ORDER BY distance, id LIMIT 20),
    r AS (SELECT id, round(1 - list_cosine_similarity(vec_r, (SELECT vec_r FROM items WHERE sequence = 3)), 6) AS distance FROM items
      WHERE orient = 'v' AND sequence NOT IN (1, 3) AND id NOT IN (SELECT id FROM l) ORDER BY distance, id LIMIT 20)
    SELECT 'left' AS side, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM l
    UNION ALL SELECT 'right', CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER), id, distance FROM r""", "items")
def knn_dual_disjoint(spark, sf_dir):
    left, right, _ = _first(spark, sf_dir)
    return knn.nearest_pair(S.items(spark, sf_dir), left, right)


@query("""WITH m AS (SELECT list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] + p[2]) / 2) AS mid FROM items a, items b WHERE a.sequence = 1 AND b.sequence = 3)
    SELECT id, round(1 - list_cosine_similarity(vec, mid), 6) AS distance FROM items, m WHERE orient = 'v' AND sequence NOT IN (1, 3) ORDER BY distance, id LIMIT 20""", "items")
def knn_midpoint(spark, sf_dir):
    one, two, _ = _first(spark, sf_dir)
    return knn.nearest_midpoint(S.items(spark, sf_dir), one, two)


@query("""WITH s AS (SELECT l.qid, l.id, CAST(round(round(1 - list_cosine_similarity(i.vec, (SELECT vec FROM items WHERE sequence = 1)), 6) * 1e6) AS BIGINT) AS v,
      round(1 - list_cosine_similarity(i.vec, (SELECT vec FROM items WHERE sequence = 1)), 6) AS d FROM lists l JOIN items i USING (id))
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, id) - 1 AS INTEGER) AS rank, id,
      CAST(CASE WHEN min(v) OVER (PARTITION BY qid) < 0 THEN max(v) OVER (PARTITION BY qid) - 3 * min(v) OVER (PARTITION BY qid) + 1 - v
        ELSE max(v) OVER (PARTITION BY qid) + min(v) OVER (PARTITION BY qid) + 1 - v END AS BIGINT) AS value FROM s""", "lists")
def rerank_list(spark, sf_dir):
    from .pairs import lists

    return knn.rerank(lists(spark, sf_dir), S.items(spark, sf_dir), _first(spark, sf_dir)[0])


@query("""WITH d AS (SELECT a.id, b.id AS match_id, (1 - list_inner_product(a.v, a.v)) AS x, (1 - list_inner_product(b.v, b.v)) AS y, list_distance(a.v, b.v) AS e
      FROM (SELECT id, orient, list_transform(vec_l, lambda x: x / 2) AS v FROM items) a JOIN (SELECT id, orient, list_transform(vec_r, lambda x: x / 2) AS v FROM items) b ON a.id <> b.id),
    p AS (SELECT id, match_id, round(acosh(greatest(1.0, 1 + 2 * e * e / (greatest(1e-6, x) * greatest(1e-6, y)))), 6) AS distance FROM d)
    SELECT id, match_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, match_id) AS n FROM p) WHERE n = 1""", "items")
def min_vector_match(spark, sf_dir):
    rows = S.items(spark, sf_dir)
    half = lambda c: F.transform(c, lambda x: x / 2)
    return knn.best_match(rows.select("id", half("vec_l").alias("vec")), rows.select("id", half("vec_r").alias("vec")))


@query("""SELECT id, round(list_sum(list_transform(range(16), lambda i: folded[i + 1] * (i + 1))), 6) AS weighted, round(folded[1], 6) AS first_value FROM
    (SELECT id, list_transform(range(16), lambda i: (vec[i + 1] + vec[i + 17] + vec[i + 33] + vec[i + 49]) / 4) AS folded FROM items)""", "items")
def vector_fold(spark, sf_dir):
    f = S.items(spark, sf_dir).select("id", V.fold(F.col("vec"), 4).alias("f"))
    weighted = F.aggregate(F.transform("f", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return f.select("id", F.round(weighted, 6).alias("weighted"), F.round(F.get("f", F.lit(0)), 6).alias("first_value"))


@query("""SELECT CAST(floor(r / 64) AS INTEGER) AS r_bin, CAST(floor(g / 64) AS INTEGER) AS g_bin, CAST(floor(b / 64) AS INTEGER) AS b_bin, count(*) AS n FROM items GROUP BY ALL""", "items")
def histogram_fixed(spark, sf_dir):
    bins = [F.floor(F.col(c) / 64).cast("int").alias(f"{c}_bin") for c in ("r", "g", "b")]
    return S.items(spark, sf_dir).groupBy(*bins).agg(F.count("*").alias("n"))


@query(f"""WITH {CENTRED}, a AS (SELECT CAST(trunc(round(degrees(acos(greatest(-1, least(1, (x.ca * y.ca + x.cb * y.cb) / (sqrt(x.ca * x.ca + x.cb * x.cb) * sqrt(y.ca * y.ca + y.cb * y.cb)))))), 6)) AS INTEGER) AS angle
      FROM centred x JOIN centred y ON x.orient = y.orient AND x.sequence < y.sequence) SELECT angle, count(*) AS n FROM a GROUP BY angle""", "items")
def angle_histogram(spark, sf_dir):
    found = tiles.counted_pairs(_centred_ab(spark, sf_dir), "orient", "sequence", lambda a, b, first: _whole_angle(a, b))
    return found.groupBy(F.col("bin").cast("int").alias("angle")).agg(F.sum("n").alias("n"))


@query(f"""WITH {CENTRED} SELECT x.id AS id1, y.id AS id2, CAST(trunc(round(degrees(acos(greatest(-1, least(1, (x.ca * y.ca + x.cb * y.cb) / (sqrt(x.ca * x.ca + x.cb * x.cb) * sqrt(y.ca * y.ca + y.cb * y.cb)))))), 6)) AS INTEGER) AS angle
      FROM centred x JOIN centred y ON x.orient = y.orient AND x.sequence < y.sequence""", "items")
def centroid_angle_pairs(spark, sf_dir):
    def choose(a, b, first):
        angle = _whole_angle(a, b)
        return None, {"angle": lambda i, j, forward: angle[i, j].astype("int32")}

    return tiles.chosen_pairs(_centred_ab(spark, sf_dir), "orient", "sequence", choose, "angle int")


def _centred_ab(spark, sf_dir):
    return _centred(S.items(spark, sf_dir)).select("id", "sequence", "orient", "c_aa", "c_bb")


def _whole_angle(a, b):
    """``_between`` of every row of a block and of a tile."""
    outer = lambda c: a[c][:, None] * b[c]
    one, two = (np.sqrt(x["c_aa"] * x["c_aa"] + x["c_bb"] * x["c_bb"]) for x in (a, b))
    size = one[:, None] * two
    cosine = np.divide(outer("c_aa") + outer("c_bb"), size, out=np.ones(size.shape), where=size != 0)
    return np.round(np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0))), 6).astype("int64")


def _between(p, *axes):
    """Whole degrees between two centred colours; 0 if one of them is the centre."""
    dot = sum(F.col(f"c_{c}_1") * F.col(f"c_{c}_2") for c in axes)
    one, two = (F.sqrt(sum(F.col(f"c_{c}_{k}") * F.col(f"c_{c}_{k}") for c in axes)) for k in (1, 2))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (one * two)))
    return F.when(one * two == 0, 0).otherwise(F.round(F.degrees(F.acos(cosine)), 6).cast("int"))


def _lab(k):
    return [F.col(f"{c}_{k}").cast("double") for c in ("ll", "aa", "bb")]


@query(f"""WITH {CENTRED}, p AS (SELECT x.id AS id1, y.id AS id2, x.orient, x.r - y.r AS dr, x.g - y.g AS dg, x.b - y.b AS db, x.ll - y.ll AS dl, x.aa - y.aa AS da, x.bb - y.bb AS dbb,
      x.cr AS r1, y.cr AS r2, x.cg AS g1, y.cg AS g2, x.cbl AS b1, y.cbl AS b2, sqrt(x.aa * x.aa + x.bb * x.bb) AS c1, sqrt(y.aa * y.aa + y.bb * y.bb) AS c2
      FROM centred x JOIN centred y ON x.orient = y.orient AND x.sequence < y.sequence)
    SELECT id1, id2, orient, round(sqrt(dr * dr + dg * dg + db * db), 6) AS d_rgb, round(sqrt(dl * dl + da * da + dbb * dbb), 6) AS d_e,
      CAST(trunc(round(degrees(atan2(CAST(dbb AS DOUBLE), CAST(da AS DOUBLE))), 6)) AS INTEGER) AS angle,
      CAST(trunc(round(degrees(acos(greatest(-1, least(1, (r1 * r2 + g1 * g2 + b1 * b2) / (sqrt(r1 * r1 + g1 * g1 + b1 * b1) * sqrt(r2 * r2 + g2 * g2 + b2 * b2)))))), 6)) AS INTEGER) AS rgb_angle,
      round(sqrt(dl * dl + ((c2 - c1) / (1 + 0.045 * c1)) ** 2 + greatest(0, da * da + dbb * dbb - (c2 - c1) ** 2) / (1 + 0.015 * c1) ** 2), 6) AS d_e94 FROM p""", "items")
def pair_colors(spark, sf_dir):
    c = _centred(S.items(spark, sf_dir)).select("id", "sequence", "orient", "r", "g", "b", "ll", "aa", "bb", "c_r", "c_g", "c_b")
    p = pairs.ordered_pairs(c, "orient", "sequence")
    rgb = [[F.col(f"{c}_{k}") for c in ("r", "g", "b")] for k in (1, 2)]
    angle = F.degrees(F.atan2((F.col("bb_1") - F.col("bb_2")).cast("double"), (F.col("aa_1") - F.col("aa_2")).cast("double")))
    return p.select(
        F.col("id_1").alias("id1"), F.col("id_2").alias("id2"), "orient", F.round(C.delta_rgb(*rgb), 6).alias("d_rgb"), F.round(C.delta_rgb(_lab(1), _lab(2)), 6).alias("d_e"),
        F.round(angle, 6).cast("int").alias("angle"), _between(p, "r", "g", "b").alias("rgb_angle"), F.round(C.delta_e94(_lab(1), _lab(2)), 6).alias("d_e94"),
    )


@query("""WITH c AS (SELECT x.id AS id1, y.id AS id2, x.ll - y.ll AS dl, x.aa - y.aa AS da, x.bb - y.bb AS db, sqrt(x.aa * x.aa + x.bb * x.bb) AS c1, sqrt(y.aa * y.aa + y.bb * y.bb) AS c2
      FROM items x JOIN items y ON x.orient = y.orient AND x.sequence < y.sequence)
    SELECT id1, id2, round(sqrt(dl * dl + ((c2 - c1) / (1 + 0.045 * c1)) ** 2 + greatest(0, da * da + db * db - (c2 - c1) ** 2) / (1 + 0.015 * c1) ** 2), 6) AS d_e94 FROM c""", "items")
def delta_e94(spark, sf_dir):
    p = pairs.ordered_pairs(S.items(spark, sf_dir).select("id", "sequence", "orient", "ll", "aa", "bb"), "orient", "sequence")
    return p.select(F.col("id_1").alias("id1"), F.col("id_2").alias("id2"), F.round(C.delta_e94(_lab(1), _lab(2)), 6).alias("d_e94"))


def _e2000(standard, between=None):
    """The 2000 difference in SQL, in the steps of its definition; ``between`` gives ``id1, id2`` and both colours."""
    mean = "pow(mc, 7)" if standard else "mc"
    tail = "sqrt(sq + dcs * dcs)" if standard else "sqrt(abs(sq))"
    between = between or "SELECT x.id AS id1, y.id AS id2, x.ll::DOUBLE AS l1, y.ll::DOUBLE AS l2, x.aa::DOUBLE AS ra1, y.aa::DOUBLE AS ra2, x.bb::DOUBLE AS b1, y.bb::DOUBLE AS b2 FROM items x JOIN items y ON x.orient = y.orient AND x.sequence < y.sequence"
    return f"""p0 AS ({between}),
    p1 AS (SELECT *, (sqrt(ra1 * ra1 + b1 * b1) + sqrt(ra2 * ra2 + b2 * b2)) / 2 AS mc FROM p0), p2 AS (SELECT *, 1 + 0.5::DOUBLE * (1 - sqrt({mean} / (pow(mc, 7) + pow(25::DOUBLE, 7)))) AS g FROM p1),
    p3 AS (SELECT *, g * ra1 AS a1, g * ra2 AS a2 FROM p2), p4 AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, {_hue_sql("a1", "b1")} AS h1, {_hue_sql("a2", "b2")} AS h2 FROM p3),
    p5 AS (SELECT *, c1 * c2 > 0.001 AS col, h2 - h1 AS gap, (c1 + c2) / 2 AS ch FROM p4),
    p6 AS (SELECT *, CASE WHEN NOT col THEN 0 WHEN abs(floor(gap + 0.5)) <= 180 THEN gap WHEN gap > 0 THEN gap - 360 ELSE gap + 360 END AS step,
      CASE WHEN NOT col THEN h1 + h2 WHEN abs(floor(gap + 0.5)) > 180 THEN (CASE WHEN h1 + h2 < 360 THEN h1 + h2 + 360 ELSE h1 + h2 - 360 END) / 2 ELSE (h1 + h2) / 2 END AS mh FROM p5),
    p7 AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS t, pow((l1 + l2) / 2 - 50, 2) AS li FROM p6),
    p8 AS (SELECT *, (l2 - l1) / (1 + 0.015 * li / sqrt(20 + li)) AS dls, (c2 - c1) / (1 + 0.045 * ch) AS dcs, 2 * sqrt(c1 * c2) * sin(radians(step / 2)) / (1 + 0.015 * ch * t) AS dhs,
      -sin(radians(2 * 30 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(ch, 7) / (pow(ch, 7) + pow(25::DOUBLE, 7))) AS rot FROM p7),
    p9 AS (SELECT id1, id2, dls * dls + dhs * dhs + rot * dcs * dhs AS sq, dcs FROM p8) SELECT id1, id2, round({tail}, 6) AS d FROM p9"""


def _hue_sql(a, b):
    return HUE_SQL.format(a=a, b=b)


HUE_SQL = """CASE WHEN abs({b}) < 0.001 THEN CASE WHEN {a} >= 0 THEN 0 ELSE 180 END WHEN abs({a}) < 0.001 THEN CASE WHEN {b} > 0 THEN 90 ELSE 270 END
    WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"""


@query(f"SELECT id1, id2, o.d AS d_e2000, s.d AS d_e2000_std FROM (WITH {_e2000(False)}) o JOIN (WITH {_e2000(True)}) s USING (id1, id2)", "items")
def delta_e2000(spark, sf_dir):
    """Both variants of the 2000 difference."""
    p = pairs.ordered_pairs(S.items(spark, sf_dir).select("id", "sequence", "orient", "ll", "aa", "bb"), "orient", "sequence")
    return p.select(F.col("id_1").alias("id1"), F.col("id_2").alias("id2"), F.round(C.delta_e2000(_lab(1), _lab(2)), 6).alias("d_e2000"), F.round(C.delta_e2000_std(_lab(1), _lab(2)), 6).alias("d_e2000_std"))


@query("""SELECT a.id AS id1, b.id AS id2, CASE WHEN a.archive = b.archive THEN 'pair' WHEN a.people OR b.people THEN 'item' ELSE 'colour' END AS source,
    round(CASE WHEN a.archive = b.archive THEN 1 - list_cosine_similarity(a.vec_l, b.vec_r) WHEN a.people OR b.people THEN 1 - list_cosine_similarity(a.vec, b.vec)
      ELSE sqrt((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) END, 6) AS distance FROM items a JOIN items b ON a.orient = b.orient AND a.sequence < b.sequence""", "items")
def vec_dist_fallback(spark, sf_dir):
    p = pairs.ordered_pairs(S.items(spark, sf_dir).select("id", "sequence", "orient", "archive", "people", "vec", "vec_l", "vec_r", "r", "g", "b"), "orient", "sequence")
    own = F.when(F.col("archive_1") == F.col("archive_2"), F.round(V.cosine_distance(F.col("vec_l_1"), F.col("vec_r_2")), 6))
    item = F.when(F.col("people_1") | F.col("people_2"), F.round(V.cosine_distance(F.col("vec_1"), F.col("vec_2")), 6))
    colour = F.round(C.delta_rgb([F.col(f"{c}_1") for c in "rgb"], [F.col(f"{c}_2") for c in "rgb"]), 6)
    return knn.pair_distance(p, own, item, colour).select(F.col("id_1").alias("id1"), F.col("id_2").alias("id2"), "source", "distance")


@query("""SELECT id, CAST(string_split(id, '/')[1] AS INTEGER) AS archive, CAST(regexp_extract(id, '/(\\d+)', 1) AS INTEGER) AS sequence, '' AS tag FROM items""", "items")
def parse_ids(spark, sf_dir):
    rows = S.items(spark, sf_dir).select("id")
    parts = T.id_parts(F.col("id"))
    return rows.select("id", parts["archive"].alias("archive"), parts["sequence"].alias("sequence"), parts["tag"].alias("tag"))


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS shown FROM (SELECT event_id, event_id * 7919 AS m FROM events)""")
def format_interval(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select("event_id", T.format_interval(F.col("event_id") * 7919).alias("shown"))


@query("SELECT CAST(least(2, floor(b * 3 / 256)) * 3 + least(2, floor(r * 3 / 256)) AS INTEGER) AS cell, count(*) AS n FROM items GROUP BY cell", "items")
def grid_3x3(spark, sf_dir):
    return S.items(spark, sf_dir).groupBy(T.grid_3x3(F.col("r"), F.col("b"), F.lit(256), F.lit(256)).alias("cell")).agg(F.count("*").alias("n"))


@query("""SELECT id FROM items WHERE orient = 'v' AND archive IN (1, 2) EXCEPT SELECT id2 FROM seen WHERE id1 = (SELECT id FROM items WHERE sequence = 1)""", "seen")
def unseen_items(spark, sf_dir):
    seen = S.seen_pairs(spark, sf_dir).where(F.col("id1") == _first(spark, sf_dir)[0]).select(F.col("id2").alias("id"))
    return S.items(spark, sf_dir).where("orient = 'v' and archive in (1, 2)").select("id").join(seen, "id", "left_anti")


@query("""SELECT 'all' AS view, id FROM items UNION ALL SELECT 'arch 1 2', id FROM items WHERE archive IN (1, 2) UNION ALL SELECT 'kwd face people', id FROM items WHERE face OR people
    UNION ALL SELECT 'bad 10', id FROM (SELECT id, row_number() OVER (PARTITION BY orient ORDER BY sum_d0, id) AS n, floor(count(*) OVER (PARTITION BY orient) * 10 / 100) AS most FROM items) WHERE n <= most""", "items")
def view_resolve(spark, sf_dir):
    """Named views as sets of ids."""
    items = S.items(spark, sf_dir)
    marks = F.array_compact(F.array(F.when(F.col("face"), "face"), F.when(F.col("people"), "people")))
    words = items.select("id", F.lit("m").alias("coder"), F.explode(marks).alias("word"))
    views = [views_op.resolve(v, items, words).withColumn("view", F.lit(v)) for v in ("all", "arch 1 2", "kwd face people", "bad 10", "dummy")]
    return reduce(DataFrame.unionByName, views).select("view", "id")


@query("""SELECT id, value FROM (SELECT id, max(sum_d0) OVER () + min(sum_d0) OVER () + 1 - sum_d0 AS value FROM items WHERE archive IN (2, 4))""", "items")
def value_list_sorted(spark, sf_dir):
    rows = S.items(spark, sf_dir).where("archive in (2, 4)").select("id", F.col("sum_d0").alias("value"))
    ends = rows.agg((F.max("value") + F.min("value") + 1).alias("top"))
    return rows.crossJoin(F.broadcast(ends)).select("id", (F.col("top") - F.col("value")).alias("value")).orderBy("value", "id")  # one row


@query("SELECT p_partkey AS id, p_name, p_value FROM (SELECT p_partkey, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part) UNPIVOT (p_value FOR p_name IN (p_brand, p_type, p_size))")
def item_properties(spark, sf_dir):
    return S.item_props(spark, sf_dir)


@query("""WITH c AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2), n AS (SELECT n_nationkey, n_name FROM nation)
    SELECT * FROM c UNION ALL SELECT * FROM n WHERE n_nationkey NOT IN (SELECT n_nationkey FROM c)""")
def insert_if_absent(spark, sf_dir):
    rows = S.table(spark, sf_dir, "nation")
    return labels.insert_if_absent(rows.where("n_regionkey < 2").select("n_nationkey", "n_name"), rows.select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT p_type AS tag, count(*) AS ct FROM part GROUP BY p_type")
def tag_counts(spark, sf_dir):
    return S.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count("*").alias("ct"))


@query("""WITH t AS (SELECT p_type AS tag, count(*) % 5 + 1 AS ct FROM part GROUP BY p_type) SELECT tag, CASE WHEN ct = 1 THEN tag ELSE concat(tag, '|', n) END AS expanded
    FROM (SELECT tag, ct, unnest(range(1, ct + 1)) AS n FROM t)""")
def expand_tags(spark, sf_dir):
    tags = tag_counts(spark, sf_dir).select("tag", (F.col("ct") % 5 + 1).alias("ct"))
    rows = tags.select("tag", "ct", F.explode(F.expr("sequence(1L, ct)")).alias("n"))
    return rows.select("tag", F.when(F.col("ct") == 1, F.col("tag")).otherwise(F.concat_ws("|", "tag", "n")).alias("expanded"))


@query("SELECT p_partkey AS id, p_brand AS brand, 3 AS n FROM part")
def properties_as_map(spark, sf_dir):
    """Each item's properties as one map."""
    maps = S.item_props(spark, sf_dir).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "p_value"))).alias("m"))
    return maps.select("id", F.element_at("m", "p_brand").alias("brand"), F.size("m").alias("n"))


@query("SELECT to_json({'id': id, 'archive': archive, 'rgb': [r, g, b], 'people': people}) AS line FROM items", "items")
def items_as_json(spark, sf_dir):
    return S.items(spark, sf_dir).select(F.to_json(F.struct("id", "archive", F.array("r", "g", "b").alias("rgb"), "people")).alias("line"))


@query("SELECT id, archive, sequence, orient, r, g, b FROM items WHERE id IN (SELECT id FROM items WHERE archive IN (2, 3) AND orient = 'h')", "items")
def full_rows_in_order(spark, sf_dir):
    items = S.items(spark, sf_dir)
    wanted = items.where("archive in (2, 3) and orient = 'h'").select("id")
    return items.join(wanted, "id", "left_semi").select("id", "archive", "sequence", "orient", "r", "g", "b").orderBy("archive", "sequence", F.length("id"), "id")
