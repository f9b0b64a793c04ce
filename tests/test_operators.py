"""Kernels by hand values, operators without SQL by brute force, edge cases."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import colours as C
from tandem.functions import text as T
from tandem.functions import vectors as V
from tandem.operators import activity, blocks, keywords, knn, labels, pairs, ranked, search, topk
from tandem.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_kernels(spark):
    assert one(spark, V.cosine_similarity(vec(0, 0), vec(0, 0))) == 1.0
    assert one(spark, V.cosine_similarity(vec(1, 0), vec(0, 0))) == 1.0  # 0 / 0: the product is 0 as well
    assert one(spark, V.cartesian(vec(0, 3), vec(4, 0))) == 5.0
    assert one(spark, V.poincare(vec(0, 0), vec(0, 0))) == 0.0
    assert one(spark, V.poincare(vec(0, 0), vec(0.5, 0))) == pytest.approx(math.acosh(1 + 2 * 0.25 / 0.75))
    assert one(spark, V.fold(vec(1, 2, 3, 4), 2)) == [2.0, 3.0]
    assert one(spark, V.normalise(vec(0, 0))) == [0.0, 0.0]
    assert one(spark, V.hellinger(vec(1, 1), vec(2, 2))) == 0.0
    assert one(spark, V.extrapolate(vec(0, 1), vec(1, 1), 2.0)) == [2.0, 1.0]


def test_colours(spark):
    lab = lambda *v: [F.lit(float(x)) for x in v]
    # published test values of the 2000 formula
    assert one(spark, C.delta_e2000_std(lab(50, 2.6772, -79.7751), lab(50, 0, -82.7485))) == pytest.approx(2.0425, abs=1e-4)
    assert one(spark, C.delta_e2000_std(lab(50, 2.5, 0), lab(73, 25, -18))) == pytest.approx(27.1492, abs=1e-4)
    assert one(spark, C.delta_e2000(lab(50, 10, 10), lab(50, 10, 10))) == 0.0
    assert one(spark, C.delta_e94(lab(50, 0, 0), lab(60, 0, 0))) == 10.0
    white = spark.range(1).select(*[c.alias(n) for c, n in zip(C.rgb_to_lab(F.lit(255), F.lit(255), F.lit(255)), "lab")]).first()
    assert white["l"] == pytest.approx(100, abs=0.01) and abs(white["a"]) < 0.02
    assert [one(spark, c) for c in C.rgb_to_hsv(F.lit(0), F.lit(0), F.lit(255))] == pytest.approx([2 / 3, 1, 1])


def test_text(spark):
    parts = T.id_parts(F.lit("7/0042:3b"))
    assert [one(spark, parts[k]) for k in ("archive", "sequence", "sequence2", "tag")] == [7, 42, 3, "b"]
    assert one(spark, T.format_interval(F.lit(3_723_004))) == "01:02:03.004"
    assert one(spark, T.munge(F.lit("seaplanes"))) == ["seaplane", "airplane"]
    assert one(spark, T.munge(F.lit("glass"))) == ["glass"]
    assert one(spark, T.is_geometry(F.lit("curve_x"))) and not one(spark, T.is_geometry(F.lit("tree")))
    assert one(spark, T.decode64(F.lit("10"))) == 64
    assert one(spark, T.grid_3x3(F.lit(99), F.lit(50), F.lit(99), F.lit(99))) == 5


def test_all_pairs_are_complete_for_any_blocks(spark):
    items = spark.range(23).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    for blocks in (1, 3, 8):
        got = {(r["k_1"], r["k_2"]) for r in pairs.ordered_pairs(items, "g", "k", blocks).collect()}
        assert got == {(a, b) for a in range(23) for b in range(a + 1, 23) if (a - b) % 2 == 0}
        assert pairs.ordered_pairs(items, "g", "k", blocks).count() == len(got)


def test_block_metrics_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(f"1/{i}", i, "vh"[i % 2], rng.normal(size=4).tolist() if i else [0.0] * 4) for i in range(21)]
    items = spark.createDataFrame(rows, "id string, sequence int, orient string, vec array<double>").withColumns({"vec_l": F.slice("vec", 1, 2), "vec_r": F.slice("vec", 3, 2)})
    for size in (4, 100):
        got = {(r["seq1"], r["seq2"]): r for r in blocks.pair_metrics(items, size).collect()}
        assert set(got) == {(a, b) for a in range(21) for b in range(a + 1, 21) if (a - b) % 2 == 0}
        for (a, b), r in got.items():
            x, y = np.array(rows[a][3]), np.array(rows[b][3])
            assert r["distance"] == pytest.approx(np.linalg.norm(x - y)) and r["d012"] == math.floor((1 + x[:2] @ y[2:]) * 1e6) and r["d021"] == math.floor((1 + y[:2] @ x[2:]) * 1e6)
            assert r["cosine"] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y) if a else 1.0)
    assert blocks.pair_metrics(items.where("false")).count() == 0


def test_quota_matches_the_rule(spark):
    rng = random.Random(3)
    rows = [(f"{a % 3}/{a}", f"{b % 3}/{b}", rng.randrange(20)) for a in range(12) for b in range(12) if a != b]
    frame = spark.createDataFrame(rows, "id string, other string, value int")
    want = set()
    for i in {r[0] for r in rows}:
        g = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == i), key=lambda r: (-r[2], r[1])), 1):
            same = r[0][0] == r[1][0]
            g += same
            if n <= 4 or (same and g <= 2):
                want.add(r)
    got = topk.quota(frame, F.substring_index("id", "/", 1) == F.substring_index("other", "/", 1), 4, 2)
    assert {tuple(r) for r in got.collect()} == want


def test_greedy_is_one_pass_in_order(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(200)})
    rows = [(f"{a:02}", f"{b:02}", rng.randrange(30)) for a, b in rows if a < b]
    used, want = set(), []
    for a, b, v in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, v))
    got = topk.greedy_disjoint(spark.createDataFrame(rows, "id1 string, id2 string, value int"), 7)
    assert [tuple(r) for r in got.collect()] == want[:7]
    assert topk.greedy_disjoint(spark.createDataFrame([], "id1 string, id2 string, value int")).count() == 0


def test_higuchi_matches_direct_computation(spark):
    x = [float((i * 37) % 23) for i in range(40)]
    n, pts = len(x), []
    for k in range(1, n // 3 + 1):
        total = 0.0
        for m in range(1, k + 1):
            steps = (n - m) // k
            total += sum(abs(x[m - 1 + i * k] - x[m - 1 + (i - 1) * k]) for i in range(1, steps + 1)) * (n - 1) / steps / k / k
        pts.append((math.log(k), math.log(total / k)))
    slope = np.polyfit(*zip(*pts), 1)[0]
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, 0, 1.0)], "browser_id long, id long, user_time double").withColumn("create_time", F.timestamp_seconds("id"))
    got = {r["browser_id"]: r["dimension"] for r in activity.higuchi(log).collect()}
    assert got[1] == pytest.approx(-slope, abs=1e-5) and got[2] == 0


def test_lists_edge_cases(spark):
    rows = spark.createDataFrame([("q", i, f"i{i:02}", -i) for i in range(25)] + [("s", 0, "only", 5)], "qid string, rank int, id string, value long")
    assert [r["id"] for r in ranked.centre_out(rows.where("qid = 'q'"), 0, wrap=True).orderBy("rank").limit(3).collect()] == ["i00", "i24", "i01"]
    assert [tuple(r) for r in ranked.reverse(rows.where("qid = 's'")).collect()] == [("s", 0, "only", -4)]  # spread 0, plus 1, less 5
    assert ranked.stratify(rows, 0.5).where("qid = 'q' and rank = 0").first()["id"] == "i12"
    assert ranked.invert_values(rows).where("qid = 'q' and rank = 0").first()["value"] == 0 + 72 + 1
    empty = rows.where("false")
    for f in (ranked.invert_values, ranked.invert_shifted, ranked.reverse):
        assert f(empty).count() == 0


def test_label_states(spark):
    rows = [("a", "b", 1), ("a", "c", 2), ("a", "d", 0)]
    at = F.lit("2024-01-01").cast("timestamp_ntz").alias("create_time")
    now = spark.createDataFrame(rows, "id1 string, id2 string, status int").select("*", at)
    new = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("a", "d", 0), ("x", "y", 2)], "id1 string, id2 string, status int").select("*", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz").alias("create_time"))
    got = {(r["id1"] + r["id2"]): (r["status"], r["action"]) for r in labels.apply_labels(now, new).collect()}
    assert got == {"ab": (1, "kept"), "ac": (1, "flipped"), "ad": (1, "updated"), "xy": (2, "inserted")}


def test_neighbours_without_any(spark):
    items = spark.createDataFrame([("1/1", "v", [1.0, 0.0])], "id string, orient string, vec array<double>")
    assert knn.nearest_items(items, "1/1").count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "v.vecs").write_text("1:2 l 0.5 1\n1:2 r 2 3\n")
    assert tuple(files.read_side_vectors(spark, f"file://{tmp_path}/v.vecs").first()) == (1, 2, [0.5, 1.0], [2.0, 3.0])
    np.array([[0, 0.25], [0.5, 1]], ">f4").tofile(tmp_path / "m.pairs")
    got = {(r["i"], r["j"]): (r["p"], r["scaled"]) for r in files.read_score_matrix(spark, f"file://{tmp_path}/m.pairs", 2).collect()}
    assert got == {(0, 0): (0.0, 10_000_000), (0, 1): (0.25, 7_500_000), (1, 0): (0.5, 5_000_000), (1, 1): (1.0, 0)}
    (tmp_path / "a").write_text("x y 1 2\n")
    (tmp_path / "b").write_text("x z 1 2\n")
    with pytest.raises(Exception, match="not in every file"):
        files.read_pair_lines(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]).collect()


def test_overlap_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(keywords, "PROFILE_BLOCK", 3)
    sets = [("red ring",) * 9, ("red bolt",) * 7, ("ring", "only"), ("blue",)]
    texts = [t for group in sets for t in group]
    tokens = [(i, c, w) for i, t in enumerate(texts) for c, w in [("k", w) for w in t.split()] + ([("other", "red")] if i % 5 == 0 else [])]
    got = {(r["id1"], r["id2"]): r for r in keywords.overlap(spark.createDataFrame(tokens, "id int, coder string, word string")).collect()}
    own = {i: {(c, w) for j, c, w in tokens if j == i} for i in range(len(texts))}
    n = Counter(w for _, _, w in tokens)
    want = {(a, b): own[a] & own[b] for a in own for b in own if a < b and own[a] & own[b]}
    assert set(got) == set(want)
    for key, shared in want.items():
        assert got[key]["matches"] == len(shared)
        assert got[key]["score"] == pytest.approx(sum(n[w] ** -5.0 for _, w in shared), abs=1e-8)
        assert got[key]["ratio"] == int(len(shared) * 1000 / math.sqrt(len(own[key[0]]) * len(own[key[1]])))


def test_circles(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k, (x, y, r, noise, arc) in enumerate([(3, -4, 10, 0, 6.28), (500, 200, 80, 0, 1.5), (0, 0, 20, 0.5, 6.28)]):
        angle = rng.uniform(0, arc, 400)
        far = r + rng.normal(0, noise, 400) if noise else r
        rows += [(k, float(a), float(b)) for a, b in zip(x + far * np.cos(angle), y + far * np.sin(angle))]
    rows += [(7, float(i), 2.0 * i) for i in range(9)] + [(8, 1.0, 1.0)] * 3 + [(9, None, 1.0)]
    got = {r["k"]: r for r in search.fit_circles(spark.createDataFrame(rows, "k int, x double, y double"), "k").collect()}
    for k, want in ((0, (3, -4, 10)), (1, (500, 200, 80))):
        assert (got[k]["x"], got[k]["y"], got[k]["radius"]) == pytest.approx(want, abs=1e-5) and got[k]["rms"] < 1e-4
    assert (got[2]["x"], got[2]["y"], got[2]["radius"]) == pytest.approx((0, 0, 20), abs=0.15) and got[2]["rms"] == pytest.approx(0.5, abs=0.1)
    assert got[7]["radius"] is None and got[8]["radius"] is None and 9 not in got


def test_numbered_and_owed_walk_in_order(spark):
    import random

    from tandem.operators.shared import numbered, owed

    rng = random.Random(4)
    rows = [(i, "big" if i % 10 else "small", rng.randint(0, 50), rng.random() < 0.3, rng.random() < 0.25) for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, g string, v int, owes boolean, pays boolean").repartition(6)
    got = {r["id"]: r["place"] for r in numbered(frame, "g", F.desc("v"), "id").collect()}
    paid = {r["id"]: r["paid"] for r in owed(frame, "g", F.col("owes"), F.col("pays"), F.desc("v"), "id").collect()}
    for g in ("big", "small"):
        own, debt = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 0
        for n, r in enumerate(own):
            debt += r[3]
            settles = r[4] and debt > 0
            debt -= settles
            assert (got[r[0]], paid[r[0]]) == (n, settles)


def test_greedy_choice_in_runs(spark, monkeypatch):
    import random

    from tandem.operators import topk

    rng = random.Random(5)
    rows = [(f"a{rng.randrange(40)}", f"b{rng.randrange(40)}", rng.randrange(1000)) for _ in range(900)]
    used, want = set(), []
    for v, a, b in sorted({(v, a, b) for a, b, v in rows}):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, v))
    frame = spark.createDataFrame(rows, "id1 string, id2 string, value long").distinct()
    for run in (70, 100_000):
        monkeypatch.setattr(topk, "RUN", run)
        for limit in (7, 1000):
            assert [tuple(r) for r in topk.greedy_disjoint(frame, limit).collect()] == want[:limit]
    assert topk.greedy_disjoint(frame.where("false")).count() == 0


def test_uneven_list_is_refused(spark):
    from tandem.operators import topk

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, n int")
    with pytest.raises(Exception, match="different numbers"):
        topk.first_n_of_even(rows, "id", 1, "n").collect()


def test_nearest_in_many_blocks(spark, monkeypatch):
    from tandem.functions import vectors as V
    from tandem.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    rng = np.random.default_rng(6)
    rows = [(f"{i:03d}", "x" if i % 3 else "y", (rng.integers(-2, 3, 4) / 8).tolist()) for i in range(70)]
    frame = spark.createDataFrame(rows, "id string, g string, vec array<double>")
    for metric in ("cosine_distance", "cartes", "poinca"):
        met = frame.alias("a").join(frame.alias("b"), F.expr("a.g = b.g and a.id <> b.id")).select(F.col("a.id").alias("id"), F.col("b.id").alias("match_id"), F.round(V.metric(metric, F.col("a.vec"), F.col("b.vec")), 6).alias("d"))
        want = {}
        for r in met.collect():
            want.setdefault(r["id"], []).append((r["d"], r["match_id"]))
        got = {}
        for r in blocks.nearest(frame, frame, 5, metric, "g").orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["distance"], r["match_id"]))
        assert {k: [m for _, m in v] for k, v in got.items()} == {k: [m for _, m in sorted(v)[:5]] for k, v in want.items()}


def test_vector_function_names():
    from tandem.functions.vectors import vector_function

    assert vector_function("") == {"metric": "cosine_distance", "kind": "imagenet", "width": 4}
    assert vector_function("poinca.2.vgg16_8") == {"metric": "poinca", "kind": "imagenet", "width": 8}
    assert vector_function("cartes.2.densenet121")["width"] == 1024 and vector_function("cartes.1.histo_ml")["width"] == 1984
    assert vector_function("cartes.1.hist1728")["width"] == 1728 and vector_function("cosine.1.zzz")["width"] == 256
    assert vector_function("cosine.3.pair12")["width"] == 12 and vector_function("cosine.3.9")["width"] == 3
    with pytest.raises(ValueError):
        vector_function("nope.2.vgg16")


def test_colours_there_and_back(spark):
    from tandem.functions import colours as C

    rows = spark.createDataFrame([(r, g, b) for r in (0, 9, 128, 255) for g in (0, 77, 255) for b in (0, 200, 255)], "r int, g int, b int")
    rgb = [F.col(c) for c in "rgb"]
    back = C.xyz_to_rgb(*C.rgb_to_xyz(*rgb))
    turned = C.hsv_to_rgb(*C.rgb_to_hsv(*rgb))
    for r in rows.select(*rgb, F.array(*back).alias("x"), F.array(*[F.round(c * 255).cast("int") for c in turned]).alias("h")).collect():
        assert [r["r"], r["g"], r["b"]] == r["h"] and all(abs(a - b) <= 1 for a, b in zip(r["x"], r["h"]))


def test_small_text_functions(spark):
    from tandem.functions import text as T

    one = spark.range(1).select(
        T.lossy_mult(F.lit(7.0), F.lit(1.3)).alias("a"), T.lossy_sqrt_divide(F.lit(10.0), F.lit(4.0)).alias("b"), T.lossy_sqrt_divide(F.lit(10.0), F.lit(0.0)).alias("c"),
        T.normalised_dimension(F.lit("1.2345")).alias("d"), T.normalised_dimension(F.lit("x")).alias("e"), T.decode64(T.encode64(F.lit(123456789))).alias("f"), T.encode64(F.lit(0)).alias("g"),
        T.is_face(F.lit("expr_sad")).alias("h"), T.is_warm(F.lit("owls"), []).alias("i"), T.is_warm(F.lit("scarf"), ["scarf"]).alias("j"), T.is_warm(F.lit("stone"), ["scarf"]).alias("k"),
    ).first()
    assert tuple(one) == (9, 5, 5, 1235, None, 123456789, "0", True, True, True, False) or tuple(one) == (9, 5, 5, 1234, None, 123456789, "0", True, True, True, False)


def test_files_written_and_read(spark, tmp_path):
    from tandem.sources import files

    (tmp_path / "values.txt").write_text("1/2 17\n3/4 5\n\n")
    (tmp_path / "words.txt").write_text("2 3\nriver 1 2 3\nhill 4 5 6\n")
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.txt").write_text("0.5 1.5\n2.5")
    assert sorted(map(tuple, files.read_id_values(spark, str(tmp_path / "values.txt")).collect())) == [("1/2", 17), ("3/4", 5)]
    assert {r["word"]: r["vec"] for r in files.read_word_vectors(spark, str(tmp_path / "words.txt")).collect()} == {"river": [1.0, 2.0, 3.0], "hill": [4.0, 5.0, 6.0]}
    assert files.read_text_histograms(spark, str(tmp_path / "h")).first()["histo"] == [0.5, 1.5, 2.5]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.hist").write_bytes(np.array([0.25, 3.0], ">f4").tobytes())
    assert files.read_binary_histograms(spark, str(tmp_path / "b")).first()["histo"] == [0.25, 3.0]
    assert [r["name"] for r in files.discover_files(spark, str(tmp_path / "h"), "*.txt").collect()] == ["1.txt"]
    pairs = spark.createDataFrame([("1/1", "1/3", "v", 5), ("1/2", "1/4", "h", 6)], "id1 string, id2 string, orient string, d012 long")
    files.write_pairs(pairs, str(tmp_path / "pairs"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "pairs")).select(*pairs.columns).collect())) == sorted(map(tuple, pairs.collect()))
    files.write_neighbours(pairs.withColumn("tag", F.lit("t")), str(tmp_path / "near"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "near" / "tags")).select("tag", "ct").collect()] == [("t", 2)]
    files.write_csv(pairs, str(tmp_path / "csv"), ["d012"])
    assert [r["d012"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["5", "6"]


def test_screens_swap_and_histograms_widen(spark):
    from tandem.operators import histograms, labels

    shown = spark.createDataFrame([(0, "now"), (1, "before"), (-1, "old")], "depth int, id string")
    assert {r["id"]: r["depth"] for r in labels.swap_screens(shown).collect()} == {"now": 1, "before": 0, "old": -1}
    pixels = spark.createDataFrame([("p", 0, 0, 0), ("p", 255, 255, 255), ("p", 255, 0, 0)], "id string, r int, g int, b int")
    wide = histograms.widened(histograms.colour_histograms(pixels), "grey", 128).first()["histo"]
    assert len(wide) == 128 and sum(wide) == 3 and wide[0] == wide[127] == 1 and wide[42] == 1
