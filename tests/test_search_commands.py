"""Search commands, strokes, the stored index, matrices and keyed state."""

from __future__ import annotations

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import blocks, commands, gestures, vindex
from tandem.sources import matrix
from tandem.streaming import state

CATALOG = commands.Catalog(("a_left", "a_right"), ("nn_1", "nn_2", "xx_1"), {"ones": ("nn_1", "xx_1", "gone"), "none": ("gone",)})


def test_commands_are_parsed():
    assert commands.parse("p_avg any", CATALOG) == commands.Command("score", ("any",))
    assert commands.parse(" p_avg  a_left ", CATALOG).names == ("a_left",)
    assert commands.parse("p_negpos A_LEFT a_right", CATALOG) == commands.Command("difference", ("a_left", "a_right"))
    assert commands.parse("pt_group ones none", CATALOG) == commands.Command("drawn", ("nn_1", "xx_1"))
    assert commands.parse("pt_match nn_2 gone nn_1", CATALOG) == commands.Command("ordered", ("nn_2", "nn_1"))
    assert commands.parse("pt_match fname nn _1", CATALOG) == commands.Command("drawn", ("nn_1",))


@pytest.mark.parametrize("text", ["", "p_avg", "p_avg a_gone", "p_avg a_left a_right", "p_negpos a_left", "pt_group none", "pt_match gone", "pt_match fname", "pt_match fname zz", "d_any x", "p_any a_left"])
def test_commands_are_refused(text):
    with pytest.raises(ValueError):
        commands.parse(text, CATALOG)


def test_commands_try_their_sources_in_turn(spark):
    pairs = spark.createDataFrame([("a", "b", 1, 9), ("a", "c", 5, 2), ("b", "c", None, 3)], "id1 string, id2 string, a_left int, a_right int")
    tops = spark.createDataFrame([("a", "b", "nn_1", 7), ("a", "c", "nn_2", 8), ("c", "c", "nn_1", 9)], "id1 string, id2 string, tag string, val int")
    asks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string")
    seen = spark.createDataFrame([("a", "b")], "qid string, id string")

    def run(text, k=5):
        return sorted(map(tuple, commands.run(commands.parse(text, CATALOG), asks, pairs, tops, seen, CATALOG, k).collect()))

    assert run("p_avg a_left") == [("a", 1, "c", 5.0, "a_left"), ("b", 1, "a", 1.0, "a_left"), ("c", 1, "a", 5.0, "a_left")]
    assert run("p_avg a_right", 1) == [("a", 1, "c", 2.0, "a_right"), ("b", 1, "a", 9.0, "a_right"), ("c", 1, "b", 3.0, "a_right")]
    # a has seen all of the first tag, so the second answers
    assert run("pt_match nn_1 nn_2") == [("a", 1, "c", 8.0, "nn_2"), ("b", 1, "a", 7.0, "nn_1"), ("c", 1, "a", 8.0, "nn_2")]
    mixed = spark.createDataFrame([("d", "a", 3.0), ("b", "c", 4.0)], "qid string, id string, value double")
    for text, answers in (("pt_match nn_1 nn_2", {"a": "nn_2", "b": "nn_1", "c": "nn_2", "d": "mixed"}), ("pt_match gone", {"b": "mixed", "d": "mixed"})):
        got = commands.run_or_fall_back(text, CATALOG, asks, pairs, tops, seen, mixed).collect()
        assert {r["qid"]: r["source"] for r in got} == answers


@pytest.mark.parametrize("angle, distance, kind, pushes", [
    (0, 100, "in", (-0.1, -0.15)), (175, 100, "in", (-0.1, -0.15)), (0, 300, "flat", (2, 2)), (-179, 300, "flat", (2, 2)), (40, 9, "lr/down", (1.7, 1.7)), (120, 9, "rl/down", (1.4, 1.4)), (-30, 9, "lr/up", (2.5, 2.5)), (-130, 9, "rl/up", (0, 0)), (90, 9, "flat", (2, 2)),
])
def test_pushes(spark, angle, distance, kind, pushes):
    row = spark.createDataFrame([(float(angle), float(distance), 200.0, 10, 2, 3)], "angle double, distance double, centers double, dots int, dots1 int, dots2 int")
    got = row.select(*[c.alias(n) for c, n in zip(gestures.pushes(*[F.col(c) for c in row.columns]), "abc")]).first()
    assert got[0] == kind and got[1:] == pytest.approx(pushes)


def test_folded_vectors(spark):
    got = spark.range(1).select(gestures.folded(F.array(*[F.lit(x) for x in (-0.1, 0.2, 0.21, -0.8, 1.7, 0.0)]))).first()[0]
    assert got == pytest.approx([0.1, 0.2, 0.105, 0.2, 1.7 / 16, 0.0])


def test_shapes_of_strokes(spark):
    square = [(1, n, x, y) for n, (x, y) in enumerate([(0, 0), (4, 0), (4, 0), (4, 2), (0, 2), (0, 0)])]
    line = [(2, n, float(n), 2.0 * n) for n in range(5)]
    rows = spark.createDataFrame([(s, n, float(x), float(y)) for s, n, x, y in [*square, *line, (3, 0, 1.0, 1.0)]], "stroke int, n int, x double, y double")
    got = {r["stroke"]: r.asDict() for r in gestures.stroke_shapes(rows).collect()}
    assert got[1] == {"stroke": 1, "dots": 6, "length": 12.0, "reach": 0.0, "straightness": 0.0, "turning": 270.0, "turns": 270.0, "closure": 1.0, "elongation": 2.0}
    assert got[2]["straightness"] == pytest.approx(1) and got[2]["turns"] == pytest.approx(0) and got[2]["length"] == pytest.approx(4 * math.sqrt(5))
    assert got[3]["length"] == 0 and got[3]["straightness"] is None and got[3]["elongation"] is None


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """20,000 vectors about 300 centres."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 48))[rng.integers(0, 300, 20_000)] + 0.35 * rng.standard_normal((20_000, 48))
    rows = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("nan", [float("nan")] * 48)], "id string, vec array<double>")
    path = str(tmp_path_factory.mktemp("vectors"))
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), x


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_recall(spark, clustered, tmp_path, metric):
    rows, x = clustered
    vindex.build(rows, str(tmp_path), metric)
    index = vindex.VectorIndex(spark, str(tmp_path))
    assert index.about["rows"] == 20_000 and len(index.centroids) == 141
    asks = rows.where("try_cast(substring(id, 2) as int) % 50 = 0")
    got = {(r["qid"], r["id"]): r["distance"] for r in index.search(asks, 10, 8).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 20_000, 50):
        far = 1 - y @ y[q] if metric == "cosine" else np.linalg.norm(x - x[q], axis=1)
        far[q] = np.inf
        for i in np.argsort(far)[:10]:
            if (f"v{q}", f"v{i}") in got:
                hits += 1
                assert got[f"v{q}", f"v{i}"] == pytest.approx(far[i], abs=2e-6)
    assert hits >= 0.95 * 4000 and len(got) == 4000
    assert index.scanned(asks, 8).first()["share"] < 0.2
    assert 1 <= index.probes_for(rows.where("id not in ('null', 'nan')"), 0.95) <= 8


def test_index_reads_probed_lists_only(spark, clustered, tmp_path):
    rows, _ = clustered
    vindex.build(rows.limit(3000), str(tmp_path), lists=30)
    index = vindex.VectorIndex(spark, str(tmp_path))
    one = rows.where("id = 'v7'")
    few, all_lists = index.search_few(one, 5, 3), index.search(one, 5, 3)
    assert few.collect() == all_lists.collect() and few.count() == 5
    assert re.search(r"PartitionFilters: \[[^]]*list#\d+ IN \(\d+,\d+,\d+\)", few._jdf.queryExecution().toString())
    # Every list is probed: the index is exact then.
    exact = blocks.nearest(rows.limit(3000).where("vec is not null").select("id", "vec"), rows.limit(3000).select("id", "vec"), 5).select(F.col("id").alias("qid"), "rank", F.col("match_id").alias("id"), "distance")
    whole = index.search(rows.limit(3000), 5, 30)
    assert whole.count() == 15_000 and whole.select("qid", "id").exceptAll(exact.select("qid", "id")).count() <= 5  # ties of rounded distances


def test_matrix_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = rng.random((3000, 3000), np.float32)
    one, two = str(tmp_path / "one.bin"), str(tmp_path / "two")
    p.astype(">f4").tofile(one)
    rows = matrix.read_matrices(spark, [one])
    sums = {r["i"]: r["s"] for r in rows.select("i", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()}
    assert len(sums) == 3000 and all(abs(sums[i] - p[i].astype(float).sum()) < 1e-6 for i in range(3000))
    matrix.write_matrix(matrix.matrix_cells(rows).select("i", "j", "p"), two, "little")
    files = sorted(os.listdir(two))
    assert all(matrix.PART.search(f) for f in files)
    back = np.concatenate([np.fromfile(f"{two}/{f}", "<f4") for f in files]).reshape(3000, 3000)
    assert (back == p).all()
    again = matrix.read_matrices(spark, [two], "little")
    assert again.count() == 3000 and again.where("i = 1234").first()["values"] == p[1234].tolist()
    with pytest.raises(Exception, match="already"):
        matrix.write_matrix(spark.createDataFrame([(0, 0, 0.5)], "i long, j long, p double"), two)


def test_matrices_in_step_and_refused(spark, tmp_path):
    def stored(name, values, kind=">f4"):
        np.asarray(values, kind).tofile(str(tmp_path / name))
        return str(tmp_path / name)

    a, b = stored("a", [[0, 0.25], [0.5, 1]]), stored("b", [[1, 0.5], [0.25, 0]])
    cells = sorted(map(tuple, matrix.matrix_cells(matrix.read_matrices(spark, [a, b])).collect()))
    assert cells[:2] == [(0, 0, 0, 0.0, 10_000_000), (0, 0, 1, 0.25, 7_500_000)] and len(cells) == 8
    bad = {"truncated": (stored("c", [0.5] * 3), "no matrix"), "above": (stored("d", [0, 0, 0, 1.5]), "row 1"), "nan": (stored("e", [float("nan"), 0, 0, 0]), "row 0"), "missing": (str(tmp_path / "zz"), "no such")}
    for path, what in bad.values():
        with pytest.raises(Exception, match=what):
            matrix.read_matrices(spark, [path]).collect()
    with pytest.raises(Exception, match="different sizes"):
        matrix.read_matrices(spark, [a, stored("f", [0.5] * 9)]).collect()
    for cells in ([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5)], [(0, 0, 0.5), (0, 0, 0.5)], [(1, 0, 0.1), (1, 1, 0.1), (2, 0, 0.1), (2, 1, 0.1)]):
        with pytest.raises(Exception):
            matrix.write_matrix(spark.createDataFrame(cells, "i long, j long, p double"), str(tmp_path / "g"))
        with pytest.raises(Exception):
            matrix.read_matrices(spark, [str(tmp_path / "g")]).collect()


@pytest.fixture
def stream(spark, tmp_path):
    """Runs an operator over batches of rows, each in a query of its own that goes on from the same checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(f, schema, *batches):
        out, source = [], str(tmp_path / "in")
        for n, rows in enumerate(batches):
            frame = spark.createDataFrame([(u, i, k, *x) for u, _, i, k, *x in rows], schema).withColumn("create_time", F.lit(None).cast("timestamp"))
            times = spark.createDataFrame([(i, float(t)) for _, t, i, *_ in rows], "id long, t double")
            frame.drop("create_time").join(times, "id").withColumn("create_time", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(source)
            full = spark.read.parquet(source).schema
            got = []
            q = f(spark.readStream.schema(full).parquet(source)).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination()
            out.append({r["id"]: r for r in got})
        return out

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_seen_pairs_are_forgotten(stream):
    shown = "browser_id long, id long, kind string, id1 string, id2 string"
    one, two, three = stream(
        lambda s: state.seen_pairs(s, "100 seconds", "10 seconds"), shown,
        [(1, 1000, 1, "pair", "a", "b"), (1, 1001, 2, "pair", "a", "b"), (2, 1001, 3, "pair", "a", "b"), (1, 1002, 4, "pair", "a", "c"), (1, 1003, 5, "toggle", None, None), (1, 1004, 6, "pair", "a", "c")],
        [(1, 1050, 7, "pair", "a", "c"), (2, 1090, 8, "pair", "a", "b"), (1, 1110, 9, "pair", "a", "b"), (1, 1151, 10, "pair", "a", "c")],
        [(1, 900, 11, "pair", "z", "z"), (1, 1150, 12, "pair", "a", "c"), (2, 1300, 13, "pair", "a", "b")],
    )
    assert {i: r["fresh"] for i, r in one.items()} == {1: True, 2: False, 3: True, 4: True, 6: True}
    assert {i: r["fresh"] for i, r in two.items()} == {7: False, 8: False, 9: True, 10: True}
    # 11 is too late; what 13 saw is too long ago
    assert {i: r["fresh"] for i, r in three.items()} == {12: False, 13: True}


def test_neighbours_go_by_age(stream):
    events = "browser_id long, id long, kind string, item string, neighbours array<string>"
    one, two = stream(
        lambda s: state.cached_neighbours(s, "60 seconds", "5 seconds"), events,
        [(1, 1000, 1, "put", "a", ["x", "y"]), (1, 1001, 2, "ask", "a", None), (1, 1002, 3, "ask", "b", None), (2, 1003, 4, "ask", "a", None), (1, 1004, 5, "put", "b", [])],
        [(1, 1060, 6, "ask", "a", None), (1, 1061, 7, "ask", "a", None), (1, 1062, 8, "ask", "b", None), (1, 1063, 9, "put", "a", ["z"]), (1, 1064, 10, "ask", "a", None)],
    )
    assert {i: (r["hit"], r["neighbours"]) for i, r in one.items()} == {2: (True, ["x", "y"]), 3: (False, []), 4: (False, [])}
    assert {i: (r["hit"], r["neighbours"]) for i, r in two.items()} == {6: (True, ["x", "y"]), 7: (False, []), 8: (True, []), 10: (True, ["z"])}


def test_screens_go_back(stream):
    shown = "browser_id long, id long, kind string, id1 string, id2 string"
    one, two = stream(
        lambda s: state.screen_stack(s, 2, "100 seconds", "5 seconds"), shown,
        [(1, 1000, 1, "show", "a", "b"), (1, 1001, 2, "show", "c", "d"), (1, 1002, 3, "show", "e", "f"), (1, 1003, 4, "back", None, None), (2, 1003, 5, "back", None, None)],
        [(1, 1050, 6, "back", None, None), (1, 1051, 7, "show", "g", "h"), (1, 1200, 8, "back", None, None), (2, 1200, 9, "show", "i", "j")],
    )
    assert {i: (r["id1"], r["id2"], r["depth"]) for i, r in one.items()} == {1: ("a", "b", 1), 2: ("c", "d", 2), 3: ("e", "f", 2), 4: ("c", "d", 1), 5: (None, None, 0)}
    assert {i: (r["id1"], r["depth"]) for i, r in two.items()} == {6: (None, 0), 7: ("g", 1), 8: (None, 0), 9: ("i", 1)}




@pytest.mark.parametrize("block", [4, 7, 2048])
def test_curve_lengths_over_blocks(spark, block):
    from tandem.operators import activity

    rng = np.random.default_rng(4)
    series = {u: rng.integers(0, 50, n).astype(float) for u, n in ((1, 9), (2, 10), (3, 23), (4, 60), (5, 61))}
    rows = [(u, float(t), t, v) for u, s in series.items() for t, v in enumerate(s.tolist())]
    log = spark.createDataFrame(rows, "browser_id long, create_time double, id long, user_time double")
    got = {r["browser_id"]: (r["n"], r["dimension"], r["r2"]) for r in activity.higuchi(log, block=block).collect()}
    for u, v in series.items():
        n = len(v)
        if n < 10:
            assert got[u] == (n, 0.0, 0.0)
            continue
        x, y = [], []
        for k in range(1, n // 3 + 1):
            starts = [np.abs(np.diff(v[m::k])).sum() * (n - 1) / ((n - m - 1) // k) / k / k for m in range(k)]
            x.append(math.log(k))
            y.append(math.log(max(sum(starts) / k, 1e-300)))
        assert got[u][0] == n and got[u][1] == pytest.approx(-np.polyfit(x, y, 1)[0], abs=2e-5)


def test_a_long_series_passes(spark):
    from tandem.operators import activity

    log = spark.range(50_000).select(F.lit(7).cast("long").alias("browser_id"), "id", F.col("id").alias("create_time"), (F.pmod(F.xxhash64("id"), F.lit(1013))).cast("double").alias("user_time"))
    got = activity.higuchi(log).first()
    assert got["n"] == 50_000 and 1.9 < got["dimension"] < 2.1 and got["r2"] > 0.99
