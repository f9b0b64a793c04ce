"""Catalog-driven plans, lookups, tables of users, file discovery, and kernels without a query of their own."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import text as T
from tandem.functions import vectors as V
from tandem.operators import catalog, histograms, keywords, ranked, search
from tandem.sources import files


def test_score_columns_are_found(spark):
    wide = spark.createDataFrame([("a", "b", 1, 2, 3.0, 4.0, 5, 6)], "id1 string, id2 string, a_x12 int, a_x21 int, n_y12 double, n_y21 double, a_half12 int, other int")
    assert catalog.score_models(wide, "a_", "n_") == {"a_": ["a_x"], "n_": ["n_y"]}
    assert sorted(map(tuple, catalog.by_model(wide, ["a_x", "n_y"]).collect())) == [("a", "b", "a_x", 1.0, 2.0), ("a", "b", "n_y", 3.0, 4.0)]
    for unknown in ("a_half", "other", "zz"):
        with pytest.raises(ValueError, match=unknown):
            catalog.by_model(wide, ["a_x", unknown])
    wide.createOrReplaceTempView("wide_scores")
    assert catalog.have_table(spark, "wide_scores") and catalog.have_table(spark, "wide_scores", "a_x12") and not catalog.have_table(spark, "wide_scores", "a_z12") and not catalog.have_table(spark, "no_such_table")


def test_lookups_and_signed_limits(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "x"), ("d", None, "x")], "id string, n int, name string")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert sorted(ids(catalog.looked_up(rows, name="x", n=(1, 2)))) == ["a"] and sorted(ids(catalog.looked_up(rows, id=["b", "d"]))) == ["b", "d"]
    for bad in ({}, {"gone": 1}):
        with pytest.raises(ValueError):
            catalog.looked_up(rows, **bad)
    assert ids(catalog.ordered_by(rows, "n", 2)) == ["a", "b"] and ids(catalog.ordered_by(rows, "n", -2)) == ["c", "b"] and ids(catalog.ordered_by(rows, "n", 0)) == ["a", "b", "c"]


def test_users_and_comments(spark):
    users = spark.createDataFrame([("u", "old", "open"), ("v", "v", "blocked"), ("w", "w", "open")], "user string, mail string, state string")
    changes = spark.createDataFrame([(1, "u", "mail", "new"), (2, "w", "delete", None), (3, "x", "mail", "m"), (4, "y", "add", "y1"), (5, "y", "block", None), (6, "w", "mail", "lost"), (7, "z", "add", "z1"), (8, "z", "delete", None), (9, "z", "add", "z2")], "id int, user string, kind string, mail string")
    after = catalog.users_after(users, changes)
    assert sorted(map(tuple, after.collect())) == [("u", "new", "open"), ("v", "v", "blocked"), ("y", "y1", "blocked"), ("z", "z2", "open")]
    said = [(1, "p", "u", 1, "one"), (2, "p", "z", 2, "two"), (3, "p", "u", 2, "three"), (4, "p", "y", 9, "no"), (5, "q", "v", 1, "no")]
    got = catalog.comments_by_item(spark.createDataFrame(said, "id int, item string, user string, create_time int, text string"), after, 2).collect()
    assert [r.asDict() for r in got] == [{"item": "p", "n": 3, "users": 2, "latest": ["three", "two"]}]


def test_rings_are_used_and_refilled(spark):
    ring = spark.createDataFrame([("a", 0, "x", 9), ("a", 1, "y", 8), ("b", 0, "x", 7), ("c", 0, "z", 1)], "qid string, place int, id string, value int")
    marks = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("e", 4)], "qid string, used int")
    seen = spark.createDataFrame([("b", "x"), ("c", "w")], "qid string, id string")
    spare = spark.createDataFrame([("b", 0, "x", 3), ("b", 1, "q", 2), ("c", 0, "w", 1)], "qid string, place int, id string, value int")
    asks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string")
    answers, rings, used = search.from_rings(ring, marks, asks, seen, spare)
    assert sorted(map(tuple, answers.collect())) == [("a", "y", 8, "ring"), ("b", "q", 2, "refill")]
    assert sorted(map(tuple, used.collect())) == [("a", 2), ("b", 2), ("e", 4)]
    assert {(r["qid"], r["id"]) for r in rings.collect()} == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "q"), ("c", "w")}


@pytest.fixture
def tree(tmp_path):
    """Archives 1, 2 and 12 with pictures, and files that are none."""
    for name in ("1/0001_a.jpg", "1/2.JPEG", "2/img_17b.jpg", "2/notes.txt", "2/nonumber.jpg", "12/x/5.jpg", "12/7.jpg", "12/007.jpg", "loose.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    return tmp_path


def test_pictures_are_discovered(spark, tree):
    found = {r["id"]: r["name"] for r in files.pictures(files.discover_files(spark, f"file://{tree}")).collect()}
    assert found.keys() == {"1/1", "1/2", "2/17", "12/7"} and found["2/17"] == "img_17b.jpg"
    sides = spark.createDataFrame([("1/1", 30, 20), ("1/2", 20, 30), ("2/17", 20, 31)], "id string, width int, height int")
    upright = files.pictures(files.discover_files(spark, f"file://{tree}"), sides, "v")
    assert sorted(r["id"] for r in upright.collect()) == ["1/2", "2/17"]
    assert "content" not in files.discover_files(spark, f"file://{tree}").columns
    (tree / "list").write_text(f"# pictures\n{tree}/1/2.JPEG\n\n {tree}/2/img_17b.jpg \n{tree}/1/2.JPEG\n{tree}/2/notes.txt\n")
    assert sorted(r["id"] for r in files.pictures(files.listed_files(spark, f"file://{tree}/list")).collect()) == ["1/2", "2/17"]


def test_directories_are_imported(spark, tree):
    known = spark.createDataFrame([("1/1",)], "id string")
    new, twice = files.import_directory(spark, f"file://{tree}", known)
    assert sorted(r["id"] for r in new.collect()) == ["1/2", "2/17"]
    assert [tuple(r) for r in twice.collect()] == [("12/7", 2)]
    one, _ = files.import_directory(spark, f"file://{tree}", known, archive=2)
    assert [r["id"] for r in one.collect()] == ["2/17"]


def test_images_by_colour(spark):
    white, black = [("w", 255, 255, 255)] * 5, [("b", 0, 0, 0), ("b", None, 1, 1)]
    half = [("h", 255, 255, 255)] * 3 + [("h", 0, 0, 0)] * 3
    got = {r["id"]: r for r in histograms.image_colours(spark.createDataFrame([*white, *black, *half], "id string, r int, g int, b int")).collect()}
    assert (got["w"]["n"], got["w"]["r"], got["w"]["rgb_radius"], got["w"]["lab_radius"], got["w"]["contrast"]) == (5, 255, 0, 0, 1)
    assert (got["b"]["n"], got["b"]["ll"], got["b"]["contrast"]) == (1, 0, 0)
    assert got["h"]["r"] == 127 and got["h"]["ll"] in (49, 50) and got["h"]["contrast"] in (99, 100) and got["h"]["rgb_radius"] == int((128 * math.sqrt(3) + 127 * math.sqrt(3)) / 2)


def test_kernels_without_a_query(spark):
    a, b = [0.1, 0.5, -0.2], [0.3, -0.1, 0.2]
    row = spark.createDataFrame([(a, b, [0.0, 0.0, 3.0, 4.0])], "a array<double>, b array<double>, c array<double>")
    x, y = np.array(a), np.array(b)
    ratio = 1 + 2 * ((x - y) ** 2).sum() / ((1 - x @ x) * (1 - y @ y))
    got = row.select(V.poincare_root(F.col("a"), F.col("b")).alias("root"), V.hellinger(F.array(*map(F.lit, (1.0, 3.0))), F.array(*map(F.lit, (3.0, 1.0)))).alias("h"), *[c.alias(n) for c, n in zip(V.split_normalised(F.col("c"), 2), ("l", "r"))]).first()
    assert got["root"] == pytest.approx(math.sqrt(ratio + math.sqrt(ratio * ratio - 1)))
    assert got["h"] == pytest.approx(2 * (math.sqrt(0.5) - math.sqrt(1.5)) ** 2)
    assert got["l"] == [0.0, 0.0] and got["r"] == pytest.approx([0.6, 0.8])
    assert row.select(V.metric("cosine", F.col("c"), F.col("c"))).first()[0] == pytest.approx(1)


@pytest.mark.parametrize("name, want", [("/a/b/img_12.jpg", "12"), ("img_12.jpg", "12"), ("12.hist", "12"), ("12", "12"), ("x12.jpg.hist", "x12.jpg")])
def test_files_to_ids(spark, name, want):
    assert spark.range(1).select(T.file_to_id(F.lit(name), ["img_"], [".jpg", ".hist"])).first()[0] == want


def test_word_vectors_are_composed(spark):
    vectors = spark.createDataFrame([("red", [1.0, 2.0]), ("ring", [10.0, 20.0]), ("Paris", [5.0, 5.0]), ("big_ring", [7.0, 7.0])], "word string, vec array<double>")
    words = spark.createDataFrame([(w,) for w in ("red", "RED", "red_ring", "red_gone", "gone", "big_ring", "Paris", "Red_Ring")], "word string")
    got = {r["word"]: r["vec"] for r in keywords.word_vector(words, vectors).collect()}
    assert got == {"red": [1.0, 2.0], "RED": [1.0, 2.0], "red_ring": [11.0, 22.0], "red_gone": [1.0, 2.0], "big_ring": [7.0, 7.0], "Paris": [5.0, 5.0], "Red_Ring": [11.0, 22.0]}


def test_value_lists(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 9), ("c", None), ("d", 4), ("e", 4), ("f", 1)], "id string, v int")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), ("d",), ("b",), ("z",)], "id string")
    assert [tuple(r) for r in catalog.value_list(rows, ids, "v").collect()] == [("a", 3), ("d", 4), ("e", 4), ("b", 9)]
    assert [tuple(r) for r in catalog.value_list(rows, ids, "v", invert=True).collect()] == [("b", 3), ("d", 8), ("e", 8), ("a", 9)]


def test_maps_sorted_by_value(spark):
    rows = spark.createDataFrame([("q", "b", 2), ("q", "a", 2), ("q", "c", 1), ("r", "x", 5)], "qid string, id string, value int")
    got = sorted((r["qid"], r["rank"], r["id"]) for r in ranked.to_list(rows, "value").collect())
    assert got == [("q", 0, "c"), ("q", 1, "a"), ("q", 2, "b"), ("r", 0, "x")]
    assert sorted((r["qid"], r["id"]) for r in ranked.to_list(rows, F.desc("value"), limit=1).collect()) == [("q", "a"), ("r", "x")]


def test_neighbour_tables_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "t1", 5), ("a", "c", "t1", 4), ("b", "c", "t2", 3)], "id1 string, id2 string, tag string, val int")
    files.write_neighbours(rows, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out/pairtop")
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert {(r["tag"], r["ct"]) for r in spark.read.parquet(f"file://{tmp_path}/out/tags").collect()} == {("t1", 2), ("t2", 1)}
    with pytest.raises(Exception, match="already exists"):
        files.write_neighbours(rows, f"file://{tmp_path}/out")
