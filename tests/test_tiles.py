"""Pairs stay inside their task: only what a query keeps leaves it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import tiles
from tandem.plans import QUERIES

SF = "/root/testdata/sf0.001"
ITEMS, PAIRS = 500, 62_250
#: Rows that a query may keep, to each stream of items past blocks of them, which joins every item twice to its group's number.
ROWS = {
    "center_out_order": (60 * ITEMS, 1),
    "alternate_merge": (120 * ITEMS, 2),
    "directional_topk": (12 * ITEMS, 1),
    "golden_angle": (1000, 1),
    "pairtop_symm": (10 * ITEMS, 1),
    "tagged_sides": (160, 2),
    "score_collection": (ITEMS, 1),
    "pairs_by_low_score": (240, 2),
    "both_score_sums": (ITEMS, 1),
    "angle_histogram": (4 * ITEMS, 1),
    "angle_tags": (4 * ITEMS, 1),
    "approved_block": (38 * ITEMS, 1),
    "approved_by_score": (ITEMS, 1),
    "best_by_model": (9 * ITEMS, 1),
    "first_of_best": (232 * ITEMS, 2),
    "topk_with_ties": (ITEMS, 1),
    "hist_mask_weights": (60 * ITEMS, 1),
    "first_n_even": (130 * ITEMS, 2),
    "combo_intersect": (190 * ITEMS, 2),
    "biased_choice": (110 * ITEMS, 2),
    "cached_scores": (420 * ITEMS, 5),
    "review_query": (9 * ITEMS, 1),
    "score_band_neighbors": (23 * ITEMS, 1),
    "pairs_at_angle": (10 * ITEMS, 2),
}


def rows_made(frame) -> int:
    """Rows that came out of Python tasks and joins while the frame was collected."""
    frame.collect()
    found, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            metrics = node.metrics()
            made = "pythonNumRowsReceived" if metrics.contains("pythonNumRowsReceived") else "numOutputRows" if "Join" in name else ""
            found += metrics.apply(made).value() if made else 0
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("name", sorted(ROWS))
def test_only_kept_rows_leave_their_task(spark, name):
    kept, streams = ROWS[name]
    assert rows_made(QUERIES[name](spark, SF)) <= kept + 2 * ITEMS * streams < PAIRS * streams


@pytest.fixture(scope="module")
def crowd(spark):
    """Ids of several lengths in two groups and scores with many ties; one item has no group, two share a key."""
    rows = [(f"{n * 7 % 5}/{n}", None if n == 17 else "g" if n % 3 else "h", 41 if n == 40 else n, [float(n % 4), float(n % 7)]) for n in range(120)]
    return spark.createDataFrame(rows, "id string, g string, n int, v array<float>").repartition(3)


def by_hand(crowd, score):
    rows = crowd.collect()
    return [(a["id"], b["id"], score(a, b)) for a in rows for b in rows if a["g"] and a["g"] == b["g"] and a["n"] != b["n"]]


@pytest.mark.parametrize("descending, ties", [(True, False), (False, False), (True, True)])
def test_best_with_many_blocks_and_tiles(crowd, monkeypatch, descending, ties):
    for name, value in (("LEAST_ITEMS", 9), ("CELLS", 64)):
        monkeypatch.setattr(tiles, name, value)
    side = crowd.select("id", "g", "n", "v")
    found = tiles.best(side, side, "g", "n", 4, lambda a, b: a["v"] @ b["v"].T, descending, ties).collect()
    want = {}
    for one, two, value in by_hand(crowd, lambda a, b: sum(x * y for x, y in zip(a["v"], b["v"]))):
        want.setdefault(one, []).append((-value if descending else value, two))
    expected = set()
    for one, others in want.items():
        others.sort()
        expected |= {(one, two, abs(int(v))) for k, (v, two) in enumerate(others) if k < 4 or ties and v == others[3][0]}
    assert {(r["id"], r["other"], r["value"]) for r in found} == expected
    assert len(found) == len(expected)


def test_pairs_meet_once(crowd, monkeypatch):
    for name, value in (("LEAST_ITEMS", 9), ("CELLS", 64)):
        monkeypatch.setattr(tiles, name, value)

    def choose(a, b, first):
        gap = np.abs(a["n"][:, None] - b["n"])
        return gap % 2 == 0, {"gap": lambda i, j, f: gap[i, j].astype("int32")}

    found = tiles.chosen_pairs(crowd.select("id", "g", "n"), "g", "n", choose, "gap int").collect()
    rows = {r["id"]: r["n"] for r in crowd.collect()}
    expected = sorted((one, two, rows[two] - rows[one]) for one, two, _ in by_hand(crowd, lambda a, b: 0) if rows[one] < rows[two] and (rows[two] - rows[one]) % 2 == 0)
    assert sorted(map(tuple, found)) == expected


def test_no_rows_give_no_rows(crowd):
    none = crowd.where("false")
    assert tiles.best(none, none, "g", "n", 4, lambda a, b: a["v"] @ b["v"].T).count() == 0
    assert tiles.best(crowd, none, "g", "n", 4, lambda a, b: a["v"] @ b["v"].T).select(F.col("id")).count() == 0


def test_strokes_keep_their_nearest_inside_the_task(spark, monkeypatch):
    """However many blocks the items would be dealt into."""
    from tandem.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 50)
    assert rows_made(QUERIES["stroke_search"](spark, SF)) <= 140 * ITEMS


def test_shown_to_a_group_is_one_row(spark):
    from tandem.operators import search

    items = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "h"), ("d", "v")], "id string, orient string")
    lists = spark.createDataFrame([("a", "b", 0), ("a", "d", 1), ("c", "b", 0), ("d", "b", 0)], "qid string, id string, rank int")
    shown = items.where("id = 'b'")
    assert sorted(map(tuple, search.not_shown(lists, items, shown).select("qid", "id", "rank").collect())) == [("a", "d", 1), ("c", "b", 0)]
