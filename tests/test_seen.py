"""What was shown to all of an orientation stays out of the lists made for its items."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tandem.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries over lists less what was seen, with their columns of unseen ids.
UNSEEN = {
    "unseen_list": ["id"],
    "first_of_best": ["id"],
    "weighted_unseen": ["id"],
    "second_ok": ["id"],
    "random_unseen": ["id"],
    "two_stage_match": ["left_id", "right_id"],
}


@pytest.mark.parametrize("name", sorted(UNSEEN))
def test_every_third_item_is_seen(spark, name):
    found = QUERIES[name](spark, SF)
    place = lambda c: F.substring_index(c, "/", -1).cast("int")
    ids = found.select("qid", F.explode(F.array(*UNSEEN[name])).alias("id"))
    shown = (place("id") % 3 == 0) & (place("id") % 2 == place("qid") % 2)
    count = ids.agg(F.count("*").alias("n"), F.count_if(shown).alias("seen")).first()
    assert count["n"] > 0 and count["seen"] == 0
    assert "b.sequence % 3 = 0" in ORACLES[name]
