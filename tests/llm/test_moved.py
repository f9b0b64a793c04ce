"""What operators keep small: bytes between tasks, memory of workers."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tandem.llm import packing, toxicity


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_toxicity_moves_no_texts(spark, monkeypatch):
    """Rows meet their labels by key where the labels are too many to broadcast."""
    frame, plans = type(spark.range(0)), []
    told = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda self: plans.append(self._jdf.queryExecution().executedPlan()) or told(self))
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), "id").alias("text"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert toxicity.toxicity_query(rows, rows.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))).count() == 60
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    moved = [x.output().toString() for plan in plans for x in nodes(plan) if x.nodeName() == "Exchange"]
    assert moved and not [x for x in moved if "text#" in x]


def test_packing_remembers_words_and_pieces_in_one_memo(monkeypatch):
    """Results stay those of the library, also where the memo is emptied between two batches."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MEMO_ENTRIES", 3000)
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library, most = packing.WordTokenizer(path), Tokenizer.from_file(path), 0
    special = set(coder.special)
    for batch in range(12):
        texts = [" ".join(f"stra\u00dfe{chr(97 + batch)}{chr(97 + i % 26)}{chr(97 + j)}{'abc'[i // 26]}{'!' if j % 2 else '\u0301' if j == 4 else ''}" for j in range(10)) + " \u00c9T\u00c9 d'\u00e9t\u00e9's 12|3" for i in range(64)]
        for text, ids in zip(texts, coder.encode(texts)):
            assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        most = max(most, sum(len(x) for x in vars(coder).values() if isinstance(x, dict) and set(x) != special))
    assert 1000 < most <= 3000 + 700  # a batch has fewer than 700 pieces
