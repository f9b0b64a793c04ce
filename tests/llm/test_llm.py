"""Corpus operators against brute force, round trips, planted cases and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tandem.llm import bpe, common, embdedup, langid, linededup, minhash, packing, secrets, sharding, topk, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa", "to") for b in ("ban", "del", "fir", "gos", "hum", "jat", "kel")]


def sentence(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_docs(spark, extra=()):
    """Nulls, empty and long texts, ties, repeated rows and a null id."""
    rows = [(1, None), (2, ""), (3, "   \n\n "), (4, sentence(4)), (4, sentence(4)), (5, sentence(4)), (6, "é" * 50_000), (None, sentence(7)), (None, None), *extra]
    return spark.createDataFrame([(i, t, "en" if t else None, None, None) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_shards(spark, docs):
    for rows in (docs, edge_docs(spark)):
        got = sharding.shard_documents(rows).toPandas()
        assert len(got) == rows.count()
        total, largest = got["size"].sum(), got["size"].max()
        assert (abs(got.groupby("shard")["size"].sum() - total / 16) <= largest).all()
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        order = got.sort_values(["shard", "slot"])["doc_id"].dropna().tolist()
        assert order == sorted(order)
    one = {r["doc_id"]: r for r in sharding.shard_documents(docs).collect()}
    for r in docs.limit(20).collect():
        raw = (r["text"] or "").encode()
        assert (one[r["doc_id"]]["size"], one[r["doc_id"]]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard_documents(docs.where("false")).count() == 0


def test_shards_recomputed(spark, docs):
    """Every shard and slot by prefix sums over all rows in order."""
    rows = docs.select("doc_id", "text").unionByName(docs.where("doc_id < 30").select("doc_id", "text")).withColumn("shard", F.lit("x"))
    got = sharding.shard_documents(rows).toPandas().sort_values(["doc_id", "size", "text_crc32", "shard", "slot"])
    table = sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows.collect())
    end = np.cumsum([size for _, size, _ in table])
    shard = [min(15, (2 * int(e) - size) * 16 // (2 * int(end[-1]))) for e, (_, size, _) in zip(end, table)]
    slot = [n - shard.index(s) for n, s in enumerate(shard)]
    assert list(zip(got["doc_id"], got["size"], got["text_crc32"])) == table
    assert got["shard"].tolist() == shard and got["slot"].tolist() == slot


def test_bpe_is_the_library_encoding(spark, docs):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = [(90 + i, t) for i, t in enumerate(["a" * 3000, "  x\n\n\t y ", "日本語 ñandú 🙂🙂", "<|endoftext|>", "'s 'LL 12345678", "   z"])]
    for rows in (docs, edge_docs(spark, hard)):
        got = sorted(map(tuple, bpe.round_trip_digests(rows, path, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
        want = []
        for r in rows.collect():
            text = r["text"] or ""
            ids = enc.encode_ordinary(text)
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want, key=str)


def brute_classes(texts, similarity=0.8):
    """Components of exact links over counted 5-word shingles, by smallest id."""
    def shingles(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = {i: shingles(t or "") for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and (common := (x & y).total()) and common >= similarity * (x.total() + y.total() - common):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


def test_minhash_classes(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n in range(40):  # a chain: neighbours are near, the ends are not; and a crowd around one text
        base = sentence(1000, 100).split()
        chain = base[n // 2 * 3 :] + sentence(2000, 60).split()[: n // 2 * 3]
        texts[100_000 + n] = " ".join(chain if n % 2 else [*base[:97], f"w{n}", *base[97:]])
    phrase = "one phrase that comes again and again".split()
    for n in range(30):  # the same shingles, but as often as not: near only where the counts are
        texts[200_000 + n] = " ".join([*phrase * (3 + n), *sentence(77, 12).split()])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_query(rows).collect()}
    assert got == brute_classes(texts)


def test_minhash_edges(spark):
    rows = edge_docs(spark)
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_query(rows).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6)] and len(got) == 9
    kept = minhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None", "None"]
    assert minhash.near_query(rows.where("false")).count() == 0


def test_minhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = sentence(5, 80).split()
    texts = {n: " ".join([*base[: 80 - n], *sentence(50 + n, n).split()]) for n in range(1, 30)}
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_query(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def test_dart_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(1, 1 << 60, 100).astype(np.uint64)])
    x, y = minhash.dart_signatures([(np.unique(a), np.ones(300)), (np.unique(b), np.ones(300))], 2000)
    assert abs((x == y).mean() - 0.5) < 0.04


@pytest.mark.parametrize("shape", ["units", "counts", "fractions"])
def test_darts_estimate_weighted_similarity(shape):
    rng = np.random.default_rng(4)
    names = np.unique(rng.integers(1, 1 << 60, 400).astype(np.uint64))
    draw = {"units": lambda n: np.ones(n), "counts": lambda n: rng.integers(1, 9, n).astype(float), "fractions": lambda n: rng.uniform(0.05, 3.5, n)}[shape]
    x, y = draw(300), draw(300)
    left, right = names[:300], names[100:400]
    y[:200] = np.where(rng.random(200) < 0.6, x[100:], y[:200])  # most shared elements weigh the same
    shared = np.minimum(x[100:], y[:200]).sum()
    true = shared / (x.sum() + y.sum() - shared)
    one, two = minhash.dart_signatures([(left, x), (right, y)], 4000)
    assert abs((one == two).mean() - true) < 0.03, (shape, true)


@pytest.mark.parametrize("multiset", [False, True])
def test_minhash_weighs_repeats(spark, multiset):
    phrase = "one phrase that comes again and again".split()
    rows = [(n, " ".join(phrase * (3 + 4 * n))) for n in range(8)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), multiset=multiset).collect()}
    assert len(set(got.values())) == (1 if not multiset else len(set(brute_classes(dict(rows)).values())))


def test_components(spark, monkeypatch):
    from tandem.llm import graph

    monkeypatch.setattr(graph, "CHUNK", 40)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(150)]
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    got = {r["node"]: r["component"] for r in graph.connected_components(frame).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        before = dict(label)
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert got == label


def top_by_brute_force(vectors, queries, k=10):
    want = []
    for q in queries:
        same = [(i, v) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        order = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in same)[:k]
        want += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(order, 1)]
    return sorted(want)


def test_topk_is_exact(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.25]) for _ in range(6)]) for i in range(230)]
    rows += [(500, None), (501, [float("nan")] * 6), (502, [None] * 6), (503, []), (None, rows[0][1]), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("q", F.lit("x"))
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows[:230]}
    want = top_by_brute_force(vectors, (0, 100, 200))
    columns = ("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, topk.search_query(frame).select(*columns).collect())) == want
    assert topk.search_query(frame.where("false")).count() == 0
    # Many blocks of rows and of queries: what each finds is merged.
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    got = topk.search_query(frame, every=7).select(*columns).collect()
    assert sorted(map(tuple, got)) == top_by_brute_force(vectors, [i for i in vectors if i % 7 == 0])


def test_topk_of_many_lengths_and_large_values(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 1.0]) * 10 ** rng.randint(-2, 15) for _ in range(1 + i % 5)]) for i in range(120)]
    vectors = {i: [int(np.floor(1024 * np.float64(x))) for x in v] for i, v in rows}
    got = topk.search_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == top_by_brute_force(vectors, range(0, 120, 10))
    assert any(abs(r["score"]) >= 2**63 - 1 for r in got)


def test_lines(spark):
    notice = "\n".join(sentence(900 + i, 12) for i in range(40))
    rows = [(i, sentence(i, 9) + "\n" + notice + "\n" + sentence(i + 500, 9)) for i in range(10, 16)]
    frame = edge_docs(spark, rows).withColumn("hash", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame).collect() if r["doc_id"]}
    assert got[10]["text"] == rows[0][1] and got[1]["text"] is None and got[2]["text"] == ""
    for i, text in rows[1:]:
        # the passage is gone, but for a line at either edge, and the own lines stay
        assert got[i]["removed_lines"] >= 38 and got[i]["text"].split("\n")[0] == text.split("\n")[0] and got[i]["text"].split("\n")[-1] == text.split("\n")[-1]
    assert set(frame.columns) < set(linededup.dedup_lines(frame).columns)
    assert linededup.dedup_lines(frame.where("false")).count() == 0


def test_lines_removed_stay_elsewhere(spark):
    rng = random.Random(8)
    stock = [f"line {n} {sentence(n, 6)}" for n in range(60)] + [""]
    texts = {}
    for i in range(150):
        parts = [f"own {i} {j}" for j in range(rng.randint(0, 6))]
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(50)
            parts[rng.randint(0, len(parts)) : 0] = [rng.choice(stock)] if rng.random() < 0.3 else stock[a : a + rng.randint(2, 12)]
        texts[i] = "\n".join(parts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(r["removed_lines"] for r in got.values()) > 300
    # no line is lost everywhere, and what stays keeps its order
    assert {x for t in texts.values() for x in t.split("\n")} | {""} == {x for r in got.values() for x in r["text"].split("\n")} | {""}
    for i, text in texts.items():
        lines, rest = text.split("\n"), got[i]["text"].split("\n") if got[i]["removed_lines"] < text.count("\n") + 1 else []
        assert len(lines) - len(rest) == got[i]["removed_lines"]
        at = iter(lines)
        assert all(x in at for x in rest)
        assert [x for x in lines if x.startswith("own")] == [x for x in rest if x.startswith("own")]


def line_hash(seed, value):
    """The JVM's 64-bit hash of a string, or of a rule's number and a hash."""
    raw = value.encode() if isinstance(value, str) else (value % 2**64).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed=42 if seed is None else xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42))


def brute_lines(texts, long_words=50):
    """What stays of each text, rule by rule: whole chunks between boundaries, runs of them by where they stand first."""
    everywhere, chunks = 2**64 - 1, {}
    lines = {i: t.split("\n") for i, t in sorted(texts.items())}
    chars = {line: len(line) * bool(regex.search(r"[\p{L}\p{N}]", line)) for own in lines.values() for line in own}
    hashes = {line: line_hash(None, line) for line in chars}
    for i, own in lines.items():
        gaps = [everywhere, *[line_hash(1, hashes[a]) | line_hash(2, hashes[b]) for a, b in zip(own, own[1:])], everywhere]
        found = {(at, at + 1) for at, line in enumerate(own) if len(line.split()) > long_words}
        for bit in range(64):
            cuts = [at for at, gap in enumerate(gaps) if gap >> bit & 1]
            for a, b in zip(cuts, cuts[1:]):
                if 2 <= b - a <= linededup.LINES and chars[own[a]] and chars[own[b - 1]] and sum(chars[x] for x in own[a:b]) >= linededup.CHARS:
                    found.add((a, b))
        for a, b in found:
            chunks.setdefault(tuple(own[a:b]), []).append((i, a))
    ranges = {i: {} for i in lines}
    for chunk, places in chunks.items():
        source, first = min(places)
        for i, at in places:
            if (i, at) != (source, first):
                ranges[i].setdefault((source, first - at), []).append((at, at + len(chunk)))
    out = {}
    for i, own in lines.items():
        runs = set()
        for some in ranges[i].values():
            here = []
            for a, b in sorted(some):
                if here and a <= here[-1][1]:
                    here[-1] = (here[-1][0], max(b, here[-1][1]))
                else:
                    here.append((a, b))
            runs |= set(here)
        runs = [r for r in runs if not any(q != r and q[1] - q[0] >= r[1] - r[0] and q[0] < r[1] and r[0] < q[1] for q in runs)]
        gone = {at for a, b in runs for at in range(a, b)}
        out[i] = "\n".join(line for at, line in enumerate(own) if at not in gone)
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_lines_by_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] is not None}
    notice = [sentence(700 + i, 6) for i in range(12)]
    for i in range(60):  # a passage in a quarter of all documents, and parts of it
        texts[10_000 + i] = "\n".join([f"own {i}", *notice[i % 5 : 12 - i % 3], sentence(40 + i % 4, 70), f"own {i} b", ""])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.line_query(rows).collect()}
    want = brute_lines(texts)
    assert got == want and sum(t != want[i] for i, t in texts.items()) > 60


def test_lines_leave_what_is_no_passage(spark):
    one, two, three = (sentence(2000 + i, 12) for i in range(3))
    rows = [
        (1, "import os\n\n\ndef f():\n    return 1\n\n\ndef g():\n    pass\n}\n\n}\n"), (2, "import sys\n\n\ndef g():\n    pass\n\n\ndef h():\n    return 1\n}\n\n}\n"),
        (3, "- a\n- b\n\n- c\n---\n\n===\n"), (4, "- a\n- b\n\n- d\n---\n\n===\n"),
        # all three together stand nowhere else
        (5, f"{one}\n{two}"), (6, f"{two}\n{three}"), (7, f"{one}\n{two}\n{three}"),
    ]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)


def test_planted_passages_are_found(spark):
    rng, texts, planted = random.Random(6), {}, {}
    for n in range(2, 13):
        for k in range(20):
            passage = [sentence(f"{n} {k} {i}", rng.randint(60 // n, 30)) for i in range(n)]
            for copy in range(2):
                own = [sentence(f"own {n} {k} {copy} {i}", 9) for i in range(6)]
                at = rng.randint(0, 6)
                i = 1000 * n + 10 * k + copy
                texts[i], planted[i] = own[:at] + passage + own[at:], n * copy
    rows = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    removed = {r["doc_id"]: r["removed_lines"] for r in linededup.dedup_lines(rows).collect()}
    for n in range(2, 13):
        own = [i for i in texts if i // 1000 == n and planted[i]]
        assert sum(removed[i] for i in own) >= 0.9 * n * len(own), n
    assert not any(removed[i] for i in texts if not planted[i]) and all(removed[i] <= planted[i] for i in texts)


def test_columns_of_the_user_keep_their_names(spark):
    names = ["row", "doc", "key", "gone", "own_doc", "own_key", "places", "filter_own", "filter_bit", "filter_cell", "__gone", "removed", "at", "n", "h"]
    text = "\n".join(sentence(i, 12) for i in range(4))
    rows = spark.createDataFrame([(i, text, *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = linededup.dedup_lines(rows).orderBy("doc_id").collect()
    assert [r["removed_lines"] for r in got] == [0, 4, 4] and all([r[n] for n in names] == list(range(len(names))) for r in got)


def test_lines_passages_of_any_length(spark):
    notices = {n: [sentence(3000 + 10 * n + k, 60 if n == 1 else 14) for k in range(n)] for n in range(1, 6)}
    texts = {}
    for n, notice in notices.items():
        for copy in range(6):
            own = [f"own {n} {copy} {k}" for k in range(7)]
            at = 1 + copy % 5
            texts[100 * n + copy] = (own[:at], notice, own[at:])
    rows = [(i, "\n".join([*a, *b, *c])) for i, (a, b, c) in texts.items()]
    rows += [(900, "head\nshort line\ntail"), (901, "other head\nshort line\nother tail")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (a, b, c) in texts.items():
        assert got[i]["text"].split("\n") == ([*a, *b, *c] if i % 100 == 0 else [*a, *c]), i
        assert (got[i]["removed_chunks"], got[i]["removed_lines"]) == ((0, 0) if i % 100 == 0 else (1, len(b)))
    # one short line is no passage
    assert got[901]["removed_lines"] == 0


def test_vectors(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    near = x[:40] + np.random.default_rng(3).normal(0, 0.02, x[:40].shape)
    rows += [(10_000 + i, v.tolist()) for i, v in enumerate(near)] + [(20_000, rows[0][1]), (20_001, None), (20_002, [0.0] * 64), (20_003, [float("nan")] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.array(np.float32(v), float)) for i, v in rows if v is not None and np.isfinite(v).all() and np.any(v)]
    ids, y = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    got = {r["vec_id"]: r for r in embdedup.near_vectors(frame).collect()}
    assert len(got) == len(rows) and got[20_001]["n_links"] == got[20_002]["n_links"] == got[20_003]["n_links"] == 0
    found, want = sum(got[i]["n_links"] for i in ids.tolist()), int(linked.sum())
    assert 0.99 * want <= found <= want
    component = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min([c, *component[linked[k]]]) for k, c in enumerate(component)])
        if (new == component).all():
            break
        component = new
    assert np.mean([got[i]["component_id"] == c for i, c in zip(ids.tolist(), component.tolist())]) > 0.99
    assert embdedup.near_vectors(frame.where("false")).count() == 0


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """20,000 vectors, half of them near one of the others, with their links and components by brute force."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    base = rng.standard_normal((10_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((10_000, 64))
    noise *= rng.uniform(0.1, 0.4, (10_000, 1)) / np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, base[np.minimum(rng.zipf(1.3, 10_000) - 1, 9_999)] + noise]).astype(np.float32)[rng.permutation(20_000)]
    path = str(tmp_path_factory.mktemp("vectors") / "x.parquet")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), path)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    degree, src, dst = np.zeros(len(y), int), [], []
    for begin in range(0, len(y), 2000):
        linked = y[begin : begin + 2000] @ y.T >= 0.95
        linked[np.arange(len(linked)), np.arange(begin, begin + len(linked))] = False
        degree[begin : begin + 2000] = linked.sum(1)
        i, j = np.nonzero(linked)
        src.append(i + begin)
        dst.append(j)
    src, dst, component = np.concatenate(src), np.concatenate(dst), np.arange(len(y))
    while True:
        new = component.copy()
        np.minimum.at(new, src, component[dst])
        new = new[new]
        if (new == component).all():
            return spark.read.parquet(path), degree, component
        component = new


@pytest.mark.parametrize("codewords", [4, 7, 16, None])
def test_vector_index_finds_the_links(clustered, codewords):
    frame, degree, component = clustered
    got = embdedup.near_vectors(frame, codewords=codewords).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert degree.sum() > 1_000_000 and (found <= degree).all()
    assert found.sum() > 0.999 * degree.sum() and found.sum() % 2 == 0  # every link counts at both its ends
    assert (got["component_id"].to_numpy() == component).mean() > 0.999


def test_vector_index_visits_few_cells():
    rng = np.random.default_rng(2)
    x = embdedup._unit(rng.standard_normal((4000, 64)))
    index = embdedup.MultiIndex(x, 16, 0.95, 0.999)
    home, row, cell = index.traverse(x[:500])
    assert 1 < len(row) / 500 < 0.1 * 16 * 16
    left, right = index._halves(x[:500])
    grid = left[:, :, None] + right[:, None, :]
    flat = grid.reshape(500, -1)
    for r in range(0, 500, 50):  # the cells within the margin, nearest first, each once
        own = cell[row == r]
        assert own[0] == home[r] == flat[r].argmin() and len(set(own)) == len(own)
        assert (np.diff(flat[r][own]) >= -1e-12).all()
        assert len(own) == (flat[r] <= flat[r].min() + index.margin).sum()


def test_vector_blocks(clustered, monkeypatch):
    frame, degree, _ = clustered
    monkeypatch.setattr(embdedup, "BLOCK", 100)
    monkeypatch.setattr(embdedup, "TILE", 32)
    few = frame.where("vec_id < 2000").withColumnRenamed("vec_id", "id").withColumn("tag", F.lit("x")).withColumnRenamed("id", "vec_id")
    small = embdedup.near_vectors(few, codewords=4).toPandas().sort_values("vec_id")
    monkeypatch.undo()
    whole = embdedup.near_vectors(few, codewords=4).toPandas().sort_values("vec_id")
    assert small["n_links"].tolist() == whole["n_links"].tolist() and small["component_id"].tolist() == whole["component_id"].tolist()
    assert small["n_links"].sum() > 0


def test_vectors_of_many_lengths(spark):
    rows = [(2 * n + k, [1.0] * (n - 1) + [1.0 + k / 1000]) for n in range(1, 90) for k in range(2)] + [(900, [1.0] * 99), (901, [1e300, 1e300]), (902, [2.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got.pop(900) == (0, 900) and got.pop(901) == got.pop(902) == (3, 4) and got.pop(4) == got.pop(5) == (3, 4)
    assert got == {2 * n + k: (1, 2 * n) for n in range(1, 90) for k in range(2) if n != 2}


def test_secrets(spark):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    rows = edge_docs(spark, [(70, f'and the token = "{key}" was left here'), (71, f"in commit {key} of the tree"), (72, "a counterrevolutionaries and internationalisation word"), (73, "----------------------------------------")])
    found = {(r["doc_id"], r["is_secret"]) for r in secrets.secret_query(rows).collect()}
    assert (70, True) in found and (71, False) in found and (73, True) not in found and (72, True) not in found
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(rows).collect()}
    assert masked[70] == 'and the token = "[SECRET]" was left here' and key in masked[71] and masked[1] is None and masked[2] == ""
    assert secrets.mask_secrets(rows).count() == rows.count() and secrets.mask_secrets(rows).columns == rows.columns


def test_secrets_assigned(spark):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    rows = edge_docs(spark, [(70, f"export ACCESS_KEY={key} was here"), (71, f"password={key} of the"), (72, f"see ?token={key} and"), (73, 'password="q7Rt9xZ2" and'), (74, "page = international and so on")])
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(rows).collect()}
    assert key not in masked[70] + masked[71] + masked[72] and masked[70].startswith("export ACCESS_KEY=[SECRET]")
    assert "q7Rt9xZ2" not in masked[73] and masked[74] == "page = international and so on"


def test_secrets_of_other_forms(spark):
    """Signs in passwords, passwords in addresses, and forms that no training finding has."""
    hidden = {
        80: ('password = "', "p@ssw0rd!2024xyz", '" here'), 81: ("use postgres://admin:", "S3cr3tPassw0rd99", "@db.host/x"), 82: ("redis_auth: '", "Zq8#rT_v2~Lw", "'"), 83: ("PGPASSWORD=", "x9%Kd!2mQ^7b", " psql -h db"),
        84: ("(mongodb+srv://svc-app:", "hT5$gW9z-Q2k", "@c0.example.net)"), 85: ("client_secret: ", "8f~Q2.kd_71-Zw0Xy", ", next"),
    }
    plain = {90: "the password: required and the token: optional.", 91: "see https://example.org:8080/a@b and mailto:someone@example.org", 92: "key = international and secret: everything!", 93: "ftp://user:password@host.example.org/x"}
    rows = spark.createDataFrame([(i, "".join(t)) for i, t in hidden.items()] + list(plain.items()) + [(100 + i, sentence(i)) for i in range(20)], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(rows).collect()}
    for i, (before, _, after) in hidden.items():
        assert masked[i] == before + "[SECRET]" + after
    for i, text in plain.items():
        assert masked[i] == text


def test_secrets_each_occurrence(spark):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    text = f"in commit {key} of the tree " + sentence(5, 20) + f' and with api_key: {key} of the'
    rows = edge_docs(spark, [(70, text), (71, f"in commit {key} of the tree")])
    got = {r["doc_id"]: r for r in secrets.secret_query(rows).where(F.col("candidate") == key).collect()}
    assert got[70]["is_secret"] and got[70]["place"] == 11 and got[70]["occurrences"] == 2 and not got[71]["is_secret"]
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(rows).collect()}
    assert key not in masked[70] and key in masked[71]


def test_secret_candidates_by_brute_force(spark):
    import regex

    key = hashlib.sha256(b"k").hexdigest()
    texts = {i: t for i, t in enumerate([f"x {key} y", key, f'token="{key}" {key[:30]} {key}=\n{key[:20]}', "é🙂 " + " ".join(key[: 20 + n % 9] for n in range(400)), "word", ""])}
    rows = spark.createDataFrame(list(texts.items()), "key long, text string")
    got = sorted((r["key"], r["place"], r["candidate"], r["left"], r["right"]) for r in secrets.candidates(rows).collect())
    want = []
    for i, t in texts.items():
        for m in regex.finditer(secrets.CANDIDATE, t):
            want.append((i, m.start() + 1, m.group(), t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 40]))
    assert got == sorted(want) and len(want) > 400


def test_secret_forest_held_out(spark):
    words = [f"{a}{b}" for a in WORDS[:20] for b in WORDS[5:20]]
    known = spark.createDataFrame([(w,) for w in words], "word string")
    model = secrets.train(secrets.labelled_findings(spark, words[:100]), known)
    unseen = secrets.labelled_findings(spark, words[100:], rows=2400, first=1_000_000)
    told = model.transform(secrets.assembled(secrets.features(unseen, known))).select("label", "prediction").toPandas()
    hit = (told["label"] == 1) & (told["prediction"] == 1)
    assert hit.sum() / (told["label"] == 1).sum() > 0.97 and hit.sum() / (told["prediction"] == 1).sum() > 0.97


def test_secrets_planted_in_documents(spark):
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r["doc_id"], k) for r in rows.collect() for k in re.findall(r'(?i)token = "([0-9a-f]{40})"', r["text"] or "")}
    got = {(r["doc_id"], r["candidate"]) for r in secrets.secret_query(rows).where("is_secret").collect()}
    assert got == want and len(want) > 10


def test_masking_keeps_columns_of_any_name(spark):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    rows = spark.createDataFrame([(1, f'token = "{key}" and {key}', "a", "b", 3), (2, None, "a", None, None)], "doc_id long, text string, key string, place string, probability long")
    got = {r["doc_id"]: r for r in secrets.mask_secrets(rows).collect()}
    assert got[1]["text"] == 'token = "[SECRET]" and [SECRET]' and got[1]["key"] == "a" and got[1]["probability"] == 3 and got[2]["text"] is None
    assert secrets.mask_secrets(rows, "it's \\gone").where("doc_id = 1").first()["text"] == "token = \"it's \\gone\" and it's \\gone"
    assert secrets.secret_query(rows.where("false")).count() == 0 and secrets.mask_secrets(rows.where("false")).count() == 0


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_query(rows).join(rows.select("doc_id", "lang", "text"), "doc_id").where("held_out and text is not null and lang is not null")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()["a"]
    assert right > 0.95
    edges = {r["doc_id"]: r for r in langid.language_query(edge_docs(spark)).collect() if r["doc_id"]}
    assert edges[1]["lang_pred"] == edges[2]["lang_pred"] == edges[3]["lang_pred"] == "und"
    kept = langid.keep_identified(rows)
    assert kept.columns == rows.columns and kept.count() > 0.95 * rows.count()
    assert langid.language_query(rows.where("false")).count() == 0


def test_unexplained_documents_go(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(6)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(80))
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью " * 3
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto " * 3
    extra = spark.createDataFrame([(-1, junk, None, None, None), (-2, russian, None, None, None), (-3, finnish, None, None, None)], DOC)
    kept = {r["doc_id"] for r in langid.keep_identified(rows.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).unionByName(extra)).collect()}
    assert not kept & {-1, -2, -3}
    assert len(kept) > 0.99 * rows.count()


def test_proportions_of_four_languages():
    likely = np.full((200, 5), -60.0, np.float32)
    likely[np.arange(200), np.arange(200) % 4] = -20
    share, _ = langid.proportions(likely, np.array([0, 200]))
    assert np.allclose(share[0], [0.25, 0.25, 0.25, 0.25, 0], atol=0.01)


def test_toxicity_held_out(spark):
    rows, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_query(rows, marks).join(marks, "doc_id").where("held_out").toPandas()
    pos, neg = got[got["toxic"] == 1]["score"], got[got["toxic"] == 0]["score"]
    auc = np.mean([(pos > v).mean() + (pos == v).mean() / 2 for v in neg])
    assert auc > 0.9, auc
    flagged = got[got["predicted"] == 1]
    assert (flagged["toxic"] == 1).mean() > 0.9
    none = toxicity.toxicity_query(edge_docs(spark), marks.where("false"))
    assert none.count() == 9 and none.where("score <> 0.5").count() == 0


def test_toxicity_learns_each_row_once(spark):
    rows = [(i, sentence(i, 30) + (" grumble" if i % 2 else ""), i % 2) for i in range(40)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string, toxic int")
    once = toxicity.fit(frame(rows))
    many = toxicity.fit(frame(rows + rows[:10] * 20).repartition(5))
    assert len(once[0]) and (once[0] == many[0]).all() and np.allclose(once[1], many[1])
    few = toxicity.fit(frame(rows * 3), max_train=0)
    assert len(few[0]) == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)  # as it comes
    special = ["hello <|endoftext|> world", "a<|startoftext|><|endoftext|><|endoftext|>b", "<|ENDOFTEXT|> <|endoftext", "<<|endoftext|>>e<|endoftext|>\u0301", "<|endoftext|>", "don't<|endoftext|>'s <|startof\u212Aext|>"]
    for rows in (docs.select("doc_id", "text"), edge_docs(spark, [(80, "x|y || z"), (81, "J̌ ÉTÉ İI"), *enumerate(special, 82)]).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")):
        got = packing.pack_documents(rows, path).toPandas()
        assert (got["length"] <= 2048).all() and (got.groupby("sequence_id")["length"].sum() <= 2048).all()
        for _, part in got.sort_values("offset").groupby("sequence_id"):
            assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        by_doc = dict(list(got.sort_values("piece").groupby("doc_id")))
        for r in rows.collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            pieces = by_doc[r["doc_id"]]
            assert [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)] == pieces["ids_crc32"].tolist()
            assert pieces["start"].tolist() == list(range(0, len(ids), 2048))
        assert got["sequence_id"].nunique() <= packing.lower_bound(got["length"].to_numpy(np.int64), 2048) * 1.02 + 1
    assert packing.pack_documents(docs.where("false"), path).count() == 0


def test_packing_exchanges(spark):
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.randint(300, 700), i) for i in range(400)] + [(1000, k, 1000 * k, 1000, 7) for k in range(5)] + [(2000, 0, 0, 450, 9)] * 60
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    counts = []
    for group in (20, 100_000):
        got = packing.pack(frame, 1000, group).toPandas()
        assert sorted(map(tuple, got[frame.columns].to_numpy().tolist())) == sorted(rows)
        for _, part in got.sort_values("offset").groupby("sequence_id"):
            assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 1000
        packed = got[got["sequence_id"] >= 0]
        rounds, groups = packed["sequence_id"].to_numpy() >> 51, packed["sequence_id"].to_numpy() >> 20
        if group == 20:
            assert rounds.max() > 1  # at least one exchange took place
            assert len(set(groups[packed["doc_id"] == 2000])) > 5  # equal rows do not meet in one group
        counts.append(got["sequence_id"].nunique())
        # The bins of certified groups that hold only certified bins cannot be fewer.
        for _, part in packed.groupby(groups):
            if part["certified"].all() and (part.groupby("sequence_id")["length"].sum() < 1000).all():
                assert part["sequence_id"].nunique() == packing.lower_bound(part["length"].to_numpy(np.int64), 1000)
    assert counts[1] <= counts[0] <= 1.15 * counts[1]  # each small group is only proven against its own bound


def test_packing_bounds():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(1, 101, 60)
        bins, _ = packing.best_fit_decreasing(lengths, 100)
        bound = packing.lower_bound(lengths, 100)
        assert -(-lengths.sum() // 100) <= bound <= bins.max() + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at.count(), stage(spark, at, SF)
        assert at.columns == docs.columns and 0 < at.count() <= before, name
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == at.count()


CLASHES = ["key", "source_", "hash", "place", "tag", "node", "score", "shard", "removed_lines", "__digest", "bucket", "label", "fit", "candidate", "digest"]


def with_clashes(frame):
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit("x"))
    return frame


#: Each operator's query over documents, the columns that name its rows, and how many rows the edge table gives.
OVER_DOCUMENTS = {
    "op1": (lambda d: sharding.shard_documents(d).drop("slot", "shard"), 10),
    "op2": (lambda d: bpe.round_trip_digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), 10),
    "op3": (minhash.near_query, 10),
    "op5": (linededup.line_query, 10),
    "op7": (secrets.secret_query, None),
    "op8": (lambda d: langid.language_query(d).drop("languages"), 10),
    "op9": (lambda d: toxicity.toxicity_query(d, d.select("doc_id", F.lit(1).alias("toxic"))), 10),
    "op10": (lambda d: packing.pack_documents(d, P.path("word_bpe_49k.json")).drop("sequence_id", "offset"), None),
}


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_edges_of_each_operator(spark, name):
    query, rows = OVER_DOCUMENTS[name]
    key = hashlib.sha256(b"k").hexdigest()[:40]
    plain = edge_docs(spark, [(9, f'token = "{key}"')])
    got = query(plain)
    told = sorted(map(str, got.collect()))
    assert rows is None or len(told) == rows
    assert sorted(map(str, query(with_clashes(plain)).collect())) == told  # extra columns change nothing
    assert query(plain.where("false")).count() == 0
    assert query(with_clashes(plain).where("text is null")).columns == got.columns
    if name == "op10":  # an id that is null, and one that no double holds
        big = plain.where("doc_id = 9 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 2**53)
        assert sorted(str(r["doc_id"]) for r in query(big).collect()) == [str(9 + 2**53), "None", "None"]


def test_edges_of_each_stage(spark):
    import corpus_pipeline

    rows = edge_docs(spark, [(9, "a line of some words\nand one more of them")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (rows, with_clashes(rows)):
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns, name
            ids = sorted(str(r["doc_id"]) for r in got.collect())
            if name == "language ID":  # so few texts tell little of any language; none but those without letters must go
                assert set(ids) <= {"1", "2", "3", "4", "5", "6", "9", "None"} and not {"1", "2", "3"} & set(ids) and ids.count("4") in (0, 2)
                assert stage(spark, docs.where("false"), SF).count() == 0
                continue
            assert ids == (["1", "2", "3", "4", "6", "9", "None", "None"] if "near" in name else sorted(str(r["doc_id"]) for r in rows.collect())), name
            assert stage(spark, docs.where("false"), SF).count() == 0, name
