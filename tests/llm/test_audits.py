"""Decontamination, divergence of sources and repair of conversations, against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tandem.llm import decontam, divergence, turns

WORDS = [f"{a}{b}" for a in ("Ka", "lo", "MI", "né", "7") for b in ("ban", "Del", "fir", "ß9")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_leaks(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = leak_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = leak_words(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_leaks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 3000)
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([12, 30, 10, 9, 4, 3, 10, 40])] + [(8, None), (9, " .,! "), (None, make(11)), (2, make(15)), (10, "Zu"), (11, "a " * 30)]
    docs = []
    for i in range(120):
        parts = [make(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w)))
            parts += [rng.choice([" ", ", ", "\n"]).join(w[a : a + rng.randint(1, 25)]).upper().replace("SS", "ß"), make(rng.randint(0, 3))]
        docs.append((i, " ".join(parts)))
    docs += [(None, items[1][1]), (3, None), (3, ""), (4, items[0][1]), (4, items[0][1]), (500, make(20_000) + " " + items[7][1]), (501, "a " * 500), (502, " ".join(items[i][1] for i in (2, 6)))]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, spans string, row int, n int")
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, words int")
    got = sorted(map(tuple, decontam.decontamination_query(frame, bench).collect()), key=repr)
    want = brute_leaks(docs, items)
    assert got == want and sum(r[-1] for r in want) > 25
    spans = {r["doc_id"]: r["spans"] for r in decontam.contaminated_passages(frame.where("doc_id = 4 or doc_id = 501"), bench).collect()}
    assert spans[4] == [(0, 12)] and spans[501] == [(0, 500)]
    assert [r["contaminated"] for r in decontam.decontamination_query(frame.limit(3), bench.where("false")).collect()] == [False] * 3
    assert decontam.decontamination_query(frame.where("false"), bench).count() == 0


def test_every_shared_span_leaves_a_shared_fingerprint():
    import pyarrow as pa

    rng = random.Random(5)
    for n in range(1, 11):
        for _ in range(60):
            span = [rng.choice("abc") for _ in range(n)]
            one, two = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] + span + [rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
            found = [set(decontam.winnow(decontam.read_words(pa.array([" ".join(x)])), n)[0].tolist()) for x in (one, two)]
            assert found[0] & found[1]


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_divergence(docs, min_docs, listed):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in df.items()}
    share = {}
    for lang, source in groups:
        for key in ((lang, source), (lang,)):
            c = counts[key] if len(key) == 2 else sum((counts[g] for g in groups if g[0] == lang), Counter())
            all_counts = sum(c[t] for t in kept[lang])
            share[key] = {t: 1 + 1_000_000_000 * (c[t] + 2) // (all_counts + 2 * len(kept[lang])) for t in kept[lang]}
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in groups:
        p, q = share[lang, source], share[lang,]
        pairs = [(-sum(apart(p[t], share[lang, o][t]) for t in kept[lang]), o.encode()) for x, o in groups if x == lang and o != source]
        own = [(-apart(p[t], q[t]), t.encode()) for t in kept[lang] if counts[lang, source][t] and p[t] > q[t]]
        for part, rows in (("pair", sorted(pairs)), ("term", sorted(own)[:listed])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 64])
def test_divergence_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "COUNTERS", 60)
    rng = random.Random(12)
    stock = [*WORDS, "日本", "𝔘n", "a_b", "Ünder", "x-y"]
    docs = [(" ".join(rng.choice(stock[: rng.randint(1, 24)]) for _ in range(rng.randint(0, 25))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s2", "S3", None, "ä", "s5", "s6"])) for _ in range(150)]
    docs += [(None, "de", "s1"), ("rare words only", "de", "s2"), (None, None, None), ("", "it", "s9"), ("ka " * 30_000, "en", "long"), docs[0], docs[0]]
    frame = spark.createDataFrame([(i, *d, 1, "x") for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term int, value string")
    got = sorted(map(tuple, divergence.divergence_query(frame.repartition(3), 4, 5, block).collect()))
    assert got == brute_divergence(docs, 4, 5)
    assert {r[4] for r in got if r[0] == "de"} == {0} and not [r for r in got if r[0] == "it"]
    assert divergence.divergence_query(frame.where("false")).count() == 0


def test_tries_give_the_order_of_bytes():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab\xc3\xff\x01") for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    trie = divergence.RadixTrie()
    numbers = {w: trie.add(w) for w in words}
    assert [w for w, _ in trie.walk()] == sorted(set(words)) and all(numbers[w] == n for w, n in trie.walk()) and trie.size == len(set(words))


def cheapest_by_search(rows):
    """Dijkstra over (rows read, roles so far as a state); the least string of all with the least cost."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, best = [(0, "", 0, "")], {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        if best.get((at, state), (cost, audit)) < (cost, audit):
            continue
        best[at, state] = (cost, audit)
        for r in "ua":
            if (state, r) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", at, step[state, r]))
        if at < len(rows):
            x = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if x != "d":
                cut = int(x.isupper())
                if (state, x.lower()) in step:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, step[state, x.lower()]))
                for r in "ua":
                    if (state, r) in step:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, step[state, r]))


def test_cheapest_edits():
    for n in range(5):
        for rows in itertools.product("suaxdUAS", repeat=n):
            assert turns.cheapest_edits("".join(rows)) == cheapest_by_search(rows)
    rng = random.Random(4)
    for _ in range(150):
        rows = "".join(rng.choice("suaxdUASX") for _ in range(rng.randint(5, 90)))
        assert turns.cheapest_edits(rows) == cheapest_by_search(rows)
    assert turns.cheapest_edits("ua" * 50_000) == (0, "K" * 100_000)


def brute_repair(rows):
    """Every conversation by the words of the task, one after the other."""
    convs, out = defaultdict(list), []
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, members in convs.items():
        kept = []
        for turn, role, text in members:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        signature, faults, seen = "", Counter(), set()
        for turn, role, text in kept:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = cheapest_by_search(signature)
        made, at = [], 0
        for edit in audit:
            due = "user" if not made or made[-1][0][:1] in ("s", "a") else "assistant"
            if edit == "I":
                made.append((due, ""))
                continue
            _, role, text = kept[at]
            at += 1
            if edit != "D":
                made.append((role if edit == "K" else due, text))
        numbers = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=repr)


def test_repair_by_brute_force(spark):
    rng = random.Random(13)
    texts = ["Yes.", "Well, yes!", "no stop", "  ", "", None, "é?\n\t", "Really?", "tail. x", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "User"][: rng.choice([2, 3, 7])]), rng.choice(texts) if rng.random() < 0.7 else f"line {c} {t}.") for c in range(150) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (900, None, "user", "a."), (900, None, "system", "b."), (900, 5, "user", "c."), (900, 5, "user", "c."), (900, 5, "user", "d.")]
    rows += [(901, t, ("assistant", "user")[t % 2], "x" * 50_000 + str(t) + ".") for t in range(40)]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int")
    got = sorted(map(tuple, turns.repair_query(frame).collect()), key=repr)
    assert got == brute_repair(rows)
    assert {r[0]: r for r in got}[dropped][7:] == ("", hashlib.sha256(b"").hexdigest())
    assert turns.repair_query(frame.where("false")).count() == 0


def test_repaired_conversations_need_no_repair(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    damaged = turns.damage(rows)
    made = turns.repaired(damaged, turns.audits(damaged)).where("edit <> 'I'").select("conv_id", F.col("place").alias("turn"), "role", "text")
    again = turns.signatures(made).agg(F.sum("blank"), F.sum("duplicate")).first()
    assert tuple(again) == (0, 0)
