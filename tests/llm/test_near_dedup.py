from __future__ import annotations

import random

import numpy as np
import pytest

from loomlake.llm import near_dedup as N
from loomlake.llm.components import components
from loomlake.llm.shingles import shingle_sets, word_hashes

from .conftest import documents


def brute(rows, words, percent=80):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    part = {i: i for i, _ in rows if i is not None}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            common = len(sets[a] & sets[b])
            if i is not None and j is not None and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = top(i), top(j)
                part[max(x, y)] = min(x, y)
    return {(i, len(s), top(i) if i is not None else None) for (i, _), s in zip(rows, sets)}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"w{rng.random()}"
    return " ".join(w)


def family(seed, copies, size=120):
    rng = random.Random(seed)
    base = " ".join(f"t{rng.randrange(10**6)}" for _ in range(size))
    return [edited(rng, base, rng.randrange(8)) for _ in range(copies)]


@pytest.mark.parametrize("words", [4, 5])
def test_components_follow_brute_force(spark, words):
    texts = family(1, 70) + family(2, 30, 60) + family(3, 10, 500)
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(8)
    texts += [" ".join(f"u{rng.random()}" for _ in range(40)) + " " + passage + " " + " ".join(f"v{rng.random()}" for _ in range(30)) for _ in range(30)]
    texts += [None, "", " \n", "one", "One", "one two", "a b c d", "A B c D", "a b c d e", "É x y z w", "é x y z w", "x" * 5000, texts[0], texts[0].upper()]
    random.Random(5).shuffle(texts)
    rows = [*enumerate(texts), (None, texts[3])]
    docs = documents(spark, rows, clashes=True)
    got = N.near_duplicates(docs, words, 80).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, words)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    left = N.filter_documents(docs, words, 80)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, _, c in brute(rows, words) if i == c), key=str)


def thue_morse(bits: int, swap: bool = False) -> str:
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(1 << bits))


def test_words_made_to_cancel_are_told_apart(spark):
    """Polynomial hashes modulo a power of two give these words equal values, whatever their base."""
    one, two = thue_morse(10), thue_morse(10, True)
    assert len({s.tobytes() for s in shingle_sets([one, two, thue_morse(4), thue_morse(4, True)], 4)}) == 4
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_duplicates(documents(spark, [(1, one), (2, two), (3, "  " + one.upper())]), 4).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_word_hashes_follow_the_words():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé中") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    _, hashes = word_hashes(" ".join(words).encode())
    of = {}
    for w, h in zip(words, hashes.tolist()):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_often_repeated_sets_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "OFTEN", 3)
    rng = random.Random(6)
    base = " ".join(f"t{rng.randrange(10**6)}" for _ in range(200))
    long = " ".join(f"l{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [*((i, base) for i in range(30)), (40, edited(rng, base, 2)), (50, long), (51, edited(rng, long, 300)), *((60 + i, x) for i, x in enumerate([None, "", " ", "z z"] * 4))]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(documents(spark, rows), 5).collect()} == brute(rows, 5)


def test_rows_that_share_an_id(spark):
    text = " ".join(map(str, range(50)))
    docs = documents(spark, [(1, text), (1, text), (2, text), (3, "a b c d e f")])
    assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id for r in N.filter_documents(docs).collect()) == [1, 3]


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0
    assert N.filter_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    from loomlake.llm import components as module

    monkeypatch.setattr(module, "FEW_LINKS", few)
    links = [(1, 2), (2, 3), (3, 1), (7, 7), (9, 8), *((i, i + 1) for i in range(100, 160))]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {(2, 1), (3, 1), (9, 8), *((i, 100) for i in range(101, 161))}


def test_words_in_blocks(monkeypatch):
    from loomlake.llm import shingles

    text = ("ab  c\td\n" * 50 + "x" * 100 + " y").encode()
    whole = word_hashes(text)
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 7)
    for a, b in zip(whole, word_hashes(text)):
        assert (a == b).all()
    assert [len(s) for s in shingle_sets([None, "a", "a b c d e", "b b b b b b"], 4)] == [0, 1, 2, 1]


def test_maps_bound_what_is_shared(spark):
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    leader = np.sort(pool[:40])
    rows, sets = [], []
    for i in range(25):
        y = np.unique(pool[rng.random(60) < 0.7])
        beside, lacking = np.setdiff1d(y, leader), np.setdiff1d(leader, y)
        rows.append((i, len(leader), len(y), len(y) - len(beside), N._map(beside), N._map(lacking)))
        sets.append(set(y.tolist()))
    table = spark.createDataFrame(rows, "b bigint, na bigint, nb bigint, common bigint, omap array<bigint>, lmap array<bigint>")
    for r in table.alias("l").join(table.alias("r")).selectExpr("l.b as x", "r.b as y", f"{N.MOST} as most").collect():
        assert len(sets[r.x] & sets[r.y]) <= r.most <= len(sets[r.x] & sets[r.y]) + 12


def test_miss_probability():
    miss = lambda s: 1 - (1 - (1 - s**N.ROWS) ** N.COLLECTION) ** 2
    assert miss(0.8) < 3e-4 and miss(0.9) < 1e-6 and np.diff([miss(x) for x in (0.8, 0.9, 0.95)]).max() < 0


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    """Spark's estimates leave out what explode adds and take files by their compressed size, so joins don't go by them."""
    plans = {}

    def kept(df, name, cut=N.cut):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(N, "cut", kept)
    texts = family(4, 20) + family(5, 20, 60)
    found = N.filter_documents(documents(spark, [*enumerate(texts + texts)]), 4, 80)
    plans["result"] = found._jdf.queryExecution().executedPlan().toString()
    assert {"bucket-members", "led-members", "star-sketches", "placed-stars", "pairs", "result"} <= plans.keys()
    assert {name for name, plan in plans.items() if "BroadcastHashJoin" in plan} <= {"pair-texts", "often-components"}
