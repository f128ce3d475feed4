from __future__ import annotations

import random
import re

import pytest

from loomlake.llm import quality as Q

from .conftest import documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in seen for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


CASES = [None, "", " \t\n", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x\x0by\x0cz\r\nq  w", "l\nl\n\nl\n \n", "### $$$ a|b <c> &", "é ß 中文 😀 a b c d e f g", "a b " * 300, "\x1c\xa0 b"]


def test_counts_follow_brute_force(spark):
    rng = random.Random(3)
    cases = CASES + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    got = {r.doc_id: r for r in Q.score(documents(spark, enumerate(cases), clashes=True)).collect()}
    assert len(got) == len(cases)
    for i, text in enumerate(cases):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert not (r.base_failed and r.kept)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_thresholds_adapt_and_filter(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, 120), "a") for i in range(300)]
    marked = [(1000 + i, " ".join(w + "#" for w in prose(rng, 100).split()), "b") for i in range(300)]  # a source where marks are usual
    odd = [(5000, " ".join(w + "###" for w in prose(rng, 100).split()), "a")]
    few = [(6000, prose(rng, 100), "rare"), (6001, None, "rare"), (6002, "short", None)]
    docs = documents(spark, clean + marked + odd + few, clashes=True)
    kept = {r.doc_id for r in Q.filter_documents(docs).collect()}
    assert kept == {r[0] for r in clean + marked} | {6000}
    assert Q.filter_documents(docs).columns == docs.columns


def test_sketches_merge(spark):
    rng = random.Random(2)
    docs = documents(spark, [(i, prose(rng, 20 + i), f"s{i % 3}") for i in range(60)])
    m = Q.measure(docs)
    whole = {(r.metric, r.edge): r.n for r in Q.sketch(m, []).collect()}
    parts = Q.sketch(m.filter("doc_id % 2 = 0"), ["source"]).unionByName(Q.sketch(m.filter("doc_id % 2 = 1"), ["source"]))
    assert whole == {(r.metric, r.edge): r.n for r in Q.merge(parts, []).collect()}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, prose(random.Random(4), 50))] * 3 + [(None, "x")]
    assert Q.score(documents(spark, rows)).count() == 4
    assert Q.score(documents(spark, [])).count() == 0
    assert Q.filter_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_edges_are_close(spark, n):
    row = spark.sql(f"select {n}L as x").selectExpr("shiftleft(shiftright(x, greatest(length(bin(x)) - 6, 0)), greatest(length(bin(x)) - 6, 0)) as e").first()
    assert row.e <= n and n - row.e <= n / 32
