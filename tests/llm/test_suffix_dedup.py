from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from loomlake.llm import suffix_dedup as D

from .conftest import documents

L = D.LENGTH


def brute(rows):
    """Marks of each row's bytes, in the order of rows; rows that share id and text are one."""
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (key[1] or "").encode()
        mark = bytearray(len(data))
        for s in range(len(data) - L + 1):
            if data[s : s + L] in seen:
                mark[s : s + L] = b"\1" * L
            else:
                seen.add(data[s : s + L])
        out[key] = mark
    return out


def expected(data, mark):
    kept = bytes(x for x, m in zip(data, mark) if not m)
    return len(data), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and (not i or not mark[i - 1])), hashlib.sha256(kept).hexdigest()


def noise(rng, n, letters="abcdefgh "):
    return "".join(rng.choice(letters) for _ in range(n))


def cases(seed):
    rng = random.Random(seed)
    shared = [noise(rng, n) for n in (99, 100, 101, 150, 400)]
    rows = [(i, noise(rng, rng.randrange(300)) + rng.choice(shared) + noise(rng, rng.randrange(300)) + rng.choice(shared)) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, "a" * 1000), (105, "ab" * 300), (106, "é中😀" * 60), (107, "x" + "é中😀" * 60), (None, rows[3][1]), (108, "a" * 99), (109, rows[5][1][1:])]
    return rows


@pytest.mark.parametrize("group,often", [(2000, 8), (1, 8), (2000, 1), (3, 2)])
def test_removes_what_brute_force_removes(spark, monkeypatch, group, often):
    monkeypatch.setattr(D, "GROUP", group)
    monkeypatch.setattr(D, "OFTEN", often)
    rows = cases(group)
    marks = brute(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.removal_digests(documents(spark, rows, clashes=True)).collect()}
    assert got == {k[0]: expected((k[1] or "").encode(), m) for k, m in marks.items()}


def test_long_texts_go_by_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 700)
    rng = random.Random(9)
    long = noise(rng, 9000)
    rows = [(1, long), (2, noise(rng, 50) + long[700:5000] + noise(rng, 20)), (3, long[::-1]), (4, long[1400:1520])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.removal_digests(documents(spark, rows)).collect()}
    assert got == {k[0]: expected(k[1].encode(), m) for k, m in brute(rows).items()}


def test_repeated_rows_are_one(spark):
    text = noise(random.Random(5), 500)
    rows = [(1, text), (1, text), (2, text)]
    got = sorted((r.doc_id, r.n_removed) for r in D.removal_digests(documents(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (2, 500)]
    assert D.removal_digests(documents(spark, [])).count() == 0


def test_texts_lose_whole_characters(spark):
    text = "é中😀" * 60
    docs = documents(spark, [(1, "start" + text), (2, text[:50] + text), (3, None)], clashes=True)
    left = {r.doc_id: r for r in D.remove_repeats(docs).collect()}
    assert D.remove_repeats(docs).columns == docs.columns
    assert left[3].text is None and set(left[2].text) <= set(text) and left[2].n_chars == len(left[2].text)


def test_windows_and_factors():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 500).astype(np.uint64)
    for width in (1, 7, 69):
        assert (D.window_minima(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()
    data = rng.integers(0, 2, 1500).astype(np.uint8)
    for length in (8, 12, 20):
        places = np.arange(len(data) - length + 1)
        whole = [data[i : i + length].tobytes() for i in places]
        common = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        got = D.previous_factors(data, places, length).tolist()
        seen: set[bytes] = set()
        for i in places.tolist():
            assert (got[i] == length) == (whole[i] in seen)
            seen.add(whole[i])
        for i in (1, 40, 700, 1400):
            longest = max(common(whole[i], whole[j]) for j in range(i))
            assert got[i] == (length if longest == length else longest // 8 * 8)


def test_previous_smaller():
    rng = np.random.default_rng(3)
    for x in (rng.permutation(400), np.arange(50), np.arange(50)[::-1].copy(), np.zeros(0, np.int64)):
        expected = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(len(x))]
        assert D.previous_smaller(x).tolist() == expected


def test_one_anchor_with_very_many_contexts(spark, monkeypatch):
    """A line that all documents hold, with other words around it in each, and the earliest of them last in the table."""
    monkeypatch.setattr(D, "GROUP", 20)
    rng = random.Random(31)
    line = noise(rng, 130)
    rows = [(300 - i, noise(rng, 60) + line + noise(rng, 60)) for i in range(200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.removal_digests(documents(spark, rows)).collect()}
    assert got == {k[0]: expected(k[1].encode(), m) for k, m in brute(rows).items()}
