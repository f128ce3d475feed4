"""WARC, chat, licences, nearest vectors."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.llm import chat, knn_join, licenses, util, warc

from .conftest import documents

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, first string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


@pytest.fixture(scope="module")
def page_rows():
    long = "".join(f"line {i} é\r\n\r\nWARC/1.1\r\n" for i in range(400))
    return [(5, "http://a/b c\r\nX: y", "p" * 200), (3, "u3", "p" * 200), (9, None, "p" * 200), (1, "u1", "short"), (2, "u2", "short"), (4, "u4", None), (6, "u6", ""), (7, "u7", long), (8, "u8", long), (10, "", "é" * 50), (11, "", "é" * 50), (12, "", "é" * 49), (13, "", "é" * 49), (None, "n", "p" * 200), (3, "u3", "p" * 200)]


def warc_expected(rows):
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if i is not None and len(data) >= warc.LEAST:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        back = first.get(data) if i is not None else None
        revisit = back is not None and back != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", back if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,segment", [(1 << 20, 4 << 20), (64, 300)])
def test_warc_round_trip(spark, page_rows, monkeypatch, chunk, segment):
    monkeypatch.setattr(warc, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(warc, "SEGMENT_BYTES", segment)
    got = sorted((tuple(r) for r in warc.round_trip(pages_of(spark, page_rows)).collect()), key=str)
    assert got == warc_expected(page_rows)


def test_warc_chunks_join_up(spark, page_rows):
    manifest = warc.write_archives(pages_of(spark, page_rows).coalesce(1))
    rows = sorted(warc.read_chunks(manifest).filter("page_id = 7").collect(), key=lambda r: r.chunk_no)
    data = b"".join(bytes(r.data) for r in rows)
    assert data.decode() == dict((i, h) for i, _, h in page_rows)[7] and rows[-1].last
    raw = b"".join(gzip.open(r.path.removeprefix("file://")).read() for r in manifest.select("path").distinct().collect())
    assert raw.count(b"WARC-Type: response") + raw.count(b"WARC-Type: revisit") == len(page_rows)
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_warc_stores():
    assert warc._store("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="odd"):
        warc._store("odd://x/y")


def test_warc_finds_damage():
    head, _ = warc._head(1, "u", hashlib.sha256(b"other").hexdigest(), 4, None)
    import io

    packed = gzip.compress(head + b"data\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc._chunks(warc._Stream(io.BytesIO(packed), len(packed))))
    with pytest.raises((EOFError, ValueError)):
        list(warc._chunks(warc._Stream(io.BytesIO(packed[:40]), len(packed))))


TEXTS = ["", "plain", "<|im_end|>", "<\\|x", "<\\\\|", "<<|", "a<", "|b", "<|im_start|>user\nhi<|im_end|>\n", "new\nline", "é😀", None, "$1 \\", "%0A %25"]


def test_chat_reads_back_what_was_written(spark):
    rows = [(c, t, r, x) for c, r in enumerate(["user", "assistant", None, "a|b<|\n%", "assistant"]) for t, x in enumerate(TEXTS)]
    rows += [(50, 1, "assistant", "tie b"), (50, 1, "assistant", "tie a"), (50, 0, "user", "q"), (50, 1, "assistant", "tie a"), (None, 0, "user", "no id"), (None, None, "assistant", "null turn")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, tree string, rank int")
    got = {r.conv_id: r for r in chat.conversation_digests(table).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.conversation_digests(table.limit(0)).count() == 0


def test_branches(spark):
    nodes = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "on", None), (1, 5, 3, "user", "off", 0.5),
        (2, 1, 99, "user", "orphan", 0.0), (3, 1, 2, "user", "round", 0.0), (3, 2, 1, "user", "round", 0.0), (3, 3, 2, "user", "tail", 0.0), *((4, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)),
    ]
    table = spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    rows = chat.read_back(chat.format_branches(table, 2)).collect()
    got = {(r.tree, r.rank): ([t.text for t in r.turns], r.learned) for r in rows}
    assert got == {(1, 1): (["root", "good", "on"], ["good"]), (1, 2): (["root", "bad", "off"], ["bad"]), (2, 1): (["orphan"], []), (4, 1): ([str(i) for i in range(37)], [])}
    for r in rows:
        for s in r.loss_spans:
            assert r.formatted[s.begin : s.end] == r.turns[s.turn].text


def test_branches_with_ties_and_repeated_rows(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "c", 1.0), (1, None, 1, "user", "lost", 9.0), (None, 1, None, "user", None, None)]
    rows += [(2, i, i - 1 if i else None, "user", "x" * 500 + str(i), 0.0) for i in range(60)] + [(2, 100 + i, i, "assistant", f"end {i}", float(i)) for i in range(60)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "tree bigint, node bigint, parent bigint, role string, text string, score double, rank int")
    got = {(r.tree, r.rank): [t.text for t in r.turns] for r in chat.read_back(chat.format_branches(table, 2)).collect()}
    assert got[1, 1] == ["q", "a"] and got[1, 2] == ["q", "c"] and got[None, 1] == [""]
    assert got[2, 1][-1] == "end 59" and len(got[2, 1]) == 61 and got[2, 2][-1] == "end 58" and len(got) == 5
    assert chat.format_branches(table.limit(0)).count() == 0


def test_a_wrong_mask_is_an_error(spark):
    table = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a" * 5000 + "<|x", 1.0)], "tree bigint, node bigint, parent bigint, role string, text string, score double")
    written = chat.format_branches(table)
    assert chat.read_back(written).first().learned == ["a" * 5000 + "<|x"]
    for change in ("x.begin + 1", "x.begin - 1"):
        moved = written.withColumn("loss_spans", F.expr(f"transform(loss_spans, x -> struct(x.turn as turn, {change} as begin, x.end as end))"))
        with pytest.raises(Exception, match="loss span"):
            chat.read_back(moved).collect()
    with pytest.raises(Exception, match="loss span"):
        chat.read_back(written.withColumn("loss_spans", F.expr("transform(loss_spans, x -> struct(9 as turn, x.begin as begin, x.end as end))"))).collect()


def test_licences(spark):
    prose = [(i, "\n".join(" ".join(f"{a}{b}{(i * 7 + k) % 11}" for k, (a, b) in enumerate(zip("etaoin" * 3, "shrdlu" * 3))) for _ in range(3))) for i in range(80)]
    lines = {100: ("MIT", "Released under the MIT License."), 101: ("Apache-2.0", "licensed under the APACHE license,   version 2.0"), 102: ("GPL", "This work is licensed under the GNU General Public License, version 3."), 103: ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), 104: ("unknown", "Licensed under the Zorblax Private Covenant, version 9.")}
    rows = prose + [(i, f"{prose[0][1]}\n{text}\n{prose[1][1]}") for i, (_, text) in lines.items()] + [(200, None), (201, ""), (100, lines[100][1]), (None, lines[103][1])]
    got = licenses.scan(documents(spark, rows, clashes=True)).collect()
    found = sorted(((r.doc_id, r.line, r.family) for r in got), key=str)
    expected = sorted([(i, 3, f) for i, (f, _) in lines.items()] + [(100, 0, "MIT"), (None, 0, "CC-BY-NC")], key=str)
    assert [x for x in found if x[2] != "unknown"] == [x for x in expected if x[2] != "unknown"]
    assert all(x in expected for x in found)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_licences_whose_words_are_in_sampled_prose(spark):
    museum = "The museum reserved all seats for residents whose rights had been upheld by the council."
    rows = [(i, f"wort{i} satz{i % 7} zeile{i % 5}") for i in range(50)] + [(60, museum), (61, f"wort1 satz1\nAll rights reserved.\n{museum}")]
    got = {(r.doc_id, r.line): r.family for r in licenses.scan(documents(spark, rows)).collect()}
    assert got.get((61, 1)) == "Proprietary"


def licence_brute(model, rows):
    """Each paragraph scored in Python, none left out before: (doc_id, line, family, probability, similarity)."""
    tell = lambda text: [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    runs = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    templates = {f: [runs(tell(t), 3) for t in texts] for f, texts in licenses.TEMPLATES.items()}
    out = []
    for i, text in rows:
        for line, paragraph in enumerate((text or "").split("\n")):
            w = tell(paragraph)
            present = [model.weights[g] for n in (1, 2, 3) for g in runs(w, n) if g in model.weights]
            z = [b + sum(x[k] for x in present) for k, b in enumerate(model.bias)]
            e = [math.exp(x - max(z)) for x in z]
            p = [x / sum(e) for x in e]
            if not present or 1 - p[-1] < licenses.LEAST_LICENSE:
                continue
            best = max(range(len(p) - 1), key=lambda k: p[k])
            family, threes = licenses.FAMILIES[best], runs(w, 3)
            like = max(round(len(threes & t) / min(len(threes), len(t)), 6) if threes and t else 0.0 for t in templates[family])
            out.append((i, line, family if p[best] >= model.limit and like > model.like else "unknown", round(p[best], 5), like))
    return out


def licence_rows():
    """Prose, prose in the words of licences, licences in several wordings, and some of families that aren't known."""
    rng = random.Random(21)
    told = sorted({w for texts in licenses.TEMPLATES.values() for t in texts for w in re.findall("[a-z]+", t.lower())})
    prose = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(40)) for _ in range(120)]
    harsh = [" ".join(rng.choice(told) for _ in range(rng.randrange(3, 30))) for _ in range(150)]
    known = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts] + [("Apache-2.0", "Copyright 2020 Foo. Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "licensed under the APACHE license,   version 2.0")]
    others = ["Licensed under the Eclipse Public License 2.0", "Released under the Zlib License.", "Distributed under the Boost Software License, Version 1.0.", "This work is released under the Unlicense", "Licensed under the Zorblax Private Covenant, version 9.", "SPDX-License-Identifier: EPL-2.0"]
    rows = [(i, "\n".join(rng.sample(prose, 4))) for i in range(60)] + [(100 + i, x) for i, x in enumerate(harsh)]
    rows += [(1000 + i, f"{prose[i % 100]}\n{t}\n{prose[i % 77]}") for i, (_, t) in enumerate(known)] + [(2000 + i, t) for i, t in enumerate(others)]
    rows += [(3000, None), (3001, ""), (3002, "\n\n..."), (1000, known[0][1]), (None, known[0][1]), (3003, "word " * 60_000 + known[0][1])]
    return rows, {1000 + i: f for i, (f, _) in enumerate(known)}, {2000 + i for i in range(len(others))}


def test_licences_follow_brute_force(spark):
    rows, known, others = licence_rows()
    docs = documents(spark, rows, clashes=True)
    model, strong = licenses.train(docs)
    assert 0 < model.limit <= 1 and 0 < model.like < 1 and strong
    expected = licence_brute(model, rows)
    got = [(r.doc_id, r.line, r.family, round(r.probability, 5), r.similarity) for r in licenses.scan(docs).collect()]
    near = lambda x: (str(x[0]), x[1], x[2], round(x[3], 4), round(x[4], 4))
    assert sorted(map(near, got)) == sorted(map(near, expected))
    family = {(i, line): f for i, line, f, *_ in got}
    assert np.mean([family.get((i, 1)) == f for i, f in known.items()]) >= 0.9
    assert {family.get((i, 0), "unknown") for i in others} == {"unknown"}
    assert sum(family.get((i, 0), "unknown") != "unknown" for i in range(100, 250)) <= 3  # prose in the words of licences
    assert not any(i is not None and i < 60 for i, _ in family)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_licences_of_planted_lines_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, _ = licenses.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.line, r.family) for r in licenses.scan(docs).collect()) == sorted(x[:3] for x in licence_brute(model, rows))


def test_licences_of_texts_without_any(spark):
    assert licenses.scan(documents(spark, [(1, None), (2, None)])).count() == 0
    assert licenses.scan(documents(spark, [(1, "nothing here"), (2, "")])).count() == 0


def knn_brute(rows, k, every):
    v = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out, done = set(), set()
    for i, q in v:
        if i % every or (i, tuple(q)) in done:
            continue
        done.add((i, tuple(q)))
        scored = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in v if j != i and len(x) == len(q)))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block,queries", [(2048, 4096), (16, 3)])
def test_nearest_vectors(spark, monkeypatch, block, queries):
    monkeypatch.setattr(knn_join, "DATA_BLOCK", block)
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", queries)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 6)) * 3
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=6) * 0.1]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, rows[0][1]), (310, [1.0, 2.0]), (320, [3.0, -1.0]), (330, []), (340, []), (350, [1e6] * 6)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, id string, v string")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in knn_join.top_k(table, 4, 10).collect()}
    assert got == knn_brute(rows, 4, 10)
    assert knn_join.top_k(table.limit(0), 4, 10).count() == 0


@pytest.mark.parametrize("pivots", [(1, 1, 9), (2, 40, 40)])
def test_nearest_vectors_with_few_and_many_pivots(spark, monkeypatch, pivots):
    for name, n in zip(("PIVOT_QUERIES", "LEAST_PIVOTS", "MOST_PIVOTS"), pivots):
        monkeypatch.setattr(knn_join, name, n)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 8 * (i % 3)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in knn_join.top_k(table, 5, 10).collect()} == knn_brute(rows, 5, 10)


def test_large_components_are_exact_or_an_error(spark):
    make = lambda *vectors: spark.createDataFrame([(i, list(v)) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    top = lambda t: {(r.query_id, r.rank, r.vec_id, r.score) for r in knn_join.top_k(t, 2, 1).collect()}
    near = [(1e6, 3.0), (1e6, 4.0), (-1e6, 5.0), (2e5, 1.0)]
    assert top(make(*near)) == knn_brute(list(enumerate(near)), 2, 1)
    cancel = [(4e6, -4e6), (4e6, 4e6 - 1), (1.0, 2.0)]  # single products are over 2**62 / 2
    assert top(make(*cancel)) == knn_brute(list(enumerate(cancel)), 2, 1)
    for wide in ([(1e30,), (2.0,)], [(1e12, 1.0), (1e12, 2.0)]):
        with pytest.raises(Exception, match="too large"):
            top(make(*wide))


def test_bounds_leave_out_what_cannot_matter(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 50
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=8) * 0.1]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in knn_join.top_k(table, 3, 50).collect()} == knn_brute(rows, 3, 50)


def test_shared_folder_is_the_sessions(spark):
    assert util.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    table = util.cut(spark.range(5).toDF("x"), "t")
    assert table.count() == 5 and util.small(table, 5) is not table and util.small(table, 4) is table
