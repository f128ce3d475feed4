"""The pipeline and the registered queries on the smallest tables."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from loomlake.llm import quality, registry, suffix_dedup
from loomlake.llm.tokens import Pieces

from .conftest import documents
from .test_near_dedup import brute as near_brute
from .test_suffix_dedup import brute as marks_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_and_sql_agree(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    said = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    rows = lambda found, pick: Counter(tuple(r[i] for i in pick) for r in found)
    assert rows((tuple(r) for r in got.collect()), [got.columns.index(c) for c in sorted(names)]) == rows(said.fetchall(), order)


def cut_text(text: str, mark: bytearray) -> str:
    """text without marked bytes, where a run of marks covers whole characters."""
    data, kept, i = text.encode(), bytearray(), 0
    while i < len(data):
        j = i
        while j < len(data) and mark[j] == mark[i]:
            j += 1
        b, e = i, j
        if mark[i]:
            while b < e and data[b] & 0xC0 == 0x80:
                b += 1
            while b < e < len(data) and data[e] & 0xC0 == 0x80:
                e -= 1
            kept += data[i:b] + data[e:j]
        else:
            kept += data[i:j]
        i = j
    return kept.decode()


def test_pipeline_follows_brute_force(spark, duck, tokenizers_path):
    kept = {r[0] for r in duck.execute(f"select doc_id from ({quality.ORACLE_SQL}) where kept").fetchall()}
    rows = [r for r in duck.execute("select doc_id, text from documents order by doc_id").fetchall() if r[0] in kept]
    own = {i for i, _, c in near_brute(rows, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY_PERCENT) if i == c}
    rows = [r for r in rows if r[0] in own]
    texts = {i: cut_text(t, m) for (i, t), m in marks_of(rows).items()}
    assert 100 == suffix_dedup.LENGTH and any(len(texts[i]) < len(t) for i, t in rows)
    library = Pieces(tokenizers_path("word_bpe_49k.json"), True).library
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}

    covered, used = Counter(), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered.update((r.doc_id, r.start + k) for k in range(r.length))
        used[r.sequence_id] += r.length
    assert covered == Counter({(i, k): 1 for i, x in ids.items() for k in range(len(x))})
    assert all(n == corpus_pipeline.WINDOW or n & (n - 1) == 0 for n in used.values())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_dedup_stage_broadcasts_no_table_by_estimate(spark):
    """What the stage leaves out is a large share of the documents; Spark's estimate of it is its compressed size."""
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [(i, text if i % 2 else " ".join(f"v{i}x{n}" for n in range(50))) for i in range(40)])
    out = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in out.collect()) == sorted([1, *range(0, 40, 2)])


def test_suffix_stage_broadcasts_no_table_by_estimate(spark):
    """Spans and windows are read from written tables, which Spark takes by their compressed size."""
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [(i, f"{i} {text}") for i in range(6)])
    out = corpus_pipeline.suffix_array_dedup(spark, docs, "")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: len(r.text) for r in out.collect()} == {i: len(f"{i} {text}") if i == 0 else 1 for i in range(6)}
