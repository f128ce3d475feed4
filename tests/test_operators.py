from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.operators import catalog as C
from loomlake.operators import evaluate as E
from loomlake.operators import hamming as H
from loomlake.operators import search as S
from loomlake.operators import vectors as V
from loomlake.plans import catalogue


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.fixture(scope="module")
def hashes():
    return {i: signed((i * 2654435761 * 40503) & ((1 << 64) - 1)) for i in range(200)}


def pairs(a: dict, b: dict, limit: int):
    return {(i, j) for i, x in a.items() for j, y in b.items() if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= limit}


@pytest.mark.parametrize("limit", [1, 7, 20])
def test_bands_find_what_loops_find(spark, hashes, limit, monkeypatch):
    images = spark.createDataFrame([*hashes.items(), (999, None)], "image_id bigint, h bigint")
    wanted = spark.createDataFrame([(i, h ^ 5) for i, h in hashes.items()], "query_id bigint, qh bigint")
    expected = pairs({i: h ^ 5 for i, h in hashes.items()}, hashes, limit)
    for most in (50_000, 0):
        monkeypatch.setattr(H, "BROADCAST_QUERIES", most)
        got = [(r.query_id, r.image_id) for r in H.hamming_join(wanted, images, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_range_and_duplicates(spark):
    images = spark.createDataFrame([(1, 0b0000), (2, 0b0011), (3, 0b1111), (4, 0b0001), (5, 0b0001)], "image_id bigint, h bigint")
    wanted = spark.createDataFrame([(9, 0)], "query_id bigint, qh bigint")
    assert {r.image_id for r in H.hamming_join(wanted, images, 1).collect()} == {1, 4, 5}
    assert H.hamming_join(wanted, images, 0).count() == 5  # no limit
    assert {(r.a, r.b, r.dist) for r in H.self_join(images, 1).collect()} == {(1, 4, 1), (1, 5, 1), (4, 5, 0), (2, 4, 1), (2, 5, 1)}
    assert {tuple(r.ids) for r in H.buckets(images).collect()} == {(1,), (2,), (3,), (4, 5)}


def test_exact_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([*((i, [float(v) for v in r]) for i, r in enumerate(x)), (60, None), (61, [1.0])], "image_id bigint, vec array<double>")
    wanted = rows.filter("image_id < 7").select(F.col("image_id").alias("query_id"), F.lit(0).alias("variant"), "vec")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = {(q, int(i)) for q in range(7) for i in np.argsort(-(u @ u[q]))[:4]}
    for block in (2048, 3):
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        assert {(r.query_id, r.image_id) for r in V.nearest_by_cosine(wanted, rows, 4).collect()} == expected
    assert V.nearest_by_cosine(wanted.limit(0), rows, 4).count() == 0


def test_approximate_neighbours_reach_recall_and_fill_k(spark):
    x = np.random.default_rng(8).normal(size=(600, 64))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "image_id bigint, vec array<double>")
    wanted = rows.filter("image_id % 10 = 0").select(F.col("image_id").alias("query_id"), "vec")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {(q, int(i)) for q in range(0, 600, 10) for i in np.argsort(-(u @ u[q]))[:10]}
    got = {(r.query_id, r.image_id) for r in V.nearest_approximate(wanted, rows, 10).collect()}
    assert len(got) == 600  # k for each query
    assert len(got & best) >= 0.9 * len(best)
    short = {(r.query_id, r.image_id) for r in V.nearest_approximate(wanted, rows, 10, bucket=0.001, tables=1).collect()}
    assert short == best  # hardly any pair meets: answered exactly
    assert V.nearest_approximate(wanted, rows.limit(4), 10).count() == 4 * 60


def scan_of(spark, rows):
    return spark.createDataFrame(rows, "key string, mtime double, size bigint")


def test_diff(spark):
    old = scan_of(spark, [("same", 1.0, 5), ("late", 1.0, 5), ("grown", 1.0, 5), ("gone", 1.0, 5)])
    new = scan_of(spark, [("same", 3.0, 5), ("late", 3.01, 5), ("grown", 1.0, 6), ("new", 0.0, 1)])
    got = {r.key: r.change for r in C.diff(new, old).collect()}
    assert got == {"same": "unchanged", "late": "changed", "grown": "changed", "gone": "missing", "new": "new"}
    assert C.diff_counts(C.diff(new, old)).first().asDict() == {"n_new": 1, "n_changed": 2, "n_missing": 1, "n_unchanged": 1}
    assert {r.key for r in C.missing_keys(new, old).collect()} == {"gone"}
    held = old.withColumn("status", F.lit("missing"))
    assert {r.key for r in C.diff(new, held, retry=True).filter("change = 'changed'").collect()} == {"same", "late", "grown"}


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 6, "y")], "id bigint, key string, size bigint, path string")
    new = spark.createDataFrame([("b", None), ("c", 9)], "key string, size bigint")
    merged = C.with_ids(C.upsert(old, new))
    assert {tuple(r) for r in merged.collect()} == {(1, "a", 5, "x"), (2, "b", None, "y"), (3, "c", 9, None)}


def test_vectors_and_deletes(spark):
    images = spark.createDataFrame([(1, "a", "ok"), (2, "b", "ok"), (3, "c", "missing")], "id bigint, key string, status string")
    held = spark.createDataFrame([(1, [1.0]), (3, [3.0])], "image_id bigint, vec array<float>")
    assert [r.key for r in C.keys_missing_vectors(images, held).collect()] == ["b"]
    assert [r.image_id for r in C.vectors_of_ok(images, held).collect()] == [1]
    put = spark.createDataFrame([(2, [2.0], 1), (2, [9.0], 2)], "image_id bigint, vec array<float>, at int")
    assert {r.image_id: r.vec for r in C.upsert_vectors(held, put, "at").collect()} == {1: [1.0], 2: [9.0], 3: [3.0]}
    left, kept = C.delete_keys(images, held, images.filter("key = 'a'"))
    assert {r.key for r in left.collect()} == {"b", "c"} and {r.image_id for r in kept.collect()} == {3}
    assert C.stats(images).first().asDict() == {"total": 3, "ok": 2, "missing": 1, "error": 0}
    marked = C.mark_status(images.withColumn("error", F.lit("old")), images.filter("key = 'a'"), "missing")
    assert {(r.key, r.status, r.error) for r in marked.collect()} == {("a", "missing", None), ("b", "ok", "old"), ("c", "missing", "old")}
    assert C.point(images, key="b").first().id == 2 and C.point(images, key="z").count() == 0


def test_finalize_rejects_no_results(spark):
    with pytest.raises(ValueError):
        S.finalize(None, None, None, 0)


def test_quality(spark):
    results = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 2, 1), (2, 3, 2), (2, 1, 3)], "query_id bigint, image_id bigint, rank int")
    families = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "image_id bigint, family string")
    row = E.quality(results, families, (1, 2)).first()
    assert (row.n, row.hit_1, row.hit_2, row.recall_1, row.recall_2) == (2, 0.5, 1.0, 0.5, 1.0)


def test_far_self_joins_compare_all_hashes_by_tiles(spark, hashes, monkeypatch):
    """Beyond BAND_PLACES no values around hashes are listed (6,428 of each at 17), no table is broadcast by an estimate, and signs, copies and blocks don't matter."""
    rows = [*hashes.items(), (300, -1), (301, 0), (302, -(1 << 63)), (303, hashes[7]), (304, hashes[7]), (999, None)]
    images = spark.createDataFrame(rows, "image_id bigint, h bigint")
    held = dict(rows[:-1])
    for limit, tile in ((9, 16_384), (17, 50), (22, 16_384), (22, 7), (64, 50)):
        monkeypatch.setattr(H, "TILE", tile)
        monkeypatch.setattr(H, "BATCH_PAIRS", 100)
        out = H.self_join(images, limit)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "MapInArrow" in plan
        got = [(r.a, r.b, r.dist) for r in out.collect()]
        expected = {(a, b, ((held[a] ^ held[b]) & ((1 << 64) - 1)).bit_count()) for a, b in pairs(held, held, limit) if a < b}
        assert len(got) == len(set(got)) and set(got) == expected


def test_near_self_joins_broadcast_nothing_by_estimate(spark, hashes):
    rows = [*hashes.items(), *((1000 + i, signed((h & ((1 << 64) - 1)) ^ (1 << i % 60) ^ 1)) for i, h in hashes.items())]
    out = H.self_join(spark.createDataFrame(rows, "image_id bigint, h bigint"), 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" not in plan
    held = dict(rows)
    assert {(r.a, r.b) for r in out.collect()} == {(a, b) for a, b in pairs(held, held, 8) if a < b}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_banded_self_join_writes_no_values_around_hashes(spark):
    """At a distance of 17 a hash has 6,428 values around it in its bands."""
    plan = catalogue.queries()["q09_hamming_selfjoin_banded"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "value#" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_hits_by_hash_compare_hashes_once_and_keep_what_the_cuts_need(spark):
    plan = catalogue.queries()["q34c_family_hit_by_hash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "WindowGroupLimit [query_id" in plan
