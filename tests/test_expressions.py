from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.functions import imaging
from loomlake.functions import paths as P
from loomlake.functions import pixels as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def grid():
    return np.random.default_rng(5).normal(size=(8, 8))


def test_bits_follow_numpy(spark, grid):
    px = [float(v) for v in grid.ravel()]
    dct = X.cosine_matrix(8) @ grid @ X.cosine_matrix(8).T
    blocks = grid.reshape(4, 2, 4, 2).mean(axis=(1, 3))
    expected = {"ahash": grid > grid.mean(), "dhash": grid[:, 1:] > grid[:, :-1], "phash": dct > np.median(dct), "whash": blocks > np.median(blocks)}
    for name, bits in expected.items():
        assert one(spark, X.hash_bits(F.col("px"), name), px=px) == bits.ravel().astype(int).tolist()


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        X.hash_bits(F.lit(1), "nohash")
    with pytest.raises(ValueError):
        imaging.image_hash(np.zeros((8, 8, 3), np.uint8), "nohash")


def test_words_blobs_and_distances(spark):
    bits = [1] + [0] * 62 + [1]
    word = one(spark, X.pack(F.col("b")), b=bits)
    assert word == -(1 << 63) + 1
    assert one(spark, X.blob_to_word(X.word_to_blob(F.col("w"))), w=word) == word
    assert one(spark, X.hamming(F.col("a"), F.col("b")), a=-1, b=0) == 64
    assert one(spark, X.pack_words(F.col("b")), b=bits * 4) == [word] * 4
    assert one(spark, X.hamming_words(F.col("a"), F.col("b")), a=[0, 3], b=[1, 0]) == 3


def test_variants_are_turns_and_mirrors(spark, grid):
    got = one(spark, X.variants(F.col("px")), px=[float(v) for v in grid.ravel()])
    expected = [v for k in range(4) for t in [np.rot90(grid, k)] for v in (t, np.fliplr(t))]
    assert [list(v.ravel()) for v in expected] == got


def test_vectors(spark):
    assert one(spark, X.normalized(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, X.normalized(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, X.median(F.col("v")), v=[4.0, 1.0, 3.0]) == 3.0
    assert one(spark, X.median(F.col("v")), v=[4.0, 1.0, 3.0, 2.0]) == 2.5
    assert one(spark, X.histogram_similarity(F.col("v"), F.lit(None).cast("array<double>")), v=[1.0]) == 0.0
    assert one(spark, X.blend(F.col("p"), F.lit(None).cast("double"), 0.25), p=0.8) == pytest.approx(0.6)


@pytest.mark.parametrize("path,key", [("/a/b/../b/c.jpg", "/a/b/c.jpg"), ("a//b/./c", "a/b/c"), ("../x", "../x"), ("a/../../x", "../x"), ("/../x", "/x"), ("a/..", "."), ("/", "/"), ("", "."), ("\\\\?\\C/x", "C/x")])
def test_normalize_key(spark, path, key):
    assert one(spark, P.normalize_key(F.col("p")), p=path) == key


@pytest.mark.parametrize("path,suffix", [("/a/b.JPG", ".jpg"), ("/a.b/c", ""), (".png", ""), ("x.tar.png", ".png"), ("x.", ".")])
def test_extension(spark, path, suffix):
    assert one(spark, P.extension(F.col("p")), p=path) == suffix


def test_names(spark):
    assert P.extension_set(["JPG", " .png "]) == {".jpg", ".png"}
    assert one(spark, P.family_of(F.col("p")), p="/x/fam1_rot90.png") == "fam1"
    assert one(spark, P.thumb_name(F.col("p")), p="abc") == "a9993e364706816aba3e25717850c26c9cd0d89d.jpg"
    assert one(spark, P.is_unc(F.col("p")), p="//host/share") and not one(spark, P.is_unc(F.col("p")), p="/host")


def test_image_signatures():
    rgb = np.random.default_rng(1).integers(0, 256, (64, 48, 3), dtype=np.uint8)
    for a in imaging.ALGORITHMS:
        assert imaging.image_hash(rgb, a) == imaging.image_hash(rgb, a) and len(imaging.image_hash(rgb, a)) == 1
        assert len(imaging.image_hash(rgb, a, 16)) == 4
    assert imaging.color_histogram(rgb).sum() == pytest.approx(1) and len(imaging.color_histogram(rgb)) == 72
    assert len(imaging.embedding(rgb)) == 456
    w, h, px = imaging.thumbnail(rgb, 32)
    assert (w, h, len(px)) == (24, 32, 24 * 32 * 3)
    assert imaging.thumbnail(rgb, 256)[:2] == (48, 64)
    grey = np.full((5, 5, 3), 100, np.uint8)
    assert imaging.hsv(grey)[1].max() == 0


def test_hash_survives_a_resize():
    rgb = np.kron(np.random.default_rng(2).integers(0, 256, (16, 16, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    half = rgb[::2, ::2]
    a, b = (imaging.image_hash(x)[0] for x in (rgb, half))
    assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 10


def test_haar_corner_is_a_block_mean():
    px = np.random.default_rng(3).random((32, 32))
    low = px
    for _ in range(2):
        low = (low[:, ::2] + low[:, 1::2]) / 2
        low = (low[::2] + low[1::2]) / 2
    assert np.allclose(low, px.reshape(8, 4, 8, 4).mean(axis=(1, 3)))
