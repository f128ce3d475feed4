"""Hamming-distance joins over packed 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import hamming, hamming_score, variants
from .blocks import in_blocks

BITS, BANDS = 64, 4
WIDTH = BITS // BANDS
#: Query rows up to which they are broadcast, at some twenty bytes a row; more go through bands of the hash.
BROADCAST_QUERIES = 50_000
#: Values around a hash in all bands (188 for a distance of 8) up to which a self join goes by bands; beyond, tiles cost less.
BAND_PLACES = 200
#: Distinct hashes of a block, about; a tile compares two blocks.
TILE = 16_384
#: Tiles that a task gets, about, while there are at most MOST_TASKS tasks.
TASK_TILES, MOST_TASKS = 4, 10_000
#: Pairs of a batch that a tile gives out, about.
BATCH_PAIRS = 200_000
DEFAULT_DISTANCE = 12
DUPLICATE_DISTANCE = 8


def expand_variants(queries: DataFrame, px_col: str = "px") -> DataFrame:
    """queries with variant (0 to 7) and the variant's pixels: a row becomes eight."""
    others = [c for c in queries.columns if c != px_col]
    return queries.select(*others, F.posexplode(variants(F.col(px_col))).alias("variant", px_col))


def candidate_width(k: int) -> int:
    return max(3 * k, 100)


@cache
def _radii(distance: int) -> tuple[int, ...]:
    """For each band, the bits that may differ in it: hashes within distance keep to one of these, as the radii and one each add up to distance + 1."""
    more, least = (distance + 1) % BANDS, (distance + 1) // BANDS
    return tuple(least - 1 + (i < more) for i in range(BANDS))


@cache
def _masks(radius: int) -> list[int]:
    """All values of a band with at most radius bits."""
    return [sum(1 << b for b in some) for n in range(radius + 1) for some in combinations(range(WIDTH), n)]


def _value(h: Column, band: int) -> Column:
    return F.shiftrightunsigned(h, band * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _places(h: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("band"), _value(h, i).alias("value")) for i in range(BANDS)))


def _bands(rows: DataFrame, h: str) -> DataFrame:
    """band and value of each of BANDS parts beside rows."""
    return rows.withColumn("_b", F.explode(_places(F.col(h)))).select("*", "_b.band", "_b.value").drop("_b")


def _near_bands(rows: DataFrame, h: str, distance: int, band: str, value: str) -> DataFrame:
    """band and value beside rows, for each value of a band that a hash within distance may have where it keeps to the band's radius."""

    def around(i: int, radius: int) -> Column:
        return F.transform(F.lit(_masks(radius)), lambda m: F.struct(F.lit(i).alias("band"), _value(F.col(h), i).bitwiseXOR(m).alias("value")))

    each = [around(i, r) for i, r in enumerate(_radii(distance)) if r >= 0]
    return rows.withColumn("_place", F.explode(F.concat(*each))).select("*", F.col("_place.band").alias(band), F.col("_place.value").alias(value)).drop("_place")


def _first_band(a: str, b: str, distance: int) -> Column:
    """The first band in which the two keep to its radius."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.coalesce(*(F.when(F.bit_count(_value(x, i)) <= r, F.lit(i)) for i, r in enumerate(_radii(distance)) if r >= 0))


def hamming_join(queries: DataFrame, images: DataFrame, distance: int | None = DEFAULT_DISTANCE, query_hash: str = "qh", image_hash: str = "h") -> DataFrame:
    """All columns of both, and dist, for pairs within distance; none or one of 0 or less is no limit.

    Rows without hash take no part. Up to BROADCAST_QUERIES queries, which are counted, are broadcast and compared with all
    images in one pass of generated code. More meet images by BANDS parts of the hash: with a distance d, some part differs in
    no more bits than its radius, and radii add up to d + 1 - BANDS; queries are put to all values within the radius. Pairs are
    unique by the first part that keeps to it. Without a limit all pairs are the result, and go by blocks.
    """
    images, queries = images.filter(F.col(image_hash).isNotNull()), queries.filter(F.col(query_hash).isNotNull())
    limit = distance if distance and distance > 0 else BITS
    dist = hamming(F.col(query_hash), F.col(image_hash))
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        return images.join(F.broadcast(queries), dist <= limit).withColumn("dist", dist)
    if limit >= BITS:
        return in_blocks(queries, images, image_hash).withColumn("dist", dist)
    left = _near_bands(queries, query_hash, limit, "_qb", "_qv")
    pairs = _bands(images, image_hash).join(left.hint("merge"), (F.col("band") == F.col("_qb")) & (F.col("value") == F.col("_qv"))).withColumn("dist", dist).filter(F.col("dist") <= limit)
    return pairs.filter(_first_band(query_hash, image_hash, limit) == F.col("band")).drop("band", "value", "_qb", "_qv")


def _band_pairs(kinds: DataFrame, distance: int) -> DataFrame:
    """h <= g, dist: pairs of the hashes h within distance, by bands. No estimate knows what explode adds, so nothing is broadcast by one."""
    two = _near_bands(kinds.select(F.col("h").alias("g")), "g", distance, "_b", "_v")
    near = _bands(kinds, "h").join(two.hint("merge"), (F.col("band") == F.col("_b")) & (F.col("value") == F.col("_v")) & (F.col("h") <= F.col("g")))
    return near.withColumn("dist", hamming(F.col("h"), F.col("g"))).filter((F.col("dist") <= distance) & (_first_band("h", "g", distance) == F.col("band"))).select("h", "g", "dist")


def _compared(one: np.ndarray, two: np.ndarray, same: bool, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes and distances of the pairs of one and two within distance; of a block with itself, each pair once, and each hash with itself."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.repeat([k for k, *_ in held], [len(x) for _, x, _ in held])
        return one[at].view(np.int64), two[np.concatenate([x for _, x, _ in held])].view(np.int64), np.concatenate([x for *_, x in held])

    one, two = one.view(np.uint64), two.view(np.uint64)  # of a negative number, numpy counts another's bits
    apart, bits = np.empty_like(two), np.empty(len(two), np.uint8)
    for k in range(len(one)):
        begin = k if same else 0
        x = np.bitwise_xor(two[begin:], one[k], out=apart[begin:])
        n = np.bitwise_count(x, out=bits[begin:])
        found = np.flatnonzero(n <= distance)
        if len(found):
            held.append((k, found + begin, n[found]))
            size += len(found)
        if size >= BATCH_PAIRS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _tile_pairs(kinds: DataFrame, distance: int) -> DataFrame:
    """h, g, dist: as _band_pairs, but each hash is compared with each, by tiles of two blocks; h and g come in either order."""
    blocks = max(1, -(-kinds.count() // TILE))
    rows = kinds.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("h").alias("hs"))
    tasks = min(MOST_TASKS, -(-blocks * (blocks + 1) // 2 // TASK_TILES))
    left = rows.select(F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), F.col("hs").alias("one")).repartition(tasks, "i", "j")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("_i"), F.col("block").alias("_j"), F.col("hs").alias("two")).repartition(tasks, "_i", "_j")
    tiles = left.join(right.hint("merge"), (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j"))).select("i", "j", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, one, two in zip(*(batch.column(c) for c in ("i", "j", "one", "two"))):
                for h, g, dist in _compared(one.values.to_numpy(), two.values.to_numpy(), i == j, distance):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(dist.astype(np.int32))], names=["h", "g", "dist"])

    return tiles.mapInArrow(run, "h bigint, g bigint, dist int")


def self_join(images: DataFrame, distance: int, id_col: str = "image_id", hash_col: str = "h") -> DataFrame:
    """a < b, dist: pairs of images within distance. Equal hashes meet once by hash, and only distinct hashes are compared.

    A hash has so many others around it in its bands; beyond BAND_PLACES of them, all pairs of hashes are compared by tiles,
    which costs less than to write the places and what meets there.
    """
    held = images.filter(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    kinds = held.select("h").distinct()
    places = sum(comb(WIDTH, n) for r in _radii(distance) for n in range(r + 1))
    near = (_band_pairs if places <= BAND_PLACES else _tile_pairs)(kinds, distance).select(F.col("h").alias("_h"), F.col("g").alias("_g"), "dist")
    left, right = held.select(F.col("id").alias("x"), "h"), held.select(F.col("id").alias("y"), F.col("h").alias("g"))
    pairs = near.join(left.hint("merge"), F.col("_h") == F.col("h")).join(right.hint("merge"), F.col("_g") == F.col("g")).filter((F.col("_h") != F.col("_g")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")


def nearest_by_hash(queries: DataFrame, images: DataFrame, k: int, distance: int | None = DEFAULT_DISTANCE) -> DataFrame:
    """query_id, image_id, pattern_score, dist: the best of a query's variants, from the candidates nearest to each variant.

    queries: query_id, variant, qh; images: image_id, h.
    """
    near = hamming_join(queries.select("query_id", "variant", "qh"), images.select("image_id", "h"), distance)
    order = Window.partitionBy("query_id", "variant").orderBy("dist", "image_id")
    near = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= candidate_width(k))
    return near.groupBy("query_id", "image_id").agg(F.max(hamming_score(F.col("dist"))).alias("pattern_score"), F.min("dist").alias("dist"))


def buckets(images: DataFrame, hash_col: str = "h", id_col: str = "image_id") -> DataFrame:
    """hash and the ascending ids that share it."""
    return images.groupBy(hash_col).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
