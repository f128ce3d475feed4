"""Nearest vectors by cosine: exact by blocks of queries, or approximate by random projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that tasks are sent along with one pass over the library; more are dealt into blocks of about as many.
QUERY_BLOCK = 2048
#: Vectors of a block that meets a block of queries.
DATA_BLOCK = 1 << 16
#: Scores held at once.
AT_ONCE = 1 << 22
#: Digits by which cosines are told apart.
DIGITS = 12
FOUND = "query_id bigint, variant int, image_id bigint, cosine double"


def _unit(x: np.ndarray, eps: float = 0.0) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True)) + eps
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _by_length(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of the vectors of each length; null ones and those that hold a null are left out."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        x = flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
        whole = np.isfinite(x).all(1)
        if whole.any():
            yield size, at[whole], x[whole]


def _best(wanted: np.ndarray, unit: np.ndarray, image: np.ndarray, k: int, alike=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, image and cosine of each query's k best unit vectors, ties to the lesser image."""
    out = []
    step = max(1, AT_ONCE // max(1, len(unit)))
    for at in range(0, len(wanted), step):
        scores = np.round(wanted[at : at + step] @ unit.T, DIGITS)
        if alike:
            scores[~alike(wanted[at : at + step], unit)] = -np.inf
        if len(unit) > 4 * k:  # ties with the k-th go along
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        else:
            row, col = np.nonzero(scores > -np.inf)
        order = np.lexsort((image[col], -scores[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < k
        out.append((row[top] + at, image[col[top]], scores[row[top], col[top]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest_by_cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, variant, image_id, cosine, rank: the k vectors with the highest cosine, for each query vector; ties to lesser ids.

    queries: query_id, variant, vec; vectors: image_id, vec. Up to QUERY_BLOCK queries, which are counted, go with one pass
    over the vectors, which aren't moved. More are dealt into blocks, vectors too, and each pair of blocks is a task. Either
    way k rows for each query and batch or block are shuffled, not all pairs. Vectors of other lengths don't match; null ones
    and those with null or non-finite numbers take no part, on either side.
    """
    return _nearest(queries, vectors, k)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """As nearest_by_cosine; alike, if given, says from unit queries and unit vectors which pairs of them count."""
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("variant").cast("int").alias("variant"), F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    held = vectors.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    few = rows.limit(QUERY_BLOCK + 1).toArrow()
    found = _scanned(few, held, k, alike) if few.num_rows <= QUERY_BLOCK else _by_blocks(rows, held, k, alike)
    order = Window.partitionBy("query_id", "variant").orderBy(F.desc("cosine"), "image_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rows(ids: np.ndarray, which: np.ndarray, row: np.ndarray, image: np.ndarray, score: np.ndarray) -> list[pa.Array]:
    return [pa.array(ids[row], pa.int64()), pa.array(which[row], pa.int32()), pa.array(image, pa.int64()), pa.array(score, pa.float64())]


def _scanned(few: pa.Table, vectors: DataFrame, k: int, alike) -> DataFrame:
    ids, which = few.column("query_id").to_numpy(), few.column("variant").to_numpy()
    wanted = {size: (at, _unit(x)) for size, at, x in _by_length(few.column("vec"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = batch.column("image_id").to_numpy()
            for size, places, x in _by_length(batch.column("vec")):
                if size in wanted:
                    at, own = wanted[size]
                    row, near, score = _best(own, _unit(x), image[places], k, alike)
                    yield pa.RecordBatch.from_arrays(_rows(ids[at], which[at], row, near, score), names=["query_id", "variant", "image_id", "cosine"])

    return vectors.mapInArrow(run, FOUND)


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, alike) -> DataFrame:
    asked, held = -(-queries.count() // QUERY_BLOCK), max(1, -(-vectors.count() // DATA_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id", "variant", "vec"), F.lit(asked)).cast("int")).withColumn("db", every(held))
    right = vectors.withColumn("db", F.pmod(F.xxhash64("image_id", "vec"), F.lit(held)).cast("int")).withColumn("qb", every(asked))
    schema = pa.schema([("query_id", pa.int64()), ("variant", pa.int32()), ("image_id", pa.int64()), ("cosine", pa.float64())])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        ids, which, image = one.column("query_id").to_numpy(), one.column("variant").to_numpy(), two.column("image_id").to_numpy()
        wanted = {size: (at, _unit(x)) for size, at, x in _by_length(one.column("vec"))}
        parts = [pa.Table.from_arrays(_rows(ids[wanted[size][0]], which[wanted[size][0]], *_best(wanted[size][1], _unit(x), image[at], k, alike)), schema=schema) for size, at, x in _by_length(two.column("vec")) if size in wanted]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(run, FOUND)


def nearest_approximate(queries: DataFrame, vectors: DataFrame, k: int, bucket: float = 0.5, tables: int = 4) -> DataFrame:
    """query_id, image_id, cosine, rank: the k best of the vectors that share a bucket of a random projection with the query.

    Some of the k nearest may be missed, but a query has k rows (or all vectors): one that meets fewer is answered exactly.
    """

    def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        planes = _unit(np.random.default_rng(11).normal(size=(tables, left.shape[1])))
        met = np.zeros((len(left), len(right)), bool)
        for plane in planes:
            met |= np.floor(left @ plane / bucket)[:, None] == np.floor(right @ plane / bucket)
        return met

    wanted = queries.select("query_id", F.lit(0).alias("variant"), "vec")
    near = _nearest(wanted, vectors, k, alike).persist()  # k narrow rows for each query, read three times
    full = near.filter(F.col("rank") == k).select("query_id")
    exact = nearest_by_cosine(wanted.join(full, "query_id", "left_anti"), vectors, k)
    return near.join(full, "query_id", "left_semi").unionByName(exact).select("query_id", "image_id", "cosine", "rank")
