"""Exact top-k by integer inner product: a Voronoi kNN join.

Pivots, one for every PIVOT_QUERIES queries, cut space into cells. Queries are grouped by the cell of their nearest pivot, in blocks. Each query's
k-th best score in a block of its own cell bounds its result from below; with the radius of a cell's queries and the
lengths of vectors, this bounds what a vector must reach to matter to any query of a cell. A vector goes to those cells'
queries only, spread over blocks of rows, and what blocks find is merged. No cell, however many rows it holds, is in one task.
Where bounds leave out nothing, as among vectors without clusters, each vector goes to every cell, so pivots are few while
queries are. Pivots decide how much is moved, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import cut

#: Queries for which there is one pivot, and the fewest and the most pivots.
PIVOT_QUERIES, LEAST_PIVOTS, MOST_PIVOTS = 128, 4, 4096
#: A component from here on is an error; 64-bit integers are used while all sums stay below it.
MOST = 1 << 62
QUERY_BLOCK = 4096
DATA_BLOCK = 2048
#: Queries of a block that are solved at once.
AT_ONCE = 512


def quantized(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id, v: floor(scale * x) of each component; without vectors that are null or hold null or non-finite components. Components of MOST or more are an error."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & whole).select("id", F.transform(v, lambda x: F.when(F.abs(x * scale) < float(MOST), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("bigint"))).alias("v"))


def _matrix(column) -> np.ndarray:
    """A list column as rows of numbers; all lists are of one length."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _pivots(rows: DataFrame, every: int) -> np.ndarray:
    """Distinct vectors of the commonest length among some rows that are chosen by their ids' hashes."""
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, asked // PIVOT_QUERIES))
    chosen = F.xxhash64("id")
    some = rows.filter(F.pmod(chosen, F.lit(max(1, n // (16 * wanted)))) == 0).select(chosen.alias("h"), "v").orderBy("h", "v").limit(4 * wanted).collect()
    lengths = [len(r.v) for r in some]
    held = [tuple(r.v) for r in some if len(r.v) == max(set(lengths), key=lengths.count)]
    return np.array(list(dict.fromkeys(held))[:wanted], float) if held else np.zeros((0, 0))


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, dim, cell, dist (to the cell's pivot), size (length), v. Vectors of other lengths have a cell around the origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            dims = np.array([len(x) for x in v], np.int64)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("v")).astype(float)
                size = np.sqrt((x * x).sum(1)) if dim else np.zeros(len(x))
                cell, dist = np.full(len(x), -1), size
                if len(pivots) and pivots.shape[1] == dim:
                    far = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)))
                    cell = far.argmin(1)
                    dist = far[np.arange(len(x)), cell]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.full(len(x), dim, np.int64)), pa.array(cell.astype(np.int64)), pa.array(dist, pa.float64()), pa.array(size, pa.float64()), part.column("v")], names=["id", "dim", "cell", "dist", "size", "v"])

    return rows.mapInArrow(run, "id bigint, dim bigint, cell bigint, dist double, size double, v array<bigint>")


def _packed(rows: DataFrame) -> DataFrame:
    """rows with v as bytes, two for each component where that is enough: it is what joins move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v"):
                x = x.values.to_numpy()
                kind = "<i2" if not len(x) or np.abs(x).max() < 1 << 15 else "<i8"
                out.append(x.astype(kind).tobytes())
            yield batch.set_column(batch.schema.get_field_index("v"), "v", pa.array(out, pa.binary()))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "v")
    return rows.select(*(c for c in rows.columns if c != "v"), "v").mapInArrow(run, f"{names}, v binary")


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    held = table.column("v").to_pylist()
    return np.stack([np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<i8").astype(np.int64) for x in held]) if dim else np.zeros((len(held), 0), np.int64)


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, id and score of each query's k best rows of x by score, then by lesser id; its own id is left out.

    Scores are exact: float64 where all sums stay below 2**52, 64-bit integers where they can't overflow, else integers of any
    size; one that 64 bits can't hold is an error.
    """
    order = np.argsort(x_ids, kind="stable")
    x, x_ids = x[order], x_ids[order]
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    exact = most * (len(x) + 1) < 2**52
    out = []
    for at in range(0, len(q), AT_ONCE):
        part = q[at : at + AT_ONCE]
        own = q_ids[at : at + AT_ONCE, None] == x_ids
        if exact:
            scores = (part.astype(float) @ x.T.astype(float)).astype(np.int64)
        elif most < MOST:
            scores = part @ x.T
        else:
            scores = part.astype(object) @ x.T.astype(object)
            scores[own] = 0  # it is left out
            if scores.size and max(abs(scores.max()), abs(scores.min())) >= (1 << 63) - 1:
                raise ValueError("a score is too large for 64 bits")
            scores = scores.astype(np.int64)
        if exact:  # one number for score and place
            keys = scores * len(x) - np.arange(len(x))
            keys[own] = np.iinfo(np.int64).min + 1  # its negative is a number too
            some = np.argpartition(-keys, min(k, len(x)) - 1, axis=1)[:, :k] if len(x) > k else np.broadcast_to(np.arange(len(x)), keys.shape)
        else:
            some = np.stack([np.lexsort((np.arange(len(x)), -s.astype(float), -s, o))[:k] for s, o in zip(scores, own)])
        row = np.repeat(np.arange(len(part)), some.shape[1])
        col = some.ravel()
        keep = ~own[row, col]
        out.append((row[keep] + at, x_ids[col[keep]], scores[row[keep], col[keep]]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _solve(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, cell, dim, vec_id, score: the k best of each unit (dim, cell, qb, db) that both tables have."""
    schema = pa.schema([(c, pa.int64()) for c in ("query_id", "dim", "cell", "qb", "vec_id", "score")])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim, cell, qb, _ = (x.as_py() for x in key)
        q_ids = left.column("id").to_numpy()
        row, ids, score = best(_vectors(left, dim), q_ids, _vectors(right, dim), right.column("id").to_numpy(), k)
        return pa.Table.from_arrays([pa.array(v, pa.int64()) for v in (q_ids[row], *(np.full(len(row), c) for c in (dim, cell, qb)), ids, score)], schema=schema)

    unit = ("dim", "cell", "qb", "db")
    return queries.groupBy(*unit).cogroup(data.groupBy(*unit)).applyInArrow(run, ", ".join(f"{f.name} bigint" for f in schema))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k other rows with highest scores.

    Vectors are floor(scale * x) of their components, scores inner products; ties go to the lesser id. Rows without id,
    null vectors and vectors with null or non-finite components take no part; vectors of different lengths don't meet,
    empty ones score 0 with each other. Components of 2**62 or more and scores over 64 bits are an error. Rows that share a query's id are its own; repeated other rows count each, and
    repeated query rows once. An empty table gives no rows; other columns are not read.
    """
    rows = quantized(vectors, scale, id_col, vec_col)
    pivots = _pivots(rows, every)
    placed = cut(_packed(_cells(rows, pivots)), "knn-cells")
    queries = cut(placed.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"]), "knn-queries")

    counted = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()  # a row for each cell, and one for each odd length
    asked = {(r.dim, r.cell): r for r in queries.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("size").alias("longest")).collect()}
    blocks = {}
    for r in counted:
        blocks[r.dim] = blocks.get(r.dim, 0) + r.n
    blocks = {dim: -(-n // DATA_BLOCK) for dim, n in blocks.items()}
    query_blocks = {c: -(-r.n // QUERY_BLOCK) for c, r in asked.items()}
    own_blocks = {(r.dim, r.cell): -(-r.n // DATA_BLOCK) for r in counted}

    spark = vectors.sparkSession
    plan = spark.createDataFrame([(*c, query_blocks.get(c, 0), own_blocks[c], blocks[c[0]]) for c in own_blocks], "_dim bigint, _cell bigint, qbs bigint, own bigint, dbs bigint")
    here = (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    blocked = cut(queries.join(F.broadcast(plan), here).withColumn("qb", salt("qbs")), "knn-query-blocks")

    # a block of its own cell gives each query a first k-th best score
    near = placed.join(F.broadcast(plan), here).filter((F.col("qbs") > 0) & (salt("own") == 0)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qbs") - 1)))
    zero = F.lit(0).cast("bigint").alias("db")
    first = _solve(blocked.select("id", "dim", "cell", "qb", zero, "v"), near.select("id", "dim", "cell", "qb", zero, "v"), k)
    kth = first.groupBy("query_id", "dim", "cell").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    least = {(r.dim, r.cell): r for r in kth.groupBy("dim", "cell").agg(F.count("*").alias("queries"), F.min("n").alias("n"), F.min("kth").alias("kth")).collect()}
    bound = {c: float(least[c].kth) if c in least and least[c].n >= k and least[c].queries == asked[c].n else -np.inf for c in asked}

    lengths = (pivots * pivots).sum(1) if len(pivots) else np.zeros(1)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for each block of queries that it may matter to."""
        for batch in batches:
            for dim in sorted(set(batch.column("dim").to_pylist())):
                part = pa.Table.from_batches([batch]).filter(pa.array(batch.column("dim").to_numpy() == dim))
                x = _vectors(part, dim).astype(float)
                size = part.column("size").to_numpy()
                products = x @ pivots.T if len(pivots) and pivots.shape[1] == dim else np.zeros((len(x), 1))
                for (d, cell), r in asked.items():
                    if d != dim:
                        continue
                    product, length = (products[:, cell], lengths[cell]) if cell >= 0 else (0.0, 0.0)
                    far = np.sqrt(np.maximum(0, size**2 - 2 * product + length))
                    far = np.maximum(0, far * (1 - 1e-6) - r.radius)  # rounding of the terms must not make it larger
                    most = np.minimum(product + r.radius * size, (r.longest**2 + size**2 - far**2) / 2)
                    some = part.filter(pa.array(most * (1 + 1e-9) + 1e-3 + 1e-9 * np.abs(most) >= bound[d, cell]))
                    for qb in range(query_blocks[d, cell] if some.num_rows else 0):
                        cols = [some.column("id"), some.column("dim"), *(pa.array(np.full(some.num_rows, v, np.int64)) for v in (cell, qb)), some.column("v")]
                        yield from pa.Table.from_arrays(cols, names=["id", "dim", "cell", "qb", "v"]).to_batches()

    moved = placed.select("id", "dim", "size", "v").mapInArrow(reach, "id bigint, dim bigint, cell bigint, qb bigint, v binary")
    spread = spark.createDataFrame(list(blocks.items()), "_dim bigint, dbs bigint")
    moved = moved.join(F.broadcast(spread), F.col("dim") == F.col("_dim")).select("id", "dim", "cell", "qb", salt("dbs").alias("db"), "v")
    spread_queries = blocked.select("id", "dim", "cell", "qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("dbs") - 1)).alias("db"), "v")
    found = _solve(spread_queries, moved, k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings
where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""
