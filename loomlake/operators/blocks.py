"""A stated set of queries against all rows, as an equi-join of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a block, which is broadcast if it is the only one.
QUERY_BLOCK = 2048
#: Parts that rows are dealt into if there are several blocks of queries.
ROW_PARTS = 64


def in_blocks(queries: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """Each row beside each query, all columns of both; their names must differ.

    Up to QUERY_BLOCK queries, which are counted, are broadcast and rows are not moved. More are dealt into blocks of about
    as many, each of which meets ROW_PARTS parts of the rows in a task of its own.
    """
    blocks = -(-queries.limit(QUERY_BLOCK + 1).count() // QUERY_BLOCK)
    if blocks <= 1:
        return rows.withColumn("_b", F.lit(0)).join(F.broadcast(queries.withColumn("_qb", F.lit(0))), F.col("_b") == F.col("_qb")).drop("_b", "_qb")
    blocks = -(-queries.count() // QUERY_BLOCK)
    dealt = queries.withColumn("_qb", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))).withColumn("_qp", F.explode(F.sequence(F.lit(0), F.lit(ROW_PARTS - 1))))
    parted = rows.withColumn("_p", F.pmod(F.xxhash64(row_id), F.lit(ROW_PARTS))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return parted.join(dealt, (F.col("_b") == F.col("_qb")) & (F.col("_p") == F.col("_qp"))).drop("_b", "_p", "_qb", "_qp")
