"""Connected components of a table of links: in one task while they are counted to be few, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import by_key, cut


#: Links, of sixteen bytes each, up to which one task joins them up.
FEW_LINKS = 1_000_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links u, v and the least node that it reaches, by hooking roots onto lesser ones and halving paths."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[top]
        np.minimum.at(top, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (top[top] != top).any():
            top = top[top]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        node, component = least_reached(*(np.concatenate(x) for x in zip(*held)))
        own = node != component
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(component[own])], names=["node", "component"])


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v, m of pairs u, v: m is the least of u and of all v beside it."""
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    return pairs.join(by_key(least), F.col("u") == F.col("_u")).select("u", "v", F.least("u", "m").alias("m"))


def _stars(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = _with_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that each node with a link (u, v) reaches. Written tables; links may repeat."""
    now = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    if now.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return cut(now.coalesce(1).mapInArrow(_in_one_task, "node bigint, component bigint"), "few-components")
    seen = None
    while True:
        # every link leads to a smaller node; the sum and the count stand still only when each leads to its component
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, now = state, cut(_stars(now), "stars")
