"""Mixture-controlled packing: deficit round-robin over source queues, in fixed windows without padding.

Documents are dealt by hash into shards of about SHARD_TOKENS tokens, so a source that holds a third of all rows is
spread over all shards. A shard has one queue for each source. The source that lags furthest behind its target share is
served next, up to its deficit (QUANTUM at least), and deficits carry on from window to window. A shard emits all that
it holds, so what each source lags by at its end follows from counts alone; prefix sums over those counts start the next
shard where this one ends. The rest after a shard's last full window goes into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import pieces
from .util import byte_slices, cut, give_back

SHARD_TOKENS = 1 << 18
QUANTUM = 256
SLICE_BYTES = 8 << 20
#: Shards whose counts are summed up in one go; sums of such blocks are summed up after that.
BLOCK = 1024

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, n, ids: each whole text's ids and end_id, as unsigned 32-bit little-endian numbers (16-bit while they fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = pieces(tokenizer, lengths_only=False), np.array([end_id], "<u4")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                found, at = encoder.ids(batch.column("text").to_pylist())
                ids = [np.concatenate((found[a:b], end)) for a, b in zip(at[:-1], at[1:])]
                kept = [(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "source", "n", "ids"])
                del found, at, ids, kept
        give_back()

    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, source string, n bigint, ids binary")


def _before(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows with the sum of value over smaller shards with the same keys; in two levels, so that no key needs one task."""
    block = F.floor(F.col("shard") / BLOCK)
    inner = Window.partitionBy(*keys, "block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", block)
    blocks = rows.groupBy(*keys, "block").agg(F.sum(value).alias("block_sum"))
    blocks = blocks.withColumn("earlier", F.coalesce(F.sum("block_sum").over(outer), F.lit(0))).drop("block_sum")
    for k in keys:
        blocks = blocks.withColumnRenamed(k, f"_{k}")
    same: Column = F.col("block") == F.col("_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(blocks.withColumnRenamed("block", "_block"), same)
    return joined.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col("earlier")).drop("block", "_block", "earlier", *(f"_{k}" for k in keys))


def lags(counts: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """shard, source, target, lag: by how many tokens the source is behind its target share when the shard begins.

    counts: shard, source, n. Without targets, a source's target is its share of all tokens.
    """
    spark = counts.sparkSession
    if targets is None:
        total = counts.agg(F.sum("n")).first()[0] or 1
        shares = counts.groupBy(F.col("source").alias("_source")).agg((F.sum("n") / F.lit(total)).alias("target"))
    else:
        total = sum(targets.values())
        shares = spark.createDataFrame([(k, v / total) for k, v in targets.items()], "_source string, target double")
    whole = _before(counts.groupBy("shard").agg(F.sum("n").alias("shard_n")), [], "shard_n", "all_before").withColumnRenamed("shard", "_shard")
    own = _before(counts, ["source"], "n", "own_before")
    own = own.join(shares, F.col("source").eqNullSafe(F.col("_source")), "left").join(whole, F.col("shard") == F.col("_shard"))
    target = F.coalesce("target", F.lit(0.0))
    return own.select("shard", "source", target.alias("target"), (target * F.col("all_before") - F.col("own_before")).alias("lag"))


def round_robin(queues: list[list[tuple[int, int]]], targets: np.ndarray, lag: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; queues hold (document, tokens) for each source."""
    left = sum(n for q in queues for _, n in q)
    lag, open_ = lag.astype(float), np.array([bool(q) for q in queues])
    heads, starts, sequence = [0] * len(queues), [0] * len(queues), 0
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        offset = 0
        while offset < room:
            s = int(np.argmax(np.where(open_, lag, -np.inf)))
            doc, tokens = queues[s][heads[s]]
            length = min(tokens - starts[s], room - offset, max(QUANTUM, int(lag[s])))
            yield doc, starts[s], length, sequence, offset
            lag += targets * length
            lag[s] -= length
            offset += length
            starts[s] += length
            if starts[s] == tokens:
                heads[s], starts[s] = heads[s] + 1, 0
                open_[s] = heads[s] < len(queues[s])
        left -= room
        sequence += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document is its text's ids and then end_id, so a null or empty text has one token. Each id lies in exactly one
    piece; a sequence has window tokens, or a smaller power of two at the end of a shard, and no padding. Sources are
    served by target share (tokens' own shares by default; a source without a target comes when others have run out);
    null is a source like others. Repeated rows are packed once each, null ids too. An empty table gives no rows; other
    columns are not read. window must be a power of two.
    """
    spark = docs.sparkSession
    rows = cut(token_ids(docs, tokenizer, end_id, id_col, text_col, source_col), "packing-ids")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).alias("shard")
    rows = rows.select(shard, "doc_id", "source", "n", "ids")
    begin = cut(lags(cut(rows.groupBy("shard", "source").agg(F.sum("n").alias("n")), "packing-counts"), targets), "packing-lags")

    def run(key: tuple, held: pa.Table, lag: pa.Table) -> pa.Table:
        lag_of = {s: (t, x) for s, t, x in zip(*(lag.column(c).to_pylist() for c in ("source", "target", "lag")))}
        ids = [x.as_py() for x in held.column("ids")]
        names, docs_of, n = (held.column(c).to_pylist() for c in ("source", "doc_id", "n"))
        order = sorted(range(len(ids)), key=lambda i: (docs_of[i] is None, docs_of[i], ids[i]))
        sources = sorted(lag_of, key=lambda s: (s is None, s or ""))
        at = {s: k for k, s in enumerate(sources)}
        queues: list[list[tuple[int, int]]] = [[] for _ in sources]
        for i in order:
            queues[at[names[i]]].append((i, n[i]))
        target, late = (np.array([lag_of[s][k] for s in sources], float) for k in (0, 1))
        out: list[tuple] = []
        wide: dict[int, bytes] = {}
        for i, start, length, sequence, offset in round_robin(queues, target, late, window):
            if i not in wide:
                wide[i] = np.frombuffer(ids[i], "<u2" if len(ids[i]) == 2 * n[i] else "<u4").astype("<u4").tobytes()
            crc = zlib.crc32(wide[i][4 * start : 4 * (start + length)])
            if start + length == n[i]:
                del wide[i]
            out.append((docs_of[i], start, length, crc, n[i], (key[0].as_py() << 31) + sequence, offset, names[i]))
        schema = pa.schema([held.schema.field("doc_id"), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("source", pa.string())])
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.groupBy("shard").cogroup(begin.groupBy("shard")).applyInArrow(run, f"doc_id {kind}, {PIECES}, source string")
