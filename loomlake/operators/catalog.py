"""Catalog maintenance: scans against the catalog, partial upserts, status marks, cascading deletes, counts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, MISSING, ERROR = "ok", "missing", "error"
#: Seconds by which a file's time may differ without a change.
TOLERANCE = 2.0

IMAGES = (
    "id bigint, path string, key string, mtime double, size bigint, width int, height int, phash array<bigint>, dhash array<bigint>, ahash array<bigint>, "
    "whash array<bigint>, color array<float>, thumb string, status string, error string, indexed_at timestamp"
)
VECTORS = "image_id bigint, vec array<float>, embedder string, dim int"
SETTINGS = "ns string, key string, value string"


def is_changed(size: Column, old_size: Column, mtime: Column, old_mtime: Column) -> Column:
    return (size != old_size) | (F.abs(mtime - old_mtime) > TOLERANCE)


def first_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def diff(scan: DataFrame, catalog: DataFrame, retry: bool = False) -> DataFrame:
    """key and change: new, changed, missing or unchanged. scan and catalog: key, mtime, size.

    With retry the catalog's status counts too: a seen key that isn't ok is changed.
    """
    old = catalog.select(F.col("key").alias("_key"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), *([F.col("status").alias("_status")] if retry else []))
    both = scan.select("key", "mtime", "size").join(old, F.col("key") == F.col("_key"), "full_outer")
    changed = is_changed(F.col("size"), F.col("_size"), F.col("mtime"), F.col("_mtime"))
    if retry:
        changed = changed | (F.col("_status") != OK)
    change = F.when(F.col("_key").isNull(), "new").when(F.col("key").isNull(), "missing").when(changed, "changed").otherwise("unchanged")
    return both.select(F.coalesce("key", "_key").alias("key"), change.alias("change"))


def diff_counts(changes: DataFrame) -> DataFrame:
    kinds = ("new", "changed", "missing", "unchanged")
    return changes.agg(*(F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds))


def to_process(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change").isin("new", "changed")).select("key")


def missing_keys(scan: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.select("key").join(scan.select("key"), "key", "left_anti")


def with_queue(queue: DataFrame, lacking: DataFrame) -> DataFrame:
    """queue and those keys of lacking that it doesn't hold."""
    return queue.select("key").unionByName(lacking.select("key").join(queue.select("key"), "key", "left_anti"))


def last_of(rows: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """One row for each key, without order_col: the last by it (null first); of equal ones, or without it, the one whose other columns are greatest."""
    others = [c for c in rows.columns if c not in keys and c != order_col]
    if not others:
        return rows.select(*keys).distinct()
    ahead = [F.col(order_col).alias("_order")] if order_col else []
    return rows.groupBy(*keys).agg(F.max(F.struct(*ahead, *others)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in others))


def upsert(catalog: DataFrame, rows: DataFrame, key: str = "key", order_col: str | None = None) -> DataFrame:
    """catalog with rows merged by key: columns that rows have are overwritten, others kept; a new key's others are null.

    Of rows with one key the last by order_col counts, as last_of says. Rows without a key are left out.
    """
    rows = last_of(rows.filter(F.col(key).isNotNull()), [key], order_col)
    given = [c for c in rows.columns if c != key]
    new = rows.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in given), F.lit(True).alias("_given"))
    both = catalog.join(new, F.col(key) == F.col("_key"), "full_outer")
    pick = lambda c: F.coalesce(key, "_key") if c == key else F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(catalog.schema[c].dataType) if c in given else F.col(c)
    return both.select(*(pick(c).alias(c) for c in catalog.columns))


def with_ids(catalog: DataFrame, id_col: str = "id", key: str = "key", parts: int = 1024) -> DataFrame:
    """catalog with ids for rows that lack one, above the highest, without gaps; numbered within parts, so no task sees all."""
    top = catalog.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    lacking = catalog.filter(F.col(id_col).isNull()).withColumn("_part", part)
    sizes = lacking.groupBy("_part").count().withColumnRenamed("_part", "_p")
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # parts rows at most
    numbered = lacking.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(id_col, F.lit(top) + F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    return catalog.filter(F.col(id_col).isNotNull()).unionByName(numbered.select(*catalog.columns))


def upsert_vectors(vectors: DataFrame, rows: DataFrame, order_col: str | None = None) -> DataFrame:
    """vectors with rows put in by image_id; of repeated ids in rows the last by order_col stays."""
    rows = last_of(rows, ["image_id"], order_col)
    return vectors.join(rows.select("image_id"), "image_id", "left_anti").select(*vectors.columns).unionByName(rows.select(*vectors.columns))


def upsert_settings(settings: DataFrame, rows: DataFrame, order_col: str | None = None) -> DataFrame:
    """settings with rows put in by ns and key; of repeated ones in rows the last by order_col stays."""
    rows = last_of(rows, ["ns", "key"], order_col)
    return settings.join(rows.select("ns", "key"), ["ns", "key"], "left_anti").select(*settings.columns).unionByName(rows.select(*settings.columns))


def setting_row(spark, ns: str, key: str, value) -> DataFrame:
    """A row of settings; any value that JSON can hold is written as JSON."""
    return spark.createDataFrame([(ns, key, json.dumps(value, sort_keys=True, ensure_ascii=False))], SETTINGS)


def setting(settings: DataFrame, ns: str, key: str, default: str | None = None) -> str | None:
    row = settings.filter((F.col("ns") == ns) & (F.col("key") == key)).select("value").first()
    return default if row is None else row[0]


def json_setting(settings: DataFrame, ns: str, key: str, default=None):
    """The value that setting_row wrote; the default if there is none, or it isn't JSON."""
    held = setting(settings, ns, key)
    try:
        return default if held is None else json.loads(held)
    except ValueError:
        return default


def mark_status(catalog: DataFrame, keys: DataFrame, status: str, error: str | None = None) -> DataFrame:
    """Rows of keys get the status and the error, which is null if none is given; other keys are left alone."""
    marked = catalog.join(keys.select(F.col("key").alias("_key")).distinct(), F.col("key") == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    put = {"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "error": F.when(hit, F.lit(error).cast("string")).otherwise(F.col("error"))}
    return marked.select(*(put[c].alias(c) if c in put else F.col(c) for c in catalog.columns))


def delete_keys(catalog: DataFrame, vectors: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys' rows."""
    gone = catalog.join(keys.select("key"), "key", "left_semi").select(F.col("id").alias("image_id"))
    return catalog.join(keys.select("key"), "key", "left_anti").select(*catalog.columns), vectors.join(gone, "image_id", "left_anti").select(*vectors.columns)


def keys_missing_vectors(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ok rows without a vector."""
    return catalog.filter(F.col("status") == OK).join(vectors.select(F.col("image_id").alias("id")), "id", "left_anti")


def vectors_of_ok(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    return vectors.join(catalog.filter(F.col("status") == OK).select(F.col("id").alias("image_id")), "image_id", "left_semi").orderBy("image_id")


def stats(catalog: DataFrame, status: str = "status") -> DataFrame:
    """One row: total and the number of each status."""
    return catalog.agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in (OK, MISSING, ERROR)))


def records(catalog: DataFrame, only_ok: bool = True) -> DataFrame:
    return (catalog.filter(F.col("status") == OK) if only_ok else catalog).orderBy("id")


def point(catalog: DataFrame, **by) -> DataFrame:
    """No row or one, by key=... or id=...."""
    return catalog.filter(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in by.items()))).limit(1)
