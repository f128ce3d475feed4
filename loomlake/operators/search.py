"""Searches of an indexed library: by hash, by vector, or by both, then colour, duplicates, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import blend, cosine_score, hamming, histogram_similarity
from .hamming import DEFAULT_DISTANCE, DUPLICATE_DISTANCE, nearest_by_hash
from .vectors import nearest_by_cosine

RERANK = 200
ALPHA = 0.2
#: Hits that a hybrid search takes from hashes, for k results.
HYBRID_LEAST, HYBRID_TIMES = 200, 5


def by_hash(queries: DataFrame, images: DataFrame, k: int, distance: int | None = DEFAULT_DISTANCE) -> DataFrame:
    """query_id, image_id, pattern_score. queries: query_id, variant, qh; images: image_id, h."""
    return nearest_by_hash(queries, images, k, distance).drop("dist")


def by_vector(queries: DataFrame, vectors: DataFrame, k: int, candidates: int = RERANK) -> DataFrame:
    """query_id, image_id, pattern_score. queries: query_id, variant, vec; vectors: image_id, vec."""
    near = nearest_by_cosine(queries, vectors, max(candidates, k))
    return near.groupBy("query_id", "image_id").agg(F.max(cosine_score(F.col("cosine"))).alias("pattern_score"))


def by_both(queries: DataFrame, images: DataFrame, vectors: DataFrame, k: int, distance: int | None = DEFAULT_DISTANCE) -> DataFrame:
    """Hash candidates with their best variant's cosine score; one without a vector keeps its hash score.

    queries: query_id, variant, qh, vec.
    """
    wide = max(HYBRID_TIMES * k, HYBRID_LEAST)
    hits = by_hash(queries, images, wide, distance)
    top = Window.partitionBy("query_id").orderBy(F.desc("pattern_score"), "image_id")
    hits = hits.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= wide).drop("_n")
    from ..functions.pixels import dot, norm

    held = vectors.select(F.col("image_id").alias("_image"), F.col("vec").cast("array<double>").alias("_v"))
    asked = queries.select(F.col("query_id").alias("_query"), F.col("vec").cast("array<double>").alias("_q"))
    scored = hits.join(held, F.col("image_id") == F.col("_image")).join(asked, F.col("query_id") == F.col("_query"))
    cosine = dot(F.col("_q"), F.col("_v")) / (norm(F.col("_q")) * norm(F.col("_v")) + 1e-9)
    best = scored.groupBy(F.col("query_id").alias("_query"), F.col("image_id").alias("_image")).agg(F.max(cosine_score(cosine)).alias("_score"))
    both = hits.join(best, (F.col("query_id") == F.col("_query")) & (F.col("image_id") == F.col("_image")), "left")
    return both.select("query_id", "image_id", F.coalesce("_score", "pattern_score").alias("pattern_score"))


def least_hamming(hits: DataFrame, images: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, image_id, hamming: the least distance of a query's variants' hashes from a hit's, whatever ranked it."""
    own = images.select(F.col("image_id").alias("_image"), F.col("phash").alias("_h"))
    asked = queries.groupBy(F.col("query_id").alias("_query")).agg(F.collect_list("qph").alias("_q"))  # eight each
    both = hits.select("query_id", "image_id").join(own, F.col("image_id") == F.col("_image")).join(asked, F.col("query_id") == F.col("_query"))
    return both.select("query_id", "image_id", F.array_min(F.transform("_q", lambda q: hamming(q, F.col("_h")))).alias("hamming"))


def finalize(hits: DataFrame, images: DataFrame, queries: DataFrame, k: int, alpha: float = ALPHA, duplicate: int = DUPLICATE_DISTANCE, threshold: float = 0.0) -> DataFrame:
    """The k best of each query with scores, flags and ranks; ties go to the lesser image_id.

    hits: query_id, image_id, pattern_score; images: image_id, path, thumb, status, color, phash, width, height;
    queries: query_id, variant, color, qph (variant 0 has the colour). Only ok images stay; a missing colour counts as 0.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    own = images.filter(F.col("status") == "ok").select(F.col("image_id").alias("_image"), "path", F.col("thumb").alias("thumb_path"), F.col("color").cast("array<double>").alias("_color"), "width", "height")
    asked = queries.filter(F.col("variant") == 0).select(F.col("query_id").alias("_query"), F.col("color").cast("array<double>").alias("_qcolor"))
    rows = hits.join(own, F.col("image_id") == F.col("_image")).join(asked, F.col("query_id") == F.col("_query"))
    rows = rows.withColumn("color_sim", histogram_similarity(F.col("_qcolor"), F.col("_color")))
    rows = rows.withColumn("score", blend(F.col("pattern_score"), F.col("color_sim"), alpha)).drop("_image", "_query", "_color", "_qcolor")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "image_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    near = least_hamming(rows, images, queries).withColumnRenamed("query_id", "_query").withColumnRenamed("image_id", "_image")
    rows = rows.join(near, (F.col("query_id") == F.col("_query")) & (F.col("image_id") == F.col("_image")), "left")
    flags = (F.coalesce(F.col("hamming") <= duplicate, F.lit(False)).alias("is_duplicate"), "width", "height", (F.col("score") < threshold).alias("below_threshold"))
    return rows.select("query_id", "rank", "image_id", "path", "thumb_path", "score", "pattern_score", "color_sim", "hamming", *flags)
