"""Retrieval quality over families: hit@k and recall@k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def quality(results: DataFrame, families: DataFrame, cuts=CUTS, asked: DataFrame | None = None) -> DataFrame:
    """One row: n, hit@k as hit_k and recall@k as recall_k. results: query_id, image_id, rank; families: image_id, family.

    A query's own image is left out and what ranks after it moves up. Recall is over the family's other members, one at
    least. asked has the query_id of every query, those in results if it isn't given; one without hits counts as a miss.
    Queries whose family isn't known don't count.
    """
    asked = (results if asked is None else asked).select(F.col("query_id").alias("_asked")).distinct()
    own = families.select(F.col("image_id").alias("_q"), F.col("family").alias("_qf"))
    other = families.select(F.col("image_id").alias("_i"), F.col("family").alias("_if"))
    sizes = families.groupBy(F.col("family").alias("_f")).agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    wanted = asked.join(own, F.col("_asked") == F.col("_q")).join(sizes, F.col("_qf") == F.col("_f"))
    rows = results.filter(F.col("query_id") != F.col("image_id")).withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "image_id"))).filter(F.col("at") <= max(cuts))
    rows = rows.select("query_id", "image_id", "at").join(other, F.col("image_id") == F.col("_i"))
    rows = wanted.join(rows, F.col("_asked") == F.col("query_id"), "left").withColumn("same", F.coalesce(F.col("_qf") == F.col("_if"), F.lit(False)).cast("int"))
    each = rows.groupBy("_asked", "others").agg(*(F.coalesce(F.sum(F.when(F.col("at") <= k, F.col("same"))), F.lit(0)).alias(f"s{k}") for k in cuts))
    return each.agg(F.count("*").alias("n"), *(F.avg((F.col(f"s{k}") > 0).cast("double")).alias(f"hit_{k}") for k in cuts), *(F.avg(F.col(f"s{k}") / F.col("others")).alias(f"recall_{k}") for k in cuts))
