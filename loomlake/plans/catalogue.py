"""Registered queries of the similarity library, each with the SQL that gives the same rows.

A 64-number embedding serves as an 8 x 8 grey grid, its label as the image's family, its absolute values as a colour
histogram. Snapshots of orders serve as folder scans: the price in cents is a file's size, the date its time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import pixels as X
from ..operators import catalog as C
from ..operators import evaluate as E
from ..operators import hamming as H
from ..operators import search as S
from ..operators import vectors as V
from ..operators.blocks import in_blocks
from ..streaming import watch as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DISTANCE, K = 22, 10


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("px"))


def hashed(spark: SparkSession, sf_dir: str, algorithm: str = "ahash") -> DataFrame:
    return grids(spark, sf_dir).withColumn("h", X.pack(X.hash_bits(F.col("px"), algorithm)))


#: Searches ask with every row whose id this divides.
EVERY = 100
ASKED = f"vec_id % {EVERY} = 0"


def asked(spark: SparkSession, sf_dir: str, tta: bool = True) -> DataFrame:
    """query_id, variant, px, qh of the queries' variants."""
    rows = grids(spark, sf_dir).filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), "px")
    rows = H.expand_variants(rows) if tta else rows.withColumn("variant", F.lit(0))
    return rows.withColumn("qh", X.pack(X.ahash_bits(F.col("px"))))


# SQL that several oracles share
GRIDS = "e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as px from embeddings)"
AHASH = "list_transform(px, lambda x: (x > list_sum(px) / 64)::int)"
HASHED = f"{GRIDS}, b as (select *, {AHASH} as bits from e)"
TURNS = ", ".join(f"({i}, {[p + 1 for p in places]})" for i, places in enumerate(X.variant_places()))
VARIANTS = f"t as (select * from (values {TURNS}) as t(variant, places)), v as (select vec_id as query_id, variant, list_transform(places, lambda i: px[i]) as px from e, t)"
DIST = "list_sum(list_transform(range(1, 65), lambda i: (a.bits[i] <> b.bits[i])::int))::int"
DOT = "list_sum(list_transform(range(1, 65), lambda i: a.px[i] * b.px[i]))"
NORM = "sqrt(list_sum(list_transform({0}.px, lambda x: x * x)))"
COSINE = f"{DOT} / ({NORM.format('a')} * {NORM.format('b')})"
HIST = "list_transform(px, lambda x: abs(x) / list_sum(list_transform(px, lambda y: abs(y))))"
COMMON = "list_sum(list_transform(range(1, 65), lambda i: least(a.hist[i], b.hist[i])))"
MEDIAN = "(list_sort({0})[len({0}) // 2] + list_sort({0})[len({0}) // 2 + 1]) / 2"
NEAR = f"""{HASHED}, {VARIANTS}, q as (select *, {AHASH} as bits from v where query_id % {EVERY} = 0),
n as (select a.query_id, a.variant, b.vec_id as image_id, {DIST} as dist from q a, b)"""


@query("q01_cosine_topk", f"with {GRIDS}, s as (select a.vec_id as query_id, b.vec_id as image_id, {COSINE} as c from e a, e b where a.{ASKED}), r as (select *, row_number() over (partition by query_id order by round(c, 12) desc, image_id)::int as rank from s) select query_id, image_id, rank, round((c + 1) / 2, 6) as score from r where rank <= {K}")
def cosine_topk(spark, sf_dir):
    wanted = asked(spark, sf_dir, tta=False).withColumnRenamed("px", "vec")
    near = V.nearest_by_cosine(wanted, grids(spark, sf_dir).withColumnRenamed("px", "vec"), K)
    return near.select("query_id", "image_id", "rank", F.round(X.cosine_score(F.col("cosine")), 6).alias("score"))


@query("q01b_cosine_topk_all", f"with {GRIDS}, s as (select a.vec_id as query_id, b.vec_id as image_id, {COSINE} as c from e a, e b), r as (select *, row_number() over (partition by query_id order by round(c, 12) desc, image_id)::int as rank from s) select query_id, image_id, rank, round((c + 1) / 2, 6) as score from r where rank <= 3")
def cosine_topk_all(spark, sf_dir):
    """Every vector asks."""
    rows = grids(spark, sf_dir).withColumnRenamed("px", "vec")
    near = V.nearest_by_cosine(rows.select(F.col("image_id").alias("query_id"), F.lit(0).alias("variant"), "vec"), rows, 3)
    return near.select("query_id", "image_id", "rank", F.round(X.cosine_score(F.col("cosine")), 6).alias("score"))


@query("q02_cosine_topk_tta", f"""with {GRIDS}, {VARIANTS}, s as (select a.query_id, a.variant, b.vec_id as image_id, {COSINE} as c from v a, e b where a.query_id % {EVERY} = 0),
r as (select *, row_number() over (partition by query_id, variant order by round(c, 12) desc, image_id) as n from s)
select query_id, image_id, round(max((c + 1) / 2), 6) as score from r where n <= 200 group by query_id, image_id""")
def cosine_topk_tta(spark, sf_dir):
    wanted = asked(spark, sf_dir).withColumnRenamed("px", "vec")
    return S.by_vector(wanted, grids(spark, sf_dir).withColumnRenamed("px", "vec"), K).select("query_id", "image_id", F.round("pattern_score", 6).alias("score"))


def _bits(algorithm: str):
    def run(spark, sf_dir):
        return grids(spark, sf_dir).select("image_id", X.bit_string(X.hash_bits(F.col("px"), algorithm)).alias("bits"))

    return run


DBITS = "list_transform(list_filter(range(1, 65), lambda i: i % 8 <> 0), lambda i: (px[i + 1] > px[i])::int)"
WEIGHTS = json.dumps(X.cosine_weights(8, 8))
FREQ = f"f as (select vec_id, list_transform({WEIGHTS}::double[][], lambda w: round(list_sum(list_transform(range(1, 65), lambda i: w[i] * px[i])), 9)) as f from e)"
MEANS = "m as (select vec_id, list_transform([1, 3, 5, 7, 17, 19, 21, 23, 33, 35, 37, 39, 49, 51, 53, 55], lambda i: (px[i] + px[i + 1] + px[i + 8] + px[i + 9]) / 4) as m from e)"
query("q03_ahash_bits", f"with {HASHED} select vec_id as image_id, array_to_string(bits, '') as bits from b")(_bits("ahash"))
query("q04_dhash_bits", f"with {GRIDS} select vec_id as image_id, array_to_string({DBITS}, '') as bits from e")(_bits("dhash"))
query("q05_phash_bits", f"with {GRIDS}, {FREQ}, g as (select *, {MEDIAN.format('f')} as d from f) select vec_id as image_id, array_to_string(list_transform(f, lambda x: (x > d)::int), '') as bits from g")(_bits("phash"))
query("q06_whash_bits", f"with {GRIDS}, {MEANS}, g as (select *, {MEDIAN.format('m')} as d from m) select vec_id as image_id, array_to_string(list_transform(m, lambda x: (x > d)::int), '') as bits from g")(_bits("whash"))


@query("q06b_pixel_statistics", f"with {GRIDS} select vec_id as image_id, round(list_sum(px) / 64, 9) as mean, round({MEDIAN.format('px')}, 9) as median, round(sqrt(list_sum(list_transform(px, lambda x: x * x))), 9) as norm, len(list_filter(px, lambda x: x > {MEDIAN.format('px')}))::int as ones from e")
def pixel_statistics(spark, sf_dir):
    px = F.col("px")
    ones = F.aggregate(X.above(px, X.median(px)), F.lit(0), lambda a, x: a + x)
    return grids(spark, sf_dir).select("image_id", F.round(X.total(px) / F.size(px), 9).alias("mean"), F.round(X.median(px), 9).alias("median"), F.round(X.norm(px), 9).alias("norm"), ones.alias("ones"))


@query("q07_hamming_topk", f"with {HASHED}, s as (select a.vec_id as query_id, b.vec_id as image_id, {DIST} as dist from b a, b where a.{ASKED}), r as (select *, row_number() over (partition by query_id order by dist, image_id)::int as rank from s) select *, 1 - dist / 64 as similarity from r where rank <= {K}")
def hamming_topk(spark, sf_dir):
    near = H.hamming_join(asked(spark, sf_dir, tta=False).select("query_id", "qh"), hashed(spark, sf_dir).select("image_id", "h"), None)
    from pyspark.sql import Window

    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "image_id"))).filter(F.col("rank") <= K)
    return ranked.select("query_id", "image_id", "dist", "rank", X.hamming_score(F.col("dist")).alias("similarity"))


@query("q08_hamming_range_tta", f"with {NEAR} select query_id, image_id, min(dist) as dist, max(1 - dist / 64) as similarity from n where dist <= {DISTANCE} group by query_id, image_id")
def hamming_range_tta(spark, sf_dir):
    near = H.hamming_join(asked(spark, sf_dir).select("query_id", "variant", "qh"), hashed(spark, sf_dir).select("image_id", "h"), DISTANCE)
    return near.groupBy("query_id", "image_id").agg(F.min("dist").alias("dist"), F.max(X.hamming_score(F.col("dist"))).alias("similarity"))


@query("q09_hamming_selfjoin_banded", f"with {HASHED} select a.vec_id as a, b.vec_id as b, {DIST} as dist from b a join b on a.vec_id < b.vec_id where {DIST} <= 17")
def hamming_selfjoin(spark, sf_dir):
    return H.self_join(hashed(spark, sf_dir), 17)


PLANTED = 12
FLIPS = f"p as (select vec_id, bits from b union all select vec_id + 1000000, list_transform(range(1, 65), lambda i: case when i <= vec_id % 16 then 1 - bits[i] else bits[i] end) from b)"


@query("q09b_hamming_selfjoin_copies", f"with {HASHED}, {FLIPS} select a.vec_id as a, b.vec_id as b, {DIST} as dist from p a join p b on a.vec_id < b.vec_id where {DIST} <= {PLANTED}")
def hamming_selfjoin_copies(spark, sf_dir):
    """Every image, and a copy of it with up to fifteen bits changed."""
    rows = grids(spark, sf_dir).select("image_id", X.ahash_bits(F.col("px")).alias("bits"))
    flipped = F.transform("bits", lambda x, i: F.when(i < F.col("image_id") % 16, 1 - x).otherwise(x))
    both = rows.unionByName(rows.select((F.col("image_id") + 1000000).alias("image_id"), flipped.alias("bits")))
    return H.self_join(both.select("image_id", X.pack(F.col("bits")).alias("h")), PLANTED)


@query("q10_hash_buckets", f"with {HASHED} select array_to_string(bits[1:6], '') as prefix, list(vec_id order by vec_id) as ids from b group by 1")
def hash_buckets(spark, sf_dir):
    rows = grids(spark, sf_dir).select("image_id", X.bit_string(F.slice(X.ahash_bits(F.col("px")), 1, 6)).alias("prefix"))
    return H.buckets(rows, "prefix")


@query("q11_tta_variants", f"with {GRIDS}, {VARIANTS}, o as (select query_id as image_id, variant, {AHASH} as bits from v) select image_id, variant, array_to_string(bits, '') as bits from o")
def tta_variants(spark, sf_dir):
    return H.expand_variants(grids(spark, sf_dir).select("image_id", "px")).select("image_id", "variant", X.bit_string(X.ahash_bits(F.col("px"))).alias("bits"))


@query("q12_hist_intersection", f"with {GRIDS}, h as (select vec_id, {HIST} as hist from e) select a.vec_id as query_id, b.vec_id as image_id, round({COMMON}, 6) as similarity from h a, h b where a.{ASKED}")
def hist_intersection(spark, sf_dir):
    rows = grids(spark, sf_dir).select("image_id", X.share_histogram(F.col("px")).alias("hist"))
    wanted = rows.filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), F.col("hist").alias("own"))
    return in_blocks(wanted, rows, "image_id").select("query_id", "image_id", F.round(X.histogram_similarity(F.col("own"), F.col("hist")), 6).alias("similarity"))


@query("q13_l2_normalize", f"with {GRIDS}, n as (select vec_id, list_transform(px, lambda x: x * (1 + vec_id % 3)) as px from e) select vec_id as image_id, round(px[1] / {NORM.format('n')}, 6) as first, round(px[64] / {NORM.format('n')}, 6) as last from n")
def l2_normalize(spark, sf_dir):
    scaled = grids(spark, sf_dir).select("image_id", F.transform("px", lambda x: x * (1 + F.col("image_id") % 3)).alias("px"))
    unit = scaled.select("image_id", X.normalized(F.col("px")).alias("u"))
    return unit.select("image_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


@query("q14_color_rerank", f"""with {GRIDS}, h as (select *, {HIST} as hist from e), s as (select a.vec_id as query_id, b.vec_id as image_id, ({COSINE} + 1) / 2 as p, {COMMON} as c from h a, h b where a.{ASKED}),
w as (select unnest([0.0, 0.2, 0.8])::double as alpha), z as (select alpha, query_id, image_id, (1 - alpha) * p + alpha * c as s from s, w),
r as (select alpha, query_id, image_id, round(s, 6) as score, row_number() over (partition by query_id, alpha order by round(s, 9) desc, image_id)::int as rank from z) select * from r where rank <= {K}""")
def color_rerank(spark, sf_dir):
    from pyspark.sql import Window

    rows = grids(spark, sf_dir).select("image_id", "px", X.share_histogram(F.col("px")).alias("hist"))
    wanted = rows.filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), F.col("px").alias("qpx"), F.col("hist").alias("qhist"))
    both = in_blocks(wanted, rows, "image_id")
    pattern = X.cosine_score(X.dot(F.col("px"), F.col("qpx")) / (X.norm(F.col("px")) * X.norm(F.col("qpx"))))
    scored = both.select("query_id", "image_id", pattern.alias("p"), X.histogram_similarity(F.col("qhist"), F.col("hist")).alias("c"))
    blended = F.array(*(F.struct(F.lit(a).alias("alpha"), X.blend(F.col("p"), F.col("c"), a).alias("s")) for a in (0.0, 0.2, 0.8)))
    each = scored.select("query_id", "image_id", F.explode(blended).alias("z")).select("query_id", "image_id", "z.alpha", "z.s")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "alpha").orderBy(F.desc(F.round("s", 9)), "image_id"))).filter(F.col("rank") <= K)
    return ranked.select("alpha", "query_id", "image_id", F.round("s", 6).alias("score"), "rank")


@query("q15_dup_badge", f"with {NEAR} select query_id, image_id, min(dist) as hamming, min(dist) <= {DISTANCE} as is_duplicate from n group by query_id, image_id")
def dup_badge(spark, sf_dir):
    images = hashed(spark, sf_dir).select("image_id", F.col("h").alias("phash"))
    wanted = asked(spark, sf_dir).select("query_id", F.col("qh").alias("qph"))
    every = in_blocks(wanted.select("query_id").distinct(), images.select("image_id"), "image_id")
    return S.least_hamming(every, images, wanted).withColumn("is_duplicate", F.col("hamming") <= DISTANCE)


@query("q16_below_threshold", f"with {GRIDS}, s as (select a.vec_id as query_id, b.vec_id as image_id, ({COSINE} + 1) / 2 as s from e a, e b where a.{ASKED}) select query_id, image_id, round(s, 6) as score, round(s, 9) < 0.5 as below_threshold from s")
def below_threshold(spark, sf_dir):
    rows = grids(spark, sf_dir).select("image_id", "px")
    wanted = rows.filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), F.col("px").alias("q"))
    score = X.cosine_score(X.dot(F.col("px"), F.col("q")) / (X.norm(F.col("px")) * X.norm(F.col("q"))))
    return in_blocks(wanted, rows, "image_id").select("query_id", "image_id", F.round(score, 6).alias("score"), (F.round(score, 9) < 0.5).alias("below_threshold"))


HYBRID = f"""{NEAR}, w as (select *, row_number() over (partition by query_id, variant order by dist, image_id) as o from n where dist <= {DISTANCE}),
p as (select query_id, image_id, max(1 - dist / 64) as hs from w where o <= 600 group by 1, 2),
k as (select *, row_number() over (partition by query_id order by hs desc, image_id) as o from p), c as (select query_id, image_id, hs from k where o <= 200),
x as (select c.query_id, c.image_id, max(({DOT} / ({NORM.format('a')} * {NORM.format('b')} + 1e-9) + 1) / 2) as vs from c join v a on a.query_id = c.query_id join e b on b.vec_id = c.image_id where c.image_id % 2 = 0 group by 1, 2),
y as (select c.query_id, c.image_id, coalesce(vs, hs) as score from c left join x on x.query_id = c.query_id and x.image_id = c.image_id)"""


def _hybrid(spark, sf_dir):
    images = hashed(spark, sf_dir)
    wanted = asked(spark, sf_dir).withColumnRenamed("px", "vec")
    held = images.filter("image_id % 2 = 0").select("image_id", F.col("px").alias("vec"))
    return S.by_both(wanted, images.select("image_id", "h"), held, K, DISTANCE)


@query("q17_hybrid_search", f"with {HYBRID} select query_id, image_id, round(score, 6) as score from y")
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "image_id", F.round("pattern_score", 6).alias("score"))


@query("q18_search_finalize", f"""with {HYBRID}, h as (select *, {HIST} as hist, 'img_' || vec_id || '.png' as path from e where label % 3 <> 0),
z as (select y.query_id, y.image_id, b.path, y.score as p, {COMMON} as c from y join h b on b.vec_id = y.image_id join (select vec_id, {HIST} as hist from e) a on a.vec_id = y.query_id),
r as (select *, 0.8 * p + 0.2 * c as s, row_number() over (partition by query_id order by round(0.8 * p + 0.2 * c, 9) desc, image_id)::int as rank from z),
d as (select query_id, image_id, min(dist) as hamming from n group by 1, 2)
select r.query_id, rank, r.image_id, path, sha1(path) || '.jpg' as thumb_path, round(s, 6) as score, round(p, 6) as pattern_score, round(c, 6) as color_sim, hamming, hamming <= 8 as is_duplicate, 8 as width, 8 as height, round(s, 9) < 0.7 as below_threshold
from r join d on d.query_id = r.query_id and d.image_id = r.image_id where rank <= {K}""")
def search_finalize(spark, sf_dir):
    path = F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".png"))
    status = F.when(F.col("label") % 3 != 0, "ok").otherwise("missing")
    images = hashed(spark, sf_dir).select("image_id", path.alias("path"), P.thumb_name(path).alias("thumb"), status.alias("status"), X.share_histogram(F.col("px")).alias("color"), F.col("h").alias("phash"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    wanted = asked(spark, sf_dir).select("query_id", "variant", F.col("qh").alias("qph"), X.share_histogram(F.col("px")).alias("color"))
    out = S.finalize(_hybrid(spark, sf_dir), images, wanted, K, threshold=0.7)
    rounded = {c: F.round(c, 6) for c in ("score", "pattern_score", "color_sim")}
    return out.withColumn("below_threshold", F.round("score", 9) < 0.7).withColumns(rounded)


@query("q19_per_variant_limit", f"with {NEAR}, w as (select *, row_number() over (partition by query_id, variant order by dist, image_id) as o from n) select query_id, image_id, min(dist) as dist, max(1 - dist / 64) as pattern_score from w where o <= {H.candidate_width(K)} group by 1, 2")
def per_variant_limit(spark, sf_dir):
    return H.nearest_by_hash(asked(spark, sf_dir), hashed(spark, sf_dir), K, None).select("query_id", "image_id", "dist", "pattern_score")


OLD = "old as (select o_orderkey::varchar as key, epoch(o_orderdate)::double as mtime, round(o_totalprice * 100)::bigint as size from orders where o_orderkey % 10 <> 0)"
NEW = "scan as (select o_orderkey::varchar as key, epoch(o_orderdate)::double + o_orderkey % 5 as mtime, round(o_totalprice * 100)::bigint + (o_orderkey % 7 = 0)::int as size from orders where o_orderkey % 11 <> 0)"
CHANGES = f"""{OLD}, {NEW}, x as (select coalesce(s.key, o.key) as key, case when o.key is null then 'new' when s.key is null then 'missing'
when s.size <> o.size or abs(s.mtime - o.mtime) > 2 then 'changed' else 'unchanged' end as change from scan s full outer join old o on s.key = o.key)"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A scan and the catalog before it."""
    o = table(spark, sf_dir, "orders")
    key, size, mtime = F.col("o_orderkey").cast("string"), F.round(F.col("o_totalprice") * 100).cast("bigint"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    old = o.filter("o_orderkey % 10 <> 0").select(key.alias("key"), mtime.alias("mtime"), size.alias("size"))
    scan = o.filter("o_orderkey % 11 <> 0").select(key.alias("key"), (mtime + F.col("o_orderkey") % 5).alias("mtime"), (size + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("size"))
    return scan, old


@query("q20_scan_diff", f"with {CHANGES} select key, change from x")
def scan_diff(spark, sf_dir):
    return C.diff(*snapshots(spark, sf_dir))


@query("q21_scan_diff_counts", f"with {CHANGES} select " + ", ".join(f"count(*) filter (change = '{k}') as n_{k}" for k in ("new", "changed", "missing", "unchanged")) + " from x")
def scan_diff_counts(spark, sf_dir):
    return C.diff_counts(C.diff(*snapshots(spark, sf_dir)))


@query("q22_missing_keys", f"with {OLD}, {NEW} select key from old except select key from scan")
def missing_keys(spark, sf_dir):
    return C.missing_keys(*snapshots(spark, sf_dir))


@query("q22b_reindex_queue", f"with {CHANGES} select key from x where change in ('new', 'changed') union select o_orderkey::varchar from orders where o_orderkey % 13 = 0")
def reindex_queue(spark, sf_dir):
    lacking = table(spark, sf_dir, "orders").filter("o_orderkey % 13 = 0").select(F.col("o_orderkey").cast("string").alias("key"))
    return C.with_queue(C.to_process(C.diff(*snapshots(spark, sf_dir))), lacking)


@query("q23_upsert_partial", """with t as (select c_custkey as key, c_name as name, c_acctbal as bal, c_mktsegment as seg from customer where c_custkey % 4 <> 0),
s as (select c_custkey as key, c_acctbal * 2 as bal from customer where c_custkey % 3 = 0)
select coalesce(t.key, s.key) as key, t.name, case when s.key is not null then s.bal else t.bal end as bal, t.seg from t full outer join s on t.key = s.key""")
def upsert_partial(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return C.upsert(c.filter("key % 4 <> 0"), c.filter("key % 3 = 0").select("key", (F.col("bal") * 2).alias("bal")))


@query("q23c_upsert_repeats", """with t as (select c_custkey as key, c_name as name, c_acctbal as bal from customer where c_custkey % 4 <> 0),
s as (select c_custkey * 2 as key, o_totalprice as bal, row_number() over (partition by c_custkey order by o_orderkey desc) as n from orders join customer on o_custkey = c_custkey), l as (select key, bal from s where n = 1)
select coalesce(t.key, l.key) as key, t.name, case when l.key is not null then l.bal else t.bal end as bal from t full outer join l on t.key = l.key""")
def upsert_repeats(spark, sf_dir):
    """Rows that repeat a key: the one of the last order counts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    o = table(spark, sf_dir, "orders")
    rows = o.join(c, F.col("o_custkey") == F.col("key")).select((F.col("key") * 2).alias("key"), F.col("o_totalprice").alias("bal"), F.col("o_orderkey").alias("at"))
    return C.upsert(c.filter("key % 4 <> 0"), rows, order_col="at")


@query("q23b_new_ids", "select count(*) as rows, count(distinct c_custkey) as ids, min(c_custkey) filter (c_custkey % 4 <> 0) as first, count(*) + (select max(c_custkey) from customer where c_custkey % 4 <> 0) - (select count(*) from customer where c_custkey % 4 <> 0) as last from customer")
def new_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("id"), F.col("c_name").alias("key"))
    return C.with_ids(c).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("q24_vector_upsert", "select vec_id as image_id, case when vec_id % 5 = 0 then -embedding[1] else embedding[1] end::double as first from embeddings where vec_id % 3 <> 0 or vec_id % 5 = 0")
def vector_upsert(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vec"))
    new = v.filter("image_id % 5 = 0")
    twice = new.select("image_id", "vec", F.lit(1).alias("at")).unionByName(new.select("image_id", F.transform("vec", lambda x: -x).alias("vec"), F.lit(2).alias("at")))
    return C.upsert_vectors(v.filter("image_id % 3 <> 0"), twice, "at").select("image_id", F.get("vec", F.lit(0)).cast("double").alias("first"))


@query("q25_mark_status", f"with {CHANGES} select o.key, case when x.change = 'missing' then 'missing' else 'ok' end as status, case when x.change = 'missing' then null else 'was' end as error from old o join x on o.key = x.key")
def mark_status(spark, sf_dir):
    scan, old = snapshots(spark, sf_dir)
    held = old.select("key", F.lit("ok").alias("status"), F.lit("was").alias("error"))
    return C.mark_status(held, C.missing_keys(scan, old), C.MISSING)


@query("q26_cascade_delete", "select 'images' as tbl, count(*) as n, sum(doc_id)::bigint as ids from documents where source <> 'src3' union all select 'vectors', count(*), sum(l.doc_id)::bigint from labels l join documents d on l.doc_id = d.doc_id where source <> 'src3'")
def cascade_delete(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("key"), "source")
    images, vectors = C.delete_keys(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id")), d.filter("source = 'src3'"))
    count = lambda df, name, c: df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"), F.sum(c).alias("ids"))
    return count(images, "images", "id").unionByName(count(vectors, "vectors", "image_id"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.when(F.col("doc_id") % 7 == 0, "missing").when(F.col("doc_id") % 11 == 0, "error").otherwise("ok").alias("status"))


STATUS = "case when doc_id % 7 = 0 then 'missing' when doc_id % 11 = 0 then 'error' else 'ok' end"


@query("q27_keys_missing_vectors", f"select 'k' || doc_id as key, doc_id as id from documents d where {STATUS} = 'ok' and not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def keys_missing_vectors(spark, sf_dir):
    return C.keys_missing_vectors(_documents(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"))).select("key", "id")


@query("q28_vectors_of_ok", f"select l.doc_id as image_id, quality from labels l join documents d on l.doc_id = d.doc_id where {STATUS.replace('doc_id', 'd.doc_id')} = 'ok' order by 1")
def vectors_of_ok(spark, sf_dir):
    return C.vectors_of_ok(_documents(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), "quality"))


@query("q28b_records", f"select doc_id as id, 'k' || doc_id as key, {STATUS} as status from documents where {STATUS} = 'ok' order by 1")
def records(spark, sf_dir):
    return C.records(_documents(spark, sf_dir))


@query("q29_status_stats", f"select count(*) as total, count(*) filter (s = 'ok') as ok, count(*) filter (s = 'missing') as missing, count(*) filter (s = 'error') as error from (select {STATUS} as s from documents)")
def status_stats(spark, sf_dir):
    return C.stats(_documents(spark, sf_dir))


@query("q30_point_lookup", "select c_custkey, c_name from customer where c_custkey = 42")
def point_lookup(spark, sf_dir):
    return C.point(table(spark, sf_dir, "customer"), c_custkey=42).select("c_custkey", "c_name")


@query("q31_kv_json", "select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, coalesce(json_extract_string(props, '$.no_such'), 'fallback') as absent from events")
def kv_json(spark, sf_dir):
    get = lambda name, default: F.coalesce(F.get_json_object("props", f"$.{name}"), F.lit(default))
    return table(spark, sf_dir, "events").select("event_id", get("k", "none").alias("k"), get("no_such", "fallback").alias("absent"))


@query("q31b_settings_upsert", "select 'settings' as ns, 'k' || (user_id % 50) as key, max(event_id)::varchar as value from events group by all")
def settings_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")).alias("key")).agg(F.max("event_id").cast("string").alias("value")).select(F.lit("settings").alias("ns"), "key", "value")
    return C.upsert_settings(rows.withColumn("value", F.lit("old")), rows)


@query("q31c_settings_upsert_repeats", "select 'settings' as ns, 'k' || (user_id % 50) as key, arg_max(props, event_id) as value from events group by all")
def settings_upsert_repeats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("settings").alias("ns"), F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")).alias("key"), F.col("props").alias("value"), "event_id")
    return C.upsert_settings(e.select("ns", "key", F.lit("old").alias("value")).distinct(), e, "event_id")


KEY = r"rtrim(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')), '/')"


@query("q32_key_normalise_dedup", f"select key, min(page_id) as page_id from (select page_id, replace({KEY}, '//', '/') as key from pages) group by key")
def key_normalise_dedup(spark, sf_dir):
    bare = F.lower(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""))
    messy = F.concat(F.lit("./"), F.regexp_replace(bare, "/", "/./x/../"))
    rows = table(spark, sf_dir, "pages").select("page_id", P.normalize_key(messy).alias("key"))
    return C.first_of_key(rows, "key", "page_id").select("key", "page_id")


@query("q33_thumb_name", "select page_id, sha1(url) || '.jpg' as thumb from pages")
def thumb_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.thumb_name(F.col("url")).alias("thumb"))


QUALITY = f"""with {GRIDS}, s as (select a.vec_id as query_id, b.vec_id as image_id, (a.label = b.label)::int as same, a.label, {COSINE} as c from e a join e b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by round(c, 12) desc, image_id) as pos from s), f as (select label, greatest(count(*) - 1, 1) as others from e group by label),
g as (select query_id, label, {', '.join(f'sum(same) filter (pos <= {k}) as s{k}' for k in E.CUTS)} from r group by all)"""


def _quality(spark, sf_dir):
    """Every image asks."""
    rows = grids(spark, sf_dir)
    wanted = rows.select(F.col("image_id").alias("query_id"), F.lit(0).alias("variant"), F.col("px").alias("vec"))
    near = V.nearest_by_cosine(wanted, rows.withColumnRenamed("px", "vec"), max(E.CUTS) + 1)
    return E.quality(near, rows.select("image_id", F.col("label").alias("family")), asked=wanted)


@query("q34_family_hit_at_k", QUALITY + " select count(*) as n, " + ", ".join(f"round(avg((s{k} > 0)::int), 6) as hit_{k}" for k in E.CUTS) + " from g")
def family_hit(spark, sf_dir):
    return _quality(spark, sf_dir).select("n", *(F.round(f"hit_{k}", 6).alias(f"hit_{k}") for k in E.CUTS))


@query("q35_family_recall_at_k", QUALITY + " select " + ", ".join(f"round(avg(s{k} / others), 6) as recall_{k}" for k in E.CUTS) + " from g join f on f.label = g.label")
def family_recall(spark, sf_dir):
    return _quality(spark, sf_dir).select(*(F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in E.CUTS))


CLOSE = 18
HASH_QUALITY = f"""with {HASHED}, s as (select a.vec_id as query_id, (a.label = b.label)::int as same, row_number() over (partition by a.vec_id order by {DIST}, b.vec_id) as pos from b a join b on a.vec_id <> b.vec_id where {DIST} <= {CLOSE}),
g as (select e.vec_id, {', '.join(f'coalesce(sum(same) filter (pos <= {k}), 0) as s{k}' for k in E.CUTS)} from e left join s on s.query_id = e.vec_id group by all)"""


@query("q34c_family_hit_by_hash", HASH_QUALITY + " select count(*) as n, " + ", ".join(f"round(avg((s{k} > 0)::int), 6) as hit_{k}" for k in E.CUTS) + " from g")
def family_hit_by_hash(spark, sf_dir):
    """By hash within a distance, where most images have no hit at all and count as misses."""
    from pyspark.sql import Window

    pairs = H.self_join(hashed(spark, sf_dir), CLOSE)
    ways = F.array(*(F.struct(F.col(x).alias("query_id"), F.col(y).alias("image_id")) for x, y in ("ab", "ba")))
    both = pairs.select(F.explode(ways).alias("_w"), "dist").select("_w.*", "dist")
    # no pair has an image with itself, so what ranks after the last cut can't move up to it
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "image_id"))).filter(F.col("rank") <= max(E.CUTS))
    rows = grids(spark, sf_dir)
    found = E.quality(ranked, rows.select("image_id", F.col("label").alias("family")), asked=rows.select(F.col("image_id").alias("query_id")))
    return found.select("n", *(F.round(f"hit_{k}", 6).alias(f"hit_{k}") for k in E.CUTS))


@query("q36_debounce_sessions", """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) > interval 30 second then 1 else 0 end as b from events),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as g from o) select user_id, min(ts) as started, max(ts) as ended, count(*) as n_events from s group by user_id, g""")
def debounce_sessions(spark, sf_dir):
    return W.debounced(table(spark, sf_dir, "events"), "ts", "30 seconds", ("user_id",))


@query("q37_extension_filter", "select page_id, name from (select page_id, 'a/b.c/page' || page_id || case page_id % 6 when 0 then '.JPG' when 1 then '.jpeg' when 2 then '.png' when 3 then '.txt' when 4 then '' else '.png.bak' end as name from pages) where page_id % 6 in (0, 1, 2)")
def extension_filter(spark, sf_dir):
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".JPG", ".jpeg", ".png", ".txt", "", ".png.bak"))), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a/b.c/page"), F.col("page_id").cast("string"), suffix).alias("name")).filter(P.has_extension(F.col("name")))


@query("q37b_family_of", "select page_id, 'fam' || page_id % 9 as family from pages")
def family_names(spark, sf_dir):
    name = F.concat(F.lit("dir_x/fam"), (F.col("page_id") % 9).cast("string"), F.lit("_rot90.png"))
    return table(spark, sf_dir, "pages").select("page_id", P.family_of(name).alias("family"))


@query("q38_lsh_knn")
def lsh_knn(spark, sf_dir):
    rows = grids(spark, sf_dir).withColumnRenamed("px", "vec")
    return V.nearest_approximate(rows.filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), "vec"), rows, K)


@query("q38b_lsh_recall", f"select count(*) as queries, count(*) * {K} as rows, true as recall_reached from embeddings where {ASKED}")
def lsh_recall(spark, sf_dir):
    """Whether the approximate search finds nine tenths of what the exact one does, and k rows for each query."""
    rows = grids(spark, sf_dir).withColumnRenamed("px", "vec")
    wanted = rows.filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), F.lit(0).alias("variant"), "vec")
    near = V.nearest_approximate(wanted, rows, K).select("query_id", "image_id", F.lit(1).alias("near"))
    exact = V.nearest_by_cosine(wanted, rows, K).select("query_id", "image_id", F.lit(1).alias("exact"))
    both = near.join(exact, ["query_id", "image_id"], "full_outer")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("near").alias("rows"), (F.count(F.col("near") + F.col("exact")) >= 0.9 * F.count("exact")).alias("recall_reached"))


@query("q39_stream_incremental", "select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by event_type")
def stream_incremental(spark, sf_dir):
    """Events come as a stream of files; each micro-batch is merged into a catalog by key, and a batch that runs twice changes nothing."""
    schema = table(spark, sf_dir, "events").schema
    place = W.scratch(spark, "stream")
    held = W.Merged(spark, f"{place}/events", schema, "event_id", "ts")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    W.merge_into(stream, held, f"{place}/state").awaitTermination()
    return held.table().groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("q40_hamming_words", f"with {HASHED}, {FREQ}, g as (select vec_id, {MEDIAN.format('f')} as d, f from f), p as (select b.vec_id, list_concat(b.bits, list_transform(f, lambda x: (x > d)::int)) as bits from g join b on b.vec_id = g.vec_id) select a.vec_id as query_id, b.vec_id as image_id, list_sum(list_transform(range(1, 129), lambda i: (a.bits[i] <> b.bits[i])::int))::int as dist from p a, p b where a.{ASKED}")
def long_hashes(spark, sf_dir):
    """Hashes of 128 bits, as two words."""
    words = X.pack_words(F.concat(X.ahash_bits(F.col("px")), X.phash_bits(F.col("px"))))
    rows = grids(spark, sf_dir).select("image_id", words.alias("h"))
    wanted = rows.filter(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), F.col("h").alias("q"))
    return in_blocks(wanted, rows, "image_id").select("query_id", "image_id", X.hamming_words(F.col("h"), F.col("q")).alias("dist"))


@query("q41_hash_blobs", f"with {HASHED} select vec_id as image_id, true as same, 8 as bytes from b")
def hash_blobs(spark, sf_dir):
    blob = X.word_to_blob(F.col("h"))
    return hashed(spark, sf_dir).select("image_id", (X.blob_to_word(blob) == F.col("h")).alias("same"), F.octet_length(blob).alias("bytes"))


@query("q42_path_functions", r"select page_id, 'srv/share/p' || page_id || '.png' as key, page_id % 2 = 0 as unc from pages")
def path_functions(spark, sf_dir):
    n = F.col("page_id").cast("string")
    path = F.concat(F.lit("srv/./a/../share//p"), n, F.lit(".png"))
    share = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//host/"), n)).otherwise(F.concat(F.lit("/mnt/"), n))
    return table(spark, sf_dir, "pages").select("page_id", P.normalize_key(path).alias("key"), P.is_unc(share).alias("unc"))
