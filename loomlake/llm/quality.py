"""Quality rules whose cutoffs come from mergeable quantile sketches for each language and source.

A sketch counts values by their six leading bits (a log-linear histogram, off by a 32nd at most). Counts add up, so
sketches of partitions, sources and languages merge exactly, in any order. Cutoffs are fences around the middle half of a
group's values; a group with few documents takes the merged sketch of its language, or of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import cut, small

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
SPAN = 5
#: Documents that a group needs for cutoffs of its own.
GROUP_DOCS = 200
#: Interquartile ranges from the quartiles to the fences.
REACH = 6
#: What a fence lies away from the quartile at least. Ratios are in ten-thousandths, word lengths in hundredths.
MARGIN = {"symbols": 500, "dup_lines": 3000, "repeats": 1500, "word_length": 300}
#: Metrics with a lower fence also.
TWO_SIDED = ("word_length",)
LEADING_BITS = 6


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of SPAN words that occur twice or more, as a long.

    Hashes of windows are sorted with the window's place in their low bits; where neighbours agree on the other bits,
    the windows' own words are sorted and compared. Places of windows that do recur then give the words covered.
    """

    def by_hash(h: Column) -> Column:
        windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (SPAN - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SPAN))))
        bits = F.length(F.bin(F.size(h).cast("long")))
        packed = F.transform(windows, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits).bitwiseOR(i.cast("long")))
        return let(bits, lambda b: let(F.sort_array(packed), lambda s: close(s, b)))

    def close(s: Column, b: Column) -> Column:
        same = lambda x, y: F.coalesce(F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b), F.lit(False))
        near = F.filter(s, lambda x, i: F.when(same(x, F.get(s, i + 1)), True).otherwise((i > 0) & same(x, F.get(s, i - 1))))
        return F.transform(near, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int"))

    def covered(near: Column) -> Column:
        texts = F.array_sort(F.transform(near, lambda p: F.struct(F.array_join(F.slice(words, p + 1, F.lit(SPAN)), " ").alias("t"), p.alias("p"))))
        recur = let(texts, lambda t: F.transform(F.filter(t, lambda x, i: F.coalesce(x["t"] == F.get(t, i + 1)["t"], F.lit(False)) | F.when(i > 0, x["t"] == F.get(t, i - 1)["t"]).otherwise(False)), lambda x: x["p"]))
        return let(F.sort_array(recur), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(p, i + 1) - x, F.lit(SPAN)))), F.lit(0).cast("long"), lambda a, x: a + x))

    near = let(F.transform(words, lambda w: F.xxhash64(w)), by_hash)
    return let(near, lambda n: F.when(F.size(n) > 0, covered(n)).otherwise(F.lit(0).cast("long")))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, text_hash, the base counts, base_failed and the metrics of every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    split = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[source_col].alias("source"), text.alias("text"), F.array_remove(F.split(text, WORD_BREAK), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    counts = split.select(
        "doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    part = lambda n, of, unit: F.expr(f"{unit} * {n} div greatest({of}, 1)")
    return counts.select(
        "*", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
        part("n_symbols", "word_chars", 10000).alias("symbols"), part("n_dup_lines", "n_lines", 10000).alias("dup_lines"),
        part("n_repeat_words", "n_words", 10000).alias("repeats"), part("word_chars", "n_words", 100).alias("word_length"),
    )


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys, metric and edge, the value without all but its leading bits."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in MARGIN)))
    shift = f"greatest(length(bin(m.x)) - {LEADING_BITS}, 0)"
    return measured.select(*keys, each.alias("m")).groupBy(*keys, F.col("m.metric").alias("metric"), F.expr(f"shiftleft(shiftright(m.x, {shift}), {shift})").alias("edge")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "edge").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docs, and a low and a high cutoff for each metric. A sketch has some hundred edges, however many documents."""
    one = sketches.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("edge", "n"))).alias("h"), F.sum("n").alias("docs"))
    at = lambda q: F.expr(f"element_at(filter(transform(h, (x, i) -> struct(x.edge as edge, aggregate(slice(h, 1, i + 1), 0L, (a, y) -> a + y.n) as upto)), x -> 100 * x.upto >= {q} * docs), 1).edge")
    cut_at = one.select(*keys, "metric", "docs", at(25).alias("q25"), at(75).alias("q75"))
    margin = reduce(lambda c, m: c.when(F.col("metric") == m, MARGIN[m]), MARGIN, F.when(F.lit(False), 0))
    cut_at = cut_at.withColumn("reach", F.greatest(REACH * (F.col("q75") - F.col("q25")), margin))
    wide = [F.max(F.when(F.col("metric") == m, F.col("q75") + F.col("reach"))).alias(f"high_{m}") for m in MARGIN]
    wide += [F.max(F.when(F.col("metric") == m, F.col("q25") - F.col("reach"))).alias(f"low_{m}") for m in TWO_SIDED]
    return cut_at.groupBy(*keys).agg(F.max("docs").alias("docs"), *wide)


def judge(measured: DataFrame) -> DataFrame:
    """measured (a written table) with kept: not base_failed and within the fences of its language and source."""
    passed = measured.filter(~F.col("base_failed"))
    own = cut(sketch(passed, ["lang", "source"]), "quality-sketch")
    names = [*(f"high_{m}" for m in MARGIN), *(f"low_{m}" for m in TWO_SIDED)]
    whole = fences(merge(own, []), []).first()
    groups = fences(own, ["lang", "source"]).alias("g")
    langs = fences(merge(own, ["lang"]), ["lang"]).alias("l")
    pick = lambda c: F.when(F.col("g.docs") >= GROUP_DOCS, F.col(f"g.{c}")).when(F.col("l.docs") >= GROUP_DOCS, F.col(f"l.{c}")).otherwise(F.lit(whole[c] if whole else None).cast("long"))
    chosen = groups.join(langs, F.col("g.lang").eqNullSafe(F.col("l.lang"))).select(F.col("g.lang").alias("_lang"), F.col("g.source").alias("_source"), *(pick(c).alias(c) for c in names))
    chosen = small(cut(chosen, "quality-fences"))
    both = measured.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = [F.col(m) <= F.col(f"high_{m}") for m in MARGIN] + [F.col(m) >= F.col(f"low_{m}") for m in TWO_SIDED]
    return both.withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, inside)).drop("_lang", "_source")


def score(docs: DataFrame, **columns: str) -> DataFrame:
    """One row for each row of docs: doc_id, lang, source, the counts, base_failed, the metrics, the fences and kept.

    A null or empty text has no words and fails. Null languages and sources are groups like others. Repeated rows are
    judged alike and count once each; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    return judge(cut(measure(docs, **columns), "quality-counts"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they are."""
    out = score(docs).filter(~F.col("kept")).select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "lang", "source", "text_hash"))).distinct()
    out = small(cut(out, "quality-rejected"))
    same = [docs[c].eqNullSafe(out[f"_{c}"]) for c in ("doc_id", "lang", "source")]
    same.append(F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == out["_text_hash"])
    return docs.join(out, reduce(lambda a, b: a & b, same), "left_anti")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    m_rows = " union all ".join(f"select lang, source, '{m}' as metric, {m} as x from m where not base_failed" for m in MARGIN)
    margin = " ".join(f"when '{m}' then {v}" for m, v in MARGIN.items())
    wide = ", ".join([f"max(case when metric = '{m}' then q75 + reach end) as high_{m}" for m in MARGIN] + [f"max(case when metric = '{m}' then q25 - reach end) as low_{m}" for m in TWO_SIDED])
    names = [*(f"high_{m}" for m in MARGIN), *(f"low_{m}" for m in TWO_SIDED)]

    def level(name: str, keys: list[str]) -> str:
        k = "".join(f"{x}, " for x in keys)
        group = f"group by {', '.join(keys)}" if keys else ""
        return f""", {name}_h as (select {k}metric, edge, count(*) as n from e group by {k}metric, edge),
{name}_c as (select *, sum(n) over (partition by {k}metric order by edge) as upto, sum(n) over (partition by {k}metric) as docs from {name}_h),
{name}_q as (select {k}metric, max(docs) as docs, min(case when 100 * upto >= 25 * docs then edge end) as q25, min(case when 100 * upto >= 75 * docs then edge end) as q75 from {name}_c group by {k}metric),
{name} as (select {k}max(docs) as docs, {wide} from (select *, greatest({REACH} * (q75 - q25), case metric {margin} end) as reach from {name}_q) {group})"""

    pick = ", ".join(f"case when g.docs >= {GROUP_DOCS} then g.{c} when l.docs >= {GROUP_DOCS} then l.{c} else (select {c} from a) end as {c}" for c in names)
    inside = " and ".join([f"{m} <= high_{m}" for m in MARGIN] + [f"{m} >= low_{m}" for m in TWO_SIDED])
    return rf"""with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
s as (select r, unnest(range(1, len(words) - {SPAN - 2})) as p, words from w where len(words) >= {SPAN}),
t as (select r, p, count(*) over (partition by r, array_to_string(words[p:p + {SPAN - 1}], ' ')) as c from s),
v as (select r, least({SPAN}, coalesce(lead(p) over (partition by r order by p) - p, {SPAN})) as n from t where c > 1),
b as (select r, sum(n) as n_repeat_words from v group by r),
c as (select r, doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join b using (r)),
m as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, 10000 * n_symbols // greatest(word_chars, 1) as symbols, 10000 * n_dup_lines // greatest(n_lines, 1) as dup_lines,
10000 * n_repeat_words // greatest(n_words, 1) as repeats, 100 * word_chars // greatest(n_words, 1) as word_length from c),
x as ({m_rows}),
y as (select *, greatest(length(bin(x)) - {LEADING_BITS}, 0)::int as k from x),
e as (select lang, source, metric, (x >> k) << k as edge from y)
{level("g", ["lang", "source"])}
{level("l", ["lang"])}
{level("a", [])},
f as (select g.lang, g.source, {pick} from g join l on g.lang is not distinct from l.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {inside} as kept
from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source"""


ORACLE_SQL = _sql()
