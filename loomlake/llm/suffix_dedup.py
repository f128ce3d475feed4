"""Removal of repeated passages by longest previous factors, over suffixes dealt out by anchors.

A window of LENGTH bytes is removed if it also starts earlier. Of the grams of GRAM bytes in a window, the one with the
least hash is its anchor; equal windows have equal anchors at equal places, so suffixes that share LENGTH bytes meet
when windows are grouped by anchor. The windows that share an anchor in a text are a run, and a run's bytes its context.

1. Runs are dealt by anchor, and runs with equal contexts (by 64-bit hashes of anchor and context, both keyed) are put
   together before suffixes are ordered: all but the earliest are covered, whatever else there is. It keeps groups of copies
   from growing into groups of suffixes.
2. The earliest runs of anchors with several contexts go on, with their bytes. Their suffixes are put in order; the previous
   and the next smaller place of each in that order are the earlier places that share most with it, and the longer of both
   common prefixes is its longest previous factor, counted up to LENGTH. Windows where it is LENGTH are covered.
3. Anchors with more than GROUP contexts would make too large a group. Their windows are dealt by their own LENGTH bytes, and
   the least place of each is found by partial aggregates: the same previous smaller places, without a group in one task.

Anchors that have many contexts within a batch are found beforehand, over all texts; their runs are dealt by context too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import Prefix, mix
from .util import by_key, byte_slices, cut, fresh, give_back, small

LENGTH = 100
GRAM = 32
SLICE_BYTES = (1 << 20) - LENGTH  # so that tables of powers have 1 << 20 places
#: Contexts in one batch that make an anchor frequent, so that its runs are dealt by context.
OFTEN = 8
#: Contexts up to which an anchor's windows are put in suffix order together; those of others are dealt by their bytes.
GROUP = 2000
#: Bytes of contexts put in suffix order at once.
ORDER_BYTES = 1 << 19
_PLACE = np.uint64((1 << 31) - 1)
ANCHORED, COVERED, SALTED = 0, 1, 2
_NO_ID = (1 << 63) - 1


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    full[:n] = values
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run in texts that stand one after another in data: text, first window, windows, anchor hash, context hash."""
    if len(data) > 2 * SLICE_BYTES and len(offsets) == 2:  # one long text, by overlapping slices; a run may then be in two parts
        parts = []
        for at in range(0, len(data) - LENGTH + 1, SLICE_BYTES):
            piece = data[at : at + SLICE_BYTES + LENGTH - 1]
            t, a, *rest = runs(piece, np.array([0, len(piece)]))
            parts.append((t, a + at, *rest))
        return tuple(np.concatenate(x) for x in zip(*parts))
    inside = np.zeros(len(data) + 1, np.int64)
    long = offsets[1:] - offsets[:-1] >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = Prefix(data).grams(GRAM)
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_minima(keyed, LENGTH - GRAM + 1)[starts] & _PLACE).astype(np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.append(first, len(starts)))
    begin, text = starts[first], text[first]
    return text, begin - offsets[text], count, grams[anchor[first]], Prefix(data, 1).of(begin, begin + count + LENGTH - 1)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in a row, and where each begins and the last ends."""
    coded = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, th, text: rows are told apart and ordered by id, null last, and the text's hash."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def frequent_anchors(rows: DataFrame) -> DataFrame:
    """g: anchors with OFTEN or more contexts in some batch. It only decides how runs are dealt, not what comes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                _, _, _, g, x = runs(*_bytes_of(batch.column("text")))
                order = np.lexsort((x, g))
                g, x = g[order], x[order]
                g = g[np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))] if len(g) else g
                g, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g[n >= OFTEN].view(np.int64))], names=["g"])
        give_back()

    return rows.select("text").mapInArrow(run, "g bigint").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """k, g, x, d, th, a, n, kind for each run; of equal contexts in a batch all but the earliest are COVERED at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                text, a, n, g, x = runs(*_bytes_of(batch.column("text")))
                d, th = (batch.column(c).to_numpy()[text] for c in ("d", "th"))
                order = np.lexsort((a, th, d, x, g))
                text, a, n, g, x, d, th = (v[order] for v in (text, a, n, g, x, d, th))
                again = np.concatenate(([False], (g[1:] == g[:-1]) & (x[1:] == x[:-1])))[: len(g)]
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(g))))
                same = (d == d[first]) & (th == th[first]) & (a == a[first])
                keep = ~(again & same)  # a repeated row
                kind = np.where(again, COVERED, ANCHORED).astype(np.int8)
                k = np.where(again, mix(x + a.astype(np.uint64)), g)
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (k.view(np.int64), g.view(np.int64), x.view(np.int64), d, th, a, n.astype(np.int32), kind)], names=["k", "g", "x", "d", "th", "a", "n", "kind"])
        give_back()

    return rows.mapInArrow(run, "k bigint, g bigint, x bigint, d bigint, th bigint, a bigint, n int, kind tinyint")


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in the order of k, g, x, d, th, a: those that are covered, and the earliest of each context where an anchor has several.

    It goes on from batch to batch with the last context's earliest run, so no group is held.
    """
    last = None  # g, x, place of the context's earliest run, contexts of g so far, earliest run not given out yet
    for batch in batches:
        if not batch.num_rows:
            continue
        g, x, d, th, a, n, kind = (batch.column(c).to_numpy() for c in ("g", "x", "d", "th", "a", "n", "kind"))
        passed = kind == COVERED
        yield _sifted(g[passed], d[passed], th[passed], a[passed], n[passed], COVERED)
        g, x, d, th, a, n, kind = (v[~passed] for v in (g, x, d, th, a, n, kind))
        if not len(g):
            continue
        new_g = np.concatenate(([last is None or last[0] != g[0]], g[1:] != g[:-1]))
        new_x = new_g | np.concatenate(([last is None or last[1] != x[0]], x[1:] != x[:-1]))
        group = np.cumsum(new_g) - new_g[0]
        contexts = np.bincount(group, weights=new_x).astype(np.int64)
        if not new_g[0]:
            contexts[0] += last[3]
        head = np.maximum.accumulate(np.where(new_x, np.arange(len(g)), -1))
        place = [np.where(head >= 0, v[np.maximum(head, 0)], p) for v, p in zip((d, th, a), last[2] if last else (0, 0, 0))]
        covered = ~new_x & ((d != place[0]) | (th != place[1]) | (a != place[2]))
        yield _sifted(g[covered], d[covered], th[covered], a[covered], n[covered], COVERED)
        give = new_x & ((contexts[group] > 1) | (kind == SALTED))
        if last and last[4] and not new_g[0] and contexts[0] > 1:
            yield _sifted(*(np.array([v]) for v in last[4]), ANCHORED)
            last = (*last[:4], None)
        yield _sifted(g[give], d[give], th[give], a[give], n[give], ANCHORED)
        i, h = len(g) - 1, head[-1]
        if contexts[-1] > 1 or kind[i] == SALTED:
            waiting = None
        elif group[-1] == 0 and not new_g[0]:
            waiting = last[4]
        else:
            waiting = (g[h], d[h], th[h], a[h], n[h])
        last = (g[i], x[i], tuple(p[i] for p in place), contexts[-1], waiting)


def _sifted(g, d, th, a, n, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (g, d, th, a)] + [pa.array(n, pa.int32()), pa.array(np.full(len(g), kind, np.int8))], names=["g", "d", "th", "a", "n", "kind"])


def _eights(data: np.ndarray, length: int) -> np.ndarray:
    """The eight bytes from each place on as a number, in the order of bytes."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n]
    return word


def suffix_ranks(word: np.ndarray, length: int) -> np.ndarray:
    """The rank of the length bytes from each place on, among all places, by doubling prefixes; equal for equal bytes."""
    n = len(word)
    ranks, size = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while size < length:
        step = min(size, length - size)
        after = np.concatenate((ranks[step:], np.zeros(step, np.int64)))
        ranks, size = np.unique(ranks * (n + 1) + after, return_inverse=True)[1].astype(np.int64), size + step
    return ranks


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Where the nearest smaller value before each value stands, or -1, by jumping from candidate to candidate."""
    at = np.arange(len(x)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[x[at[open_]] > x[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def _common(word: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at places one and two have in common, in whole eights up to length, and length for that many."""
    out = np.zeros(len(one), np.int64)
    same = np.arange(len(one))
    for step in [*range(0, length - 7, 8), length - 8]:
        same = same[word[one[same] + step] == word[two[same] + step]]
        out[same] = step + 8
    return out


def previous_factors(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor, as _common counts it, of the suffix at each of these ascending places among them."""
    word = _eights(data, length)
    ranks = suffix_ranks(word, length)[places]
    order = np.argsort(ranks, kind="stable")
    out = np.zeros(len(places), np.int64)
    before = previous_smaller(order)
    after = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    for near, some in ((before, before >= 0), (after, after < len(order))):
        own, other = order[some], order[near[some]]
        out[own] = np.maximum(out[own], _common(word, places[own], places[other], length))
    return out


def _stretches(hit: np.ndarray, *owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch of hits with equal owners."""
    at = np.flatnonzero(hit)
    new = np.concatenate(([True], at[1:] != at[:-1] + 1))[: len(at)]
    for o in owners:
        new[1:] |= o[at[1:]] != o[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered windows of contexts in the order of g, d, th, a; whole groups of g at a time, up to ORDER_BYTES together."""

    def close(t: pa.Table) -> pa.RecordBatch:
        data, offsets = _bytes_of(t.column("context").combine_chunks())
        count = t.column("n").to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        hit = previous_factors(data, offsets[owner] + inner, LENGTH) == LENGTH
        at, size = _stretches(hit, owner)
        d, th, a = (t.column(c).to_numpy()[owner[at]] for c in ("d", "th", "a"))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(th), pa.array(a + inner[at]), pa.array(size, pa.int32())], names=["d", "th", "a", "n"])

    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += batch.column("context").nbytes
        if total < ORDER_BYTES:
            continue
        table = pa.Table.from_batches(held)
        g = table.column("g").to_numpy()
        stop = int(np.searchsorted(g, g[-1]))  # the last group may go on
        sizes = np.cumsum(pc.binary_length(table.column("context")).to_numpy())
        begin = 0
        while begin < stop:
            reach = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + ORDER_BYTES))
            end = stop if reach >= stop else max(int(np.searchsorted(g, g[reach])), int(np.searchsorted(g, g[begin], "right")))
            yield close(table.slice(begin, end - begin))
            begin = end
        held = table.slice(stop).to_batches()
        total = sum(b.column("context").nbytes for b in held)
    if held:
        yield close(pa.Table.from_batches(held))


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each wanted run (d, th, g, a, n, split) its context, or for split ones a row for each window with its bytes as w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                cols: list[list] = [[] for _ in range(7)]
                for d, th, text, held in zip(*(batch.column(c).to_pylist() for c in ("d", "th", "text", "runs"))):
                    data = text.encode("utf-8", "surrogatepass")
                    for r in held:
                        if not r["split"]:
                            rows = [(r["g"], d, th, r["a"], r["n"], data[r["a"] : r["a"] + r["n"] + LENGTH - 1], None)]
                        else:
                            rows = [(r["g"], d, th, i, 1, None, data[i : i + LENGTH]) for i in range(r["a"], r["a"] + r["n"])]
                        for row in rows:
                            for c, v in zip(cols, row):
                                c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["g", "d", "th", "a", "n", "context", "w"])

    held = wanted.groupBy(F.col("d").alias("_d"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("g", "a", "n", "split")).alias("runs"))
    rows = texts.join(by_key(held), (F.col("d") == F.col("_d")) & (F.col("th") == F.col("_th"))).select("d", "th", "text", "runs")
    return rows.mapInArrow(run, "g bigint, d bigint, th bigint, a bigint, n int, context binary, w binary")


def covered_windows(rows: DataFrame) -> DataFrame:
    """d, th, a, n: stretches of n windows from a on, each of which starts earlier too, for rows d, th, text."""
    frequent = small(cut(frequent_anchors(rows).select(F.col("g").alias("_g")), "anchors"))
    dealt = _dealt(rows).join(frequent, (F.col("g") == F.col("_g")) & (F.col("kind") == ANCHORED), "left")
    salted = F.col("_g").isNotNull()
    dealt = dealt.select(F.when(salted, F.xxhash64("g", "x")).otherwise(F.col("k")).alias("k"), "g", "x", "d", "th", "a", "n", F.when(salted, F.lit(SALTED).cast("tinyint")).otherwise(F.col("kind")).alias("kind"))
    ordered = dealt.repartition("k").sortWithinPartitions("k", "g", "x", "d", "th", "a")
    sifted = cut(ordered.mapInArrow(_sift, "g bigint, d bigint, th bigint, a bigint, n int, kind tinyint"), "runs")

    open_ = sifted.filter(F.col("kind") == ANCHORED)
    many = small(cut(open_.groupBy(F.col("g").alias("_g")).count().filter(F.col("count") > GROUP).select("_g"), "many-contexts"))
    wanted = open_.join(many, F.col("g") == F.col("_g"), "left").select("g", "d", "th", "a", "n", F.col("_g").isNotNull().alias("split"))
    contexts = cut(_contexts(rows, wanted), "contexts")
    groups = contexts.filter("context is not null").select("g", "d", "th", "a", "n", "context").repartition("g").sortWithinPartitions("g", "d", "th", "a")
    by_order = groups.mapInArrow(_order, "d bigint, th bigint, a bigint, n int")
    windows = contexts.filter("context is null").select("w", "d", "th", "a", "n")
    least = windows.groupBy(F.col("w").alias("_w")).agg(F.min(F.struct("d", "th", "a")).alias("least"), F.max(F.struct("d", "th", "a")).alias("most")).filter("least <> most")
    by_window = windows.join(by_key(least), F.col("w") == F.col("_w")).filter(F.struct("d", "th", "a") != F.col("least")).select("d", "th", "a", "n")
    return sifted.filter(F.col("kind") == COVERED).select("d", "th", "a", "n").unionByName(by_order).unionByName(by_window)


def _removed(size: int, held: list[dict] | None) -> np.ndarray:
    """Begins and ends, in pairs, of the bytes that the stretches of windows cover."""
    if not held:
        return np.zeros((0, 2), np.int64)
    both = np.array(sorted((r["a"], r["a"] + r["n"] + LENGTH - 1) for r in held), np.int64)
    end = np.maximum.accumulate(both[:, 1])
    new = np.concatenate(([True], both[1:, 0] > end[:-1]))
    first = np.flatnonzero(new)
    return np.stack((both[first, 0], end[np.append(first[1:], len(both)) - 1]), axis=1)


def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with the covered stretches of each, and that column's name."""
    d, th, runs = fresh(docs, "d", "th", "runs")
    found = covered_windows(_identified(docs, id_col, text_col)).groupBy(F.col("d").alias(d), F.col("th").alias(th)).agg(F.collect_list(F.struct("a", "n")).alias(runs))
    text = F.coalesce(docs[text_col], F.lit(""))
    same = (F.coalesce(docs[id_col].cast("bigint"), F.lit(_NO_ID)) == F.col(d)) & (F.xxhash64(text) == F.col(th))
    return docs.join(by_key(found), same, "left").drop(d, th), runs


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty; texts under LENGTH bytes lose nothing. Earlier is by id, null last, then place. Rows that
    share id and text are one document; those that share an id only come in the order of their texts' hashes. An empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                out = []
                for text, held in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
                    data, at, digest = text or b"", 0, hashlib.sha256()
                    spans = _removed(len(data), held)
                    for b, e in spans.tolist():
                        digest.update(data[at:b])
                        at = e
                    digest.update(data[at:])
                    out.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
                cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return _joined(rows, "doc_id", "text")[0].select("doc_id", "text", "runs").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the covered bytes out of their texts, whole characters only; n_chars, where there is one, follows.

    Null texts stay null, empty ones and those under LENGTH bytes as they are. Which copy is the first is as in
    removal_digests, so rows that share id and text keep the same; null ids come last. Very long texts are cut as a whole. An
    empty table gives none; other columns stay as they are, whatever they are called.
    """
    at = docs.columns.index(text_col)
    joined, runs = _joined(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, held in zip(batch.column(text_col).to_pylist(), batch.column(runs).to_pylist()):
                if text and held:
                    data, last, kept = text.encode("utf-8", "surrogatepass"), 0, []
                    for b, e in _removed(len(data), held).tolist():
                        while b < e and data[b] & 0xC0 == 0x80:  # inwards to whole characters
                            b += 1
                        while b < e < len(data) and data[e] & 0xC0 == 0x80:
                            e -= 1
                        kept.append(data[last:b])
                        last = e
                    text = b"".join([*kept, data[last:]]).decode("utf-8", "surrogatepass")
                out.append(text)
            yield batch.drop_columns([runs]).set_column(at, batch.schema.field(text_col), pa.array(out, batch.schema.field(text_col).type))

    left = joined.mapInArrow(run, docs.schema)
    return left.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
