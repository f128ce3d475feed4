"""MinHash near-duplicates with tensored banding, links confirmed on whole sets.

Two collections of COLLECTION bands of ROWS minhashes each are made; a table's key is a band of the first with a band of
the second, so COLLECTION squared tables come from 2 * COLLECTION * ROWS minhashes. A pair at similarity s is missed
with probability 1 - (1 - (1 - s**ROWS)**COLLECTION)**2: under 0.0003 at 0.8, under 0.000001 at 0.9.

Copies with equal sets form a class, and only its least id goes on. A bucket's members are compared with its leader, the
member with most company in all its buckets, which is the text that others derive from if it is there. That is linear in
the bucket. Links between members are then sought only where they can be and don't join what is joined:

- a member far from the leader (under FAR by sketch) can't link with one that is linked to the leader, as distances obey
  the triangle inequality; it meets the others that aren't linked to the leader;
- if a member isn't linked to the leader, it can link only with one that shares a shingle outside the leader with it, or
  that has fewer shingles than the leader. Such pairs meet by leader and shingle, or by leader, and go on if what they
  can have in common is enough: that follows from their overlaps with the leader and from maps of MAP bits of what each
  has beside it and lacks of it, since a bit that only one has stands for a shingle that only one has.

A sketch of SKETCH bytes drops pairs whose estimated similarity is SLACK standard errors below the limit, and what is left
is confirmed on the texts' whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .rolling import mix
from .shingles import shingle_sets
from .util import by_key, byte_slices, cut, fresh, give_back, small

COLLECTION = 9
ROWS = 2
SKETCH = 128
#: Standard errors of the sketch that a pair may lie below the limit.
SLACK = 7
#: Sketched similarity to its leader under which a member is far; seven standard errors more are still under 0.6.
FAR = 0.3
#: Bits of a map, in longs of 64.
MAP = 256
SLICE_BYTES = 1 << 20
#: Rows of one set from which on it is among the sets that are broadcast.
OFTEN = 1000
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, 2 * COLLECTION * ROWS, dtype=np.uint64)
_EDGES = (np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.uint64)


def _sketch(sorted_set: np.ndarray) -> list[int]:
    """A byte for each of SKETCH equal ranges of hashes: of the least hash there, 0 for none; eight in a long."""
    at = np.searchsorted(sorted_set, _EDGES)
    there = at < np.append(at[1:], len(sorted_set))
    least = sorted_set[np.minimum(at, len(sorted_set) - 1)]
    return np.where(there, mix(least) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).view(np.int64).tolist()


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (null for none), bands (first collection, then second) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                sets = list(shingle_sets(batch.column("text").to_pylist(), words))
                full = [s for s in sets if len(s)]
                begins = np.cumsum([0, *(len(s) for s in full)])[:-1]
                joined = np.concatenate(full) if full else np.zeros(0, np.uint64)
                bands = np.zeros((2 * COLLECTION, len(full)), np.uint64)
                for k, seed in enumerate(_SEEDS if full else ()):
                    x = (joined ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                    least = np.minimum.reduceat((x ^ (x >> np.uint64(31))) * np.uint64(0xA24BAED4963EE407), begins)
                    bands[k // ROWS] = mix(bands[k // ROWS] + least + np.uint64(k))
                rows = iter(bands.T.view(np.int64).tolist())
                out = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(rows), _sketch(s)) if len(s) else (None, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))))],
                    names=["doc_id", "text_hash", "n_shingles", "set_hash", "bands", "sketch"],
                )
                del sets, full, joined, out
            give_back()

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_hash"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sketch array<bigint>")


def _keys(reps: DataFrame) -> DataFrame:
    """key, doc_id: a row for each table. The key holds the tables' numbers, so tables don't mix."""
    first = F.posexplode(F.slice("bands", 1, COLLECTION)).alias("i", "x")
    second = F.posexplode("other").alias("j", "y")
    rows = reps.select("doc_id", first, F.slice("bands", COLLECTION + 1, COLLECTION).alias("other")).select("doc_id", "i", "x", second)
    return rows.select(F.xxhash64("i", "j", "x", "y").alias("key"), "doc_id")


def _full_bytes(x: str, operator: str, y: str) -> str:
    """SQL for how many bytes of two sketches, put together by the operator, aren't 0: each byte's bits are gathered in its lowest."""
    longs = f"zip_with({x}, {y}, (p, q) -> p {operator} q)"
    for shift in (4, 2, 1):
        longs = f"transform({longs}, v -> v | shiftrightunsigned(v, {shift}))"
    return f"aggregate({longs}, 0, (t, v) -> t + bit_count(v & 72340172838076673))"


def _bits_apart(x: str, y: str) -> str:
    """SQL for the bits in which two sketches differ: some four for each place, and quick in joins."""
    return " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(SKETCH // 8))


def _most_bits_apart(percent: int) -> float:
    """The most bits in which sketches of a linked pair differ, SLACK standard errors over the mean."""
    s = percent / 100
    return 4 * SKETCH * (1 - s) + SLACK * math.sqrt(16 * SKETCH * s * (1 - s) + 2 * SKETCH * (1 - s))


def _sketched(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs a, b with na, nb (sizes), used and apart: places that one of their sketches has, and in which they differ."""
    one = sigs.select(F.col("doc_id").alias("_a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = sigs.select(F.col("doc_id").alias("_b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(by_key(one), F.col("a") == F.col("_a")).join(by_key(two), F.col("b") == F.col("_b"))
    return both.selectExpr("a", "b", "na", "nb", f"{_full_bytes('sa', '|', 'sb')} as used", f"{_full_bytes('sa', '^', 'sb')} as apart")


def _most_apart(used: str | int, percent: int) -> str:
    """SQL for the most places in which sketches of a linked pair differ, of those that are used."""
    s = percent / 100
    return f"{1 - s} * {used} + {SLACK * math.sqrt(s * (1 - s))} * sqrt({used})"


def _likely(na: str, nb: str, apart: str, used: str, percent: int) -> str:
    """SQL for pairs that sizes and sketches don't rule out; cheaper conditions come first."""
    sizes = f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})"
    return f"{sizes} and {apart} <= {_most_apart(SKETCH, percent)} and {apart} <= {_most_apart(used, percent)}"


def _map(hashes: np.ndarray) -> list[int]:
    bits = np.zeros(MAP, np.uint8)
    bits[hashes >> np.uint64(64 - MAP.bit_length() + 1)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def compare(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, deltas: bool) -> DataFrame:
    """Of pairs a, b of ids (a written table): na, nb, common, linked (100 * common >= percent * union) on whole sets.

    With deltas also outside (what b has beside a), and maps of that (omap) and of what it lacks of a (lmap).
    """
    wanted = small(cut(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "wanted-ids"))
    texts = cut(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).join(wanted, F.col("id") == F.col("_id"), "left_semi").distinct(), "pair-texts")
    second = pairs.select("a", "b").join(by_key(texts.withColumnRenamed("text", "tb")), F.col("b") == F.col("id")).drop("id")
    both = second.join(by_key(texts.withColumnRenamed("text", "ta")), F.col("a") == F.col("id")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for whole in batches:
            for batch in byte_slices(whole, "tb", SLICE_BYTES):
                rows = []
                for ta, tb, y in zip(batch.column("ta"), batch.column("tb"), shingle_sets(batch.column("tb").to_pylist(), words)):
                    ta = ta.as_py()
                    if ta != last_text:
                        last_text, last = ta, next(shingle_sets([ta], words))
                    beside = np.setdiff1d(y, last, assume_unique=True)
                    common = len(y) - len(beside)
                    linked = common > 0 and 100 * common >= percent * (len(last) + len(y) - common)
                    more = (beside.view(np.int64).tolist(), _map(beside), _map(np.setdiff1d(last, y, assume_unique=True))) if deltas else (None,) * 3
                    rows.append((len(last), len(y), common, linked, *more))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["a", "b", "na", "nb", "common", "linked", "outside", "omap", "lmap"])

    return both.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, common bigint, linked boolean, outside array<bigint>, omap array<bigint>, lmap array<bigint>")


def _shared(own: str, other: str, size: str, other_size: str) -> str:
    """SQL for the most that two sets of these sizes share, by their maps."""
    alone = lambda x, y: " + ".join(f"bit_count({x}[{i}] & ~{y}[{i}])" for i in range(MAP // 64))
    return f"least({size} - ({alone(own, other)}), {other_size} - ({alone(other, own)}))"


#: SQL for the most that two rows near one leader, l and r, have in common.
MOST = f"l.common + r.common - l.na + {_shared('l.lmap', 'r.lmap', '(l.na - l.common)', '(r.na - r.common)')} + {_shared('l.omap', 'r.omap', '(l.nb - l.common)', '(r.nb - r.common)')}"


class _Links:
    """Links found so far, over representatives."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.docs, self.sigs, self.how = docs, sigs, (words, percent, id_col, text_col)
        self.links: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.parts: DataFrame | None = None

    def _add(self, name: str, old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else cut(old.unionByName(new), name)

    def _keep(self, compared: DataFrame) -> None:
        self.links = self._add("links", self.links, cut(compared.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "new-links"))
        self.tried = self._add("tried", self.tried, cut(compared.select(F.least("a", "b").alias("_ta"), F.greatest("a", "b").alias("_tb")).distinct(), "new-tried"))
        self.parts = components(self.links)

    def placed(self, rows: DataFrame, doc: str, out: str) -> DataFrame:
        """rows with the component of doc, itself if it has none yet."""
        parts = self.parts.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
        return rows.join(by_key(parts), F.col(doc) == F.col("_node"), "left").withColumn(out, F.coalesce("_part", doc)).drop("_node", "_part")

    def stars(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """members (key, doc_id; written) with their key's leader and state (linked, near or far), and the near comparisons."""
        size = members.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"))
        sized = members.join(by_key(size), F.col("key") == F.col("_key")).select("key", "doc_id", "n")
        score = sized.groupBy(F.col("doc_id").alias("_doc")).agg(F.sum("n").alias("score"))
        scored = sized.join(by_key(score), F.col("doc_id") == F.col("_doc")).select("key", "doc_id", "score")
        leader = scored.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct(F.col("score"), -F.col("doc_id"))).alias("top")).select("_key", (-F.col("top")["col2"]).alias("leader"))
        led = cut(members.join(by_key(leader), F.col("key") == F.col("_key")).filter("doc_id <> leader").select("key", "doc_id", "leader"), "led-members")
        pairs = led.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
        sketched = cut(_sketched(pairs, self.sigs), "star-sketches")
        near = cut(compare(cut(sketched.filter(f"used - apart >= {FAR} * used").select("a", "b"), "near-pairs"), self.docs, *self.how, deltas=True), "near-stars")
        self._keep(near)
        state = near.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "linked")
        led = led.join(by_key(state), (F.col("leader") == F.col("_a")) & (F.col("doc_id") == F.col("_b")), "left")
        kind = F.when(F.col("linked"), "linked").when(F.col("linked").isNotNull(), "near").otherwise("far")
        return cut(led.select("key", "doc_id", "leader", kind.alias("state")), "states"), near

    def far_pairs(self, states: DataFrame) -> DataFrame:
        """Far members of a key with others that aren't linked to its leader, where sketches allow a link."""
        own = self.sigs.select(F.col("doc_id").alias("_doc"), "n_shingles", "sketch")
        rows = self.placed(states.filter("state <> 'linked'"), "doc_id", "c").join(by_key(own), F.col("doc_id") == F.col("_doc")).select("key", "doc_id", "state", "c", "n_shingles", "sketch")
        rows = cut(rows, "apart-members")
        percent = self.how[1]
        likely = f"100 * least(l.n_shingles, r.n_shingles) >= {percent} * greatest(l.n_shingles, r.n_shingles) and {_bits_apart('l.sketch', 'r.sketch')} <= {_most_bits_apart(percent)}"
        where = F.expr(f"l.key = r.key and l.c <> r.c and (l.state <> 'far' or l.doc_id < r.doc_id) and {likely}")
        both = rows.alias("l").join(by_key(rows.filter("state = 'far'")).alias("r"), where)
        return both.select(F.least("l.doc_id", "r.doc_id").alias("a"), F.greatest("l.doc_id", "r.doc_id").alias("b"))

    def near_pairs(self, near: DataFrame) -> DataFrame:
        """Pairs of members near a leader, one of them not linked to it, that may have enough in common."""
        percent = self.how[1]
        enough = F.expr(f"l.c <> r.c and ({MOST}) * (100 + {percent}) >= {percent} * (l.nb + r.nb)")
        rows = cut(self.placed(near, "b", "c"), "placed-stars")
        wide = rows.drop("outside")
        apart = wide.filter("not linked")
        smaller = wide.filter("nb < na").alias("l").join(by_key(apart).alias("r"), (F.col("l.a") == F.col("r.a")) & enough)

        by_shingle = rows.select("a", "b", "c", "linked", F.explode("outside").alias("s")).withColumn("key", F.xxhash64("a", "s")).drop("s")
        mixed = by_shingle.groupBy(F.col("key").alias("_key")).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.bool_and("linked").alias("all")).filter("c0 <> c1 and not all").select("_key")
        held = by_shingle.join(by_key(mixed), F.col("key") == F.col("_key")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "key")
        held = cut(held.join(by_key(wide), (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))).drop("_a", "_b"), "outside-members")
        sharing = held.alias("l").join(by_key(held.filter("not linked")).alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.a") == F.col("r.a")) & enough)
        pair = lambda df: df.select(F.least("l.b", "r.b").alias("a"), F.greatest("l.b", "r.b").alias("b"))
        return pair(smaller).unionByName(pair(sharing))

    def meet(self, pairs: DataFrame) -> None:
        """Compares pairs that haven't been, where sketches allow a link."""
        fresh = cut(pairs.distinct().join(by_key(self.tried), (F.col("a") == F.col("_ta")) & (F.col("b") == F.col("_tb")), "left_anti"), "pairs")
        fresh = cut(_sketched(fresh, self.sigs).filter(_likely("na", "nb", "apart", "used", self.how[1])).select("a", "b"), "likely-pairs")
        if not fresh.isEmpty():
            self._keep(cut(compare(fresh, self.docs, *self.how, deltas=False), "compared"))

    def resolve(self, members: DataFrame) -> None:
        states, near = self.stars(members)
        self.meet(self.far_pairs(states).unionByName(self.near_pairs(near)))


def filter_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of those with the least id one whose text's hash is least. Null ids all stay."""
    found = cut(near_duplicates(docs, words, percent, id_col, text_col), "components")
    own_id, own_hash, number = fresh(docs, "own_id", "own_hash", "number")
    out = found.filter("not kept").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    kept = docs.join(by_key(out), (docs[id_col] == F.col(own_id)) & (text_hash == F.col(own_hash)), "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    order = Window.partitionBy(kept[id_col]).orderBy(F.xxhash64(F.coalesce(kept[text_col], F.lit(""))))
    return kept.withColumn(number, F.row_number().over(order)).filter((F.col(number) == 1) | F.col(id_col).isNull()).drop(number)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) and text_hash of every row.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Equal sets are always
    linked. Rows that share an id share its links. A null id links with nothing: its component is null and it is kept. An
    empty table gives no rows; other columns are not read.
    """
    sigs = cut(signatures(docs, words, id_col, text_col), "signatures")
    named = sigs.filter("set_hash is not null and doc_id is not null")
    one = F.min_by(F.struct("n_shingles", "bands", "sketch"), "doc_id").alias("one")  # equal sets have equal ones
    classes = cut(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), one).select("set_hash", "rep", "n", "one.*"), "set-classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "bands", "sketch")

    keys = _keys(reps.select("doc_id", "bands"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least <> most").select(F.col("key").alias("_key"))
    links = _Links(docs, reps, words, percent, id_col, text_col)
    links.resolve(cut(keys.join(by_key(buckets), F.col("key") == F.col("_key")).select("key", "doc_id"), "bucket-members"))
    found = links.parts

    nodes = cut(classes.join(by_key(found), F.col("rep") == F.col("node"), "left").select(F.col("set_hash").alias("_hash"), F.coalesce("component", "rep").alias("component"), "n"), "set-components")
    rows = sigs.select("doc_id", "n_shingles", "set_hash", "text_hash")
    # sets of very many rows meet their component by a broadcast, rows without a set meet none, so no task gets all of either
    often = small(nodes.filter(F.col("n") > OFTEN).select(F.col("_hash").alias("_often"), F.col("component").alias("often")))
    rows = cut(rows.join(often, F.col("set_hash") == F.col("_often"), "left").drop("_often"), "often-components")
    done = rows.filter("set_hash is null or often is not null").withColumnRenamed("often", "component")
    rest = rows.filter("set_hash is not null and often is null").drop("often").join(by_key(nodes.drop("n")), F.col("set_hash") == F.col("_hash"), "left").drop("_hash")
    out = done.unionByName(rest)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
