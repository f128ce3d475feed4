"""A library of images: versioned Parquet tables, re-indexed by what changed, searched by batches of query images."""

from __future__ import annotations

import logging
import re
import threading
import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedders import Embedder, load
from ..functions.paths import thumb_name
from ..operators import catalog as C
from ..operators import search as S
from ..streaming import watch as W
from . import images as I
from .config import BACKENDS, Config

TABLES = {"images": C.IMAGES, "vectors": C.VECTORS, "settings": C.SETTINGS}
THUMBS = "key string, name string, width int, height int, png binary"
KEPT_VERSIONS = 2
SCHEMA_VERSION = 1
#: Files that are decoded by name in one go, and the part of all files from which on whole folders are read instead.
GROUP_FILES, WHOLE_PART = 10_000, 0.25

log = logging.getLogger(__name__)


class Library:
    """Tables below base. A write makes a new version folder; the highest complete one counts, so readers never see half a write.

    embedder makes the vectors of images and of queries; without one it is the model that the settings name, or the
    structural embedder. Thumbnails are a table of PNG files, to which each run adds those that it made.
    """

    def __init__(self, spark: SparkSession, base: str, config: Config | None = None, embedder: Embedder | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        held = C.json_setting(self.table("settings"), "meta", "schema_version")
        if held not in (None, SCHEMA_VERSION):
            raise ValueError(f"tables of version {held} at {base}; this is for {SCHEMA_VERSION}")
        self._busy = threading.Lock()
        self._embedder = embedder
        self.config = config or Config.from_json(C.setting(self.table("settings"), "settings", "config"))
        if self.config.backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.config.backend!r}; known: {', '.join(BACKENDS)}")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        path, fs = self._folder(name)
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        held = self.versions(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.base}/{name}/v{held[-1]}") if held else self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, df: DataFrame) -> None:
        held = self.versions(name)
        version = held[-1] + 1 if held else 1
        cast = df.select(*(F.col(c).cast(kind) for c, kind in (x.split(" ") for x in TABLES[name].split(", "))))
        cast.write.mode("overwrite").parquet(f"{self.base}/{name}/v{version}")
        path, fs = self._folder(name)
        for old in held[: -KEPT_VERSIONS + 1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v{old}"), True)

    def save_config(self) -> None:
        row = self.spark.createDataFrame([("settings", "config", self.config.to_json())], C.SETTINGS)
        self.write("settings", C.upsert_settings(self.table("settings"), row))

    @property
    def embedder(self) -> Embedder:
        """Opened when it is first needed."""
        if self._embedder is None:
            self._embedder = load(self.config.model_path)
        return self._embedder

    def _signature_settings(self) -> str:
        return f"hash_size={self.config.hash_size};embedder={self.embedder.name}"

    def _staged(self, df: DataFrame, place: str, name: str, mode: str = "overwrite") -> DataFrame:
        """df as a written table of this run."""
        df.write.mode(mode).parquet(f"{place}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{place}/{name}")

    def _signatures(self, queue: DataFrame, seen: int, roots: list[str], place: str, tell: Callable[[str, int, int], None]) -> tuple[DataFrame, int]:
        """Signatures of the queued files, and how many files were decoded for them.

        Files are decoded by name, GROUP_FILES at a time, so what hasn't changed isn't read; where most have, folders are read whole.
        """
        total = queue.count()
        made = lambda files: I.extract(files, self.config.hash_size, self.config.thumb_size, self.embedder)
        if total >= max(GROUP_FILES, WHOLE_PART * seen):
            out = self._staged(made(I.decode(self.spark, roots, folders=True).join(queue.select("path"), "path", "left_semi")), place, "signatures")
            return out, seen
        groups, done, out = -(-total // GROUP_FILES), 0, None
        for g in range(groups):
            paths = [r.path for r in queue.filter(F.pmod(F.xxhash64("path"), F.lit(groups)) == g).select("path").collect()]  # about GROUP_FILES names
            if paths:
                out = self._staged(made(I.decode(self.spark, paths)), place, "signatures", "append")
            done += len(paths)
            tell("process", done, total)
        return out, done

    def reindex(self, mark_missing: bool = True, progress: Callable[[dict], object] | None = None) -> dict[str, int]:
        """Brings the catalog up to date with the folders; counts of new, changed, missing, unchanged, errors and decoded files.

        Keys that aren't ok are tried again when they are seen; other settings for signatures make every seen key
        changed. Only keys below roots that could be listed are marked missing. progress gets phase (process, finalize,
        done), done, total and rate, in images a second.
        """
        config, began = self.config, time.time()

        def tell(phase: str, done: int, total: int) -> None:
            state = {"phase": phase, "done": done, "total": total, "rate": done / max(time.time() - began, 1e-9)}
            log.info("%(phase)s: %(done)d of %(total)d, %(rate).1f a second", state)
            if progress:
                progress(state)

        place = f"{self.base}/work-{uuid.uuid4().hex}"
        try:
            return self._reindex(config, place, mark_missing, tell, began)
        finally:
            path, fs = self._folder(place.removeprefix(f"{self.base}/"))
            fs.delete(path, True)

    def _reindex(self, config: Config, place: str, mark_missing: bool, tell: Callable[[str, int, int], None], began: float) -> dict[str, int]:
        roots = I.reachable(self.spark, config.library_roots)
        seen = self._staged(I.scan(self.spark, roots, config.extensions), place, "seen")
        old = self.table("images")
        below = F.lit(False)
        for root in roots:
            below = below | F.col("key").startswith(root.removeprefix("file://").rstrip("/") + "/")
        changes = self._staged(C.diff(seen, old, retry=True).filter((F.col("change") != "missing") | below), place, "changes")
        same = C.setting(self.table("settings"), "meta", "signatures") in (None, self._signature_settings())
        counts = C.diff_counts(changes).first().asDict()
        queue = C.to_process(changes) if same else changes.filter("change <> 'missing'").select("key")
        if config.uses_embedding():
            queue = C.with_queue(queue, C.keys_missing_vectors(old, self.table("vectors")).join(seen.select("key"), "key", "left_semi"))
        queue = self._staged(queue.distinct().join(seen, "key"), place, "queue")
        new, vectors = old, self.table("vectors")
        if mark_missing:
            gone = changes.filter("change = 'missing'").join(old.filter(F.col("status") != C.MISSING).select("key"), "key", "left_semi")
            new = C.mark_status(new, gone, C.MISSING)
        counts["errors"] = counts["decoded"] = 0
        if not queue.isEmpty():
            made, counts["decoded"] = self._signatures(queue, seen.count(), roots, place, tell)
            tell("finalize", counts["decoded"], counts["decoded"])
            facts = made.join(queue.select("key", "mtime", "size"), "key")
            good = facts.filter("status = 'ok'").select("key", "path", "mtime", "size", "width", "height", "phash", "dhash", "ahash", "whash", "color", thumb_name(F.col("key")).alias("thumb"), "status", "error", F.current_timestamp().alias("indexed_at"))
            bad = facts.filter("status = 'error'").select("key", "path", "mtime", "size", "status", "error")
            counts["errors"] = bad.count()
            number = (self.versions("images") or [0])[-1] + 1
            thumbs = made.filter("status = 'ok'").select("key", thumb_name(F.col("key")).alias("name"), F.col("thumb_width").alias("width"), F.col("thumb_height").alias("height"), F.col("thumb_png").alias("png"))
            thumbs.write.mode("overwrite").parquet(f"{self.base}/thumbs/version={number}")
            new = C.with_ids(C.upsert(C.upsert(new, good), bad))
            self.write("images", new)
            ids = self.table("images").select(F.col("id").alias("image_id"), "key")
            put = made.filter("status = 'ok'").join(ids, "key").select("image_id", "vec", F.lit(self.embedder.name).alias("embedder"), F.size("vec").alias("dim"))
            self.write("vectors", C.upsert_vectors(vectors, put))
        elif counts["n_missing"]:
            self.write("images", new)
        meta = self.spark.createDataFrame([("meta", "last_index_at", str(began)), ("meta", "signatures", self._signature_settings()), ("meta", "schema_version", str(SCHEMA_VERSION))], C.SETTINGS)
        self.write("settings", C.upsert_settings(self.table("settings"), meta))
        tell("done", counts["decoded"], counts["decoded"])
        return {k.removeprefix("n_"): v for k, v in counts.items()}

    def reindex_unless_busy(self) -> dict[str, int] | None:
        """reindex, or nothing if it is running already."""
        if not self._busy.acquire(blocking=False):
            return None
        try:
            return self.reindex()
        finally:
            self._busy.release()

    def watch(self, checkpoint: str, every: str | None = W.DEBOUNCE) -> list:
        """A stream for each folder; what it brings is followed by a re-index. stop() on each ends it."""
        roots = I.reachable(self.spark, self.config.library_roots)
        note = lambda _: self.reindex_unless_busy()
        return [W.watch(W.changes(self.spark, root, self.config.extensions), note, f"{checkpoint.rstrip('/')}/{i}", every) for i, root in enumerate(roots)]

    def rescan(self, stop: threading.Event) -> threading.Thread | None:
        """A thread that re-indexes every rescan_interval_sec until stop is set; none if that is 0. It sees files that went, which streams don't report."""
        wait = self.config.rescan_interval_sec
        if wait <= 0:
            return None

        def run() -> None:
            while not stop.wait(wait):
                self.reindex_unless_busy()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def thumbnails(self) -> DataFrame:
        """key, name, width, height, png: the last thumbnail of each key."""
        path, fs = self._folder("thumbs")
        if not fs.exists(path):
            return self.spark.createDataFrame([], THUMBS)
        rows = self.spark.read.schema(f"{THUMBS}, version int").parquet(f"{self.base}/thumbs")
        return C.last_of(rows, ["key"], "version").select(*(c.split(" ")[0] for c in THUMBS.split(", ")))

    def thumbnail(self, name: str) -> bytes | None:
        """The PNG file that thumb_path names."""
        row = self.thumbnails().filter(F.col("name") == name).select("png").first()
        return None if row is None else bytes(row.png)

    def purge_missing(self) -> None:
        """Rows of missing files go, with their vectors."""
        held, vectors = C.delete_keys(self.table("images"), self.table("vectors"), self.table("images").filter(F.col("status") == C.MISSING).select("key"))
        self.write("vectors", vectors)
        self.write("images", held)

    def stats(self) -> dict[str, int]:
        return C.stats(self.table("images")).first().asDict() | {"vectors": self.table("vectors").count()}

    def search(self, paths: list[str], k: int | None = None, alpha: float | None = None) -> DataFrame:
        """Results of each query image, whose query_id is its place in paths."""
        if not paths:
            raise ValueError("no query image given")
        order = self.spark.createDataFrame([(i, re.sub("^file:/*", "/", p)) for i, p in enumerate(paths)], "query_id bigint, path string")
        return self._search(I.decode(self.spark, paths).join(F.broadcast(order), "path"), k, alpha)

    def search_images(self, images: list[np.ndarray], k: int | None = None, alpha: float | None = None) -> DataFrame:
        """As search, for images given as rows of red, green, blue."""
        if not images:
            raise ValueError("no query image given")
        return self._search(I.pixels(self.spark, images), k, alpha)

    def _search(self, decoded: DataFrame, k: int | None, alpha: float | None) -> DataFrame:
        c = self.config
        self._words()
        k = c.max_results if k is None else k
        queries = I.query_variants(decoded, c.hash_algo, c.hash_size, c.tta, self.embedder).persist()  # few rows for each query image, read several times
        held = self.table("images").filter(F.col("status") == C.OK).withColumnRenamed("id", "image_id")
        one = lambda name: F.get(F.col(name), F.lit(0))
        hashed = held.select("image_id", one(c.hash_algo).alias("h"))
        asked = queries.select("query_id", "variant", one("qh").alias("qh"), "vec")
        vectors = self.table("vectors").filter(F.col("embedder") == self.embedder.name).join(held.select("image_id"), "image_id", "left_semi")
        if c.backend == "hash":
            hits = S.by_hash(asked, hashed, k, c.hash_max_distance)
        elif c.backend == "embedding":
            hits = S.by_vector(asked, vectors, k, c.rerank_candidates)
        else:
            hits = S.by_both(asked, hashed, vectors, k, c.hash_max_distance)
        shown = held.select("image_id", "path", "thumb", "status", "color", one("phash").alias("phash"), "width", "height")
        return S.finalize(hits, shown, queries.select("query_id", "variant", "color", one("qph").alias("qph")), k, c.color_alpha if alpha is None else alpha, c.duplicate_hamming, c.score_threshold)

    def _words(self) -> None:
        if self.config.hash_size != 8:
            raise ValueError("searches and duplicates take hashes of 64 bits, hash_size 8")

    def duplicates(self, distance: int | None = None) -> DataFrame:
        """Pairs of ok images whose perceptual hashes are within the distance."""
        from ..operators.hamming import self_join

        self._words()
        held = self.table("images").filter(F.col("status") == C.OK).select(F.col("id").alias("image_id"), F.get("phash", F.lit(0)).alias("h"))
        return self_join(held, self.config.duplicate_hamming if distance is None else distance)
