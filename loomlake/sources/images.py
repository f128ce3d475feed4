"""Image folders as DataFrames: listings, and signatures extracted with one decode of each image."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imaging
from ..functions.embedders import Embedder, Structural
from ..functions.paths import EXTENSIONS, has_extension, normalize_key
from ..operators.catalog import first_of_key

log = logging.getLogger(__name__)

LISTING = "path string, key string, mtime double, size bigint, root int"
SIGNATURES = (
    "key string, path string, width int, height int, phash array<bigint>, dhash array<bigint>, ahash array<bigint>, whash array<bigint>, "
    "color array<float>, vec array<float>, thumb_width int, thumb_height int, thumb_png binary, status string, error string"
)
QUERIES = "query_id bigint, variant int, qh array<bigint>, qph array<bigint>, vec array<float>, color array<float>"
#: Images that are embedded together.
EMBED_BATCH = 32
#: Pixels over which an image is an error row.
MOST_PIXELS = 200_000_000


def _plain(path):
    return F.regexp_replace(path, "^file:/*", "/")


def reachable(spark: SparkSession, roots: list[str]) -> list[str]:
    """The roots that can be listed; others are logged. Only keys below these may be found missing."""
    out = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        try:
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                out.append(root)
                continue
        except Exception as e:  # a file system that does not answer
            log.warning("cannot list %s: %s", root, e)
        log.warning("skipped %s", root)
    return out


def scan(spark: SparkSession, roots: list[str], extensions=EXTENSIONS) -> DataFrame:
    """path, key, mtime (seconds), size, root of every image below the roots; a key below two roots is the first one's."""
    found = None
    for i, root in enumerate(reachable(spark, roots)):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
        path = _plain(F.col("path"))
        rows = files.filter(has_extension(F.col("path"), extensions)).select(path.alias("path"), normalize_key(path).alias("key"), (F.unix_millis("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size"), F.lit(i).alias("root"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], LISTING)
    return first_of_key(found, "key", "root", "path")


def _literal(path: str) -> str:
    """The path with what file systems take for patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def decode(spark: SparkSession, paths: list[str], folders: bool = False) -> DataFrame:
    """path, and the image's height, width, nChannels and data, of these files, or of all below these folders; a file that isn't one has a height of -1."""
    source = spark.read.format("image").option("dropInvalid", False)
    files = source.option("recursiveFileLookup", True).load(paths) if folders else source.load([_literal(p) for p in paths])
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # a URI, unlike listings' paths
    return files.select(_plain(origin).alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def pixels(spark: SparkSession, images: list[np.ndarray]) -> DataFrame:
    """query_id and decode's columns of images given as rows of red, green, blue; query_id is the place."""
    rows = [(i, *x.shape[:2], 3, np.ascontiguousarray(x[:, :, ::-1], np.uint8).tobytes()) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "query_id bigint, height int, width int, nChannels int, data binary")


def _in_batches(rows, embedder: Embedder) -> Iterator[tuple[list, list[np.ndarray | None], list[np.ndarray | None], list[str | None]]]:
    """Rows by EMBED_BATCH, each with its pixels, vector and error; one that can't be decoded or embedded has an error only."""
    rows = list(rows)
    for at in range(0, len(rows), EMBED_BATCH):
        some = rows[at : at + EMBED_BATCH]
        held: list[np.ndarray | None] = []
        errors: list[str | None] = []
        for r in some:
            whole = r.height > 0 and r.height * r.width <= MOST_PIXELS
            held.append(imaging.rgb_of(r.height, r.width, r.nChannels, r.data) if whole else None)
            errors.append(None if whole else "cannot be decoded")
        there = [i for i, x in enumerate(held) if x is not None]
        vectors: list[np.ndarray | None] = [None] * len(some)
        try:
            for i, v in zip(there, embedder.embed_batch([held[i] for i in there]) if there else ()):
                vectors[i] = v
        except Exception:  # find the image that it is
            for i in there:
                try:
                    vectors[i] = embedder.embed_batch([held[i]])[0]
                except Exception as e:
                    errors[i] = str(e)[:500]
        yield some, held, vectors, errors


def extract(images: DataFrame, hash_size: int = 8, thumb: int = 256, embedder: Embedder | None = None) -> DataFrame:
    """All signatures of each decoded image, and its thumbnail; one that cannot be decoded becomes a row with status error."""
    embedder = embedder or Structural()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SIGNATURES.split(", ")]
        for batch in batches:
            for some, held, vectors, errors in _in_batches(batch.itertuples(), embedder):
                rows = []
                for r, rgb, vec, error in zip(some, held, vectors, errors):
                    row = dict.fromkeys(names) | {"key": r.key, "path": r.path, "status": "error", "error": error}
                    if error is None:
                        try:
                            w, h, px = imaging.thumbnail(rgb, thumb)
                            grey, color = imaging.luma(rgb).astype(float), imaging.color_histogram(rgb)
                            row |= {a: imaging.image_hash(rgb, a, hash_size, grey) for a in imaging.ALGORITHMS}
                            row |= {"width": r.width, "height": r.height, "color": color.tolist(), "vec": np.asarray(vec, float).tolist(), "thumb_width": w, "thumb_height": h, "thumb_png": imaging.png(w, h, px), "status": "ok"}
                        except Exception as e:  # one bad image must not end the run
                            row["error"] = str(e)[:500]
                    rows.append(row)
                yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("width", "height", "thumb_width", "thumb_height")})

    return images.select(normalize_key(F.col("path")).alias("key"), "path", "height", "width", "nChannels", "data").mapInPandas(run, SIGNATURES)


def query_variants(images: DataFrame, algorithm: str = "phash", hash_size: int = 8, tta: bool = True, embedder: Embedder | None = None) -> DataFrame:
    """query_id, variant, qh, qph, vec and, for variant 0, color: eight rows for each decoded query image, or one without tta.

    images: query_id and decode's columns.
    """
    embedder = embedder or Structural()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.height <= 0:
                    continue
                rgb = imaging.rgb_of(r.height, r.width, r.nChannels, r.data)
                color = imaging.color_histogram(rgb)  # turns leave it as it is
                turns = [np.ascontiguousarray(v) for v in (imaging.turned(rgb) if tta else [rgb])]
                for i, (v, vec) in enumerate(zip(turns, embedder.embed_batch(turns))):
                    rows.append((r.query_id, i, imaging.image_hash(v, algorithm, hash_size), imaging.image_hash(v, "phash", hash_size), np.asarray(vec, float).tolist(), color.tolist() if i == 0 else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in QUERIES.split(", ")])

    return images.select("query_id", "height", "width", "nChannels", "data").mapInPandas(run, QUERIES)
