"""One Spark session for all tests, and image folders written with zlib."""

from __future__ import annotations

import os
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_png(path: Path, rgb: np.ndarray) -> None:
    height, width, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def pattern(seed: int, size: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A random blocky pattern in two colourings."""
    rng = np.random.default_rng(seed)
    cells = np.kron(rng.integers(0, 4, (8, 8)), np.ones((size // 8, size // 8), int))
    shades = np.array([30, 90, 150, 220])
    one = np.stack([shades[cells], shades[cells] // 2, shades[cells] // 3], axis=2)
    return one, one[:, :, ::-1]


@pytest.fixture
def image_folder(tmp_path) -> Path:
    """fam{n}_orig, _recolor, _rot90 for three families, a broken image, and a text file."""
    folder = tmp_path / "pictures"
    (folder / "deep").mkdir(parents=True)
    for n in range(3):
        plain, other = pattern(n)
        write_png(folder / f"fam{n}_orig.png", plain)
        write_png(folder / f"fam{n}_recolor.png", other)
        write_png(folder / "deep" / f"fam{n}_rot90.PNG", np.rot90(plain))
    (folder / "bad.png").write_bytes(b"no image")
    (folder / "note.txt").write_text("no image either")
    return folder
