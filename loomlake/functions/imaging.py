"""Signatures of decoded images with numpy: grey resampling, hashes, colour histograms, a structural embedding."""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np

from .pixels import cosine_matrix, variant_places

LANCZOS = 3
GRID, ORIENTATIONS, CELLS = 16, 8, 4
#: Bins of hue, saturation and value.
COLOR_BINS = (8, 3, 3)
ALGORITHMS = ("phash", "dhash", "ahash", "whash")


def rgb_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Rows of red, green, blue from the image source's bytes, which are grey or blue first; alpha is dropped."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, 2::-1]


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[:, :, i].astype(np.int64) for i in range(3))
    return (r * 299 + g * 587 + b * 114 + 500) // 1000


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < LANCZOS, np.sinc(x) * np.sinc(x / LANCZOS), 0.0)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


@cache
def resample_weights(old: int, new: int, kernel: str = "lanczos") -> np.ndarray:
    """A row for each new pixel: the weights of old pixels under a window as wide as a shrink needs."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * old / new
    w = {"lanczos": _lanczos, "cubic": _cubic}[kernel]((np.arange(old)[None, :] + 0.5 - centre) / scale)
    return w / w.sum(1, keepdims=True)


@cache
def area_weights(old: int, new: int) -> np.ndarray:
    """A row for each new pixel: how much of it each old pixel covers."""
    begin = np.arange(new)[:, None] * old / new
    at = np.arange(old)[None, :]
    covered = np.clip(np.minimum(at + 1, begin + old / new) - np.maximum(at, begin), 0, None)
    return covered / covered.sum(1, keepdims=True)


def averaged(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.rint(area_weights(grey.shape[0], height) @ grey @ area_weights(grey.shape[1], width).T)


def resized(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    out = resample_weights(grey.shape[0], height) @ grey @ resample_weights(grey.shape[1], width).T
    return np.clip(np.rint(out), 0, 255)


def _bits(over: np.ndarray) -> list[int]:
    """Words of 64 bits, first bit highest, as signed numbers."""
    flat = over.ravel().astype(np.uint8)
    flat = np.concatenate((np.zeros(-len(flat) % 64, np.uint8), flat))
    return np.packbits(flat).view(">u8").astype(np.uint64).view(np.int64).tolist()


def image_hash(rgb: np.ndarray, algorithm: str = "phash", size: int = 8, grey: np.ndarray | None = None) -> list[int]:
    """Words of size * size bits. grey is the image's luma, if it is known."""
    grey = luma(rgb).astype(float) if grey is None else grey
    if algorithm == "ahash":
        px = resized(grey, size, size)
        return _bits(px > px.mean())
    if algorithm == "dhash":
        px = resized(grey, size + 1, size)
        return _bits(px[:, 1:] > px[:, :-1])
    if algorithm == "phash":
        n = 4 * size
        m = cosine_matrix(n)[:size]
        low = m @ resized(grey, n, n) @ m.T
        return _bits(low > np.median(low))
    if algorithm == "whash":
        n = 4 * (1 << (size - 1).bit_length())
        px = resized(grey, n, n) / 255.0
        low = px.reshape(n // 4, 4, n // 4, 4).mean(axis=(1, 3))[:size, :size]
        return _bits(low > np.median(low))
    raise ValueError(f"unknown hash algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue from 0 to 179, saturation and value from 0 to 255."""
    r, g, b = (np.ascontiguousarray(rgb[:, :, i]).astype(np.float32) for i in range(3))
    top = np.maximum(np.maximum(r, g), b)
    span = top - np.minimum(np.minimum(r, g), b)
    some = np.maximum(span, np.float32(1e-9))
    hue = np.where(top == r, g - b, np.where(top == g, b - r, r - g)) / some
    hue += np.where(top == r, 0, np.where(top == g, 2, 4)).astype(np.float32)
    hue = np.where(span > 0, np.rint(hue * 30).astype(np.int32) % 180, 0)
    return hue, np.rint(255 * span / np.maximum(top, 1)).astype(np.int32), top.astype(np.int32)


def color_histogram(rgb: np.ndarray) -> np.ndarray:
    h, s, v = hsv(rgb)
    a, b, c = COLOR_BINS
    bins = np.bincount(((h * a // 180) * b * c + (s * b // 256) * c + v * c // 256).ravel(), minlength=a * b * c).astype(np.float32)
    return bins / max(bins.sum(), 1)


def embedding(rgb: np.ndarray, color: np.ndarray | None = None) -> np.ndarray:
    """Standardised grey grid, orientations of edges by cell, colours: 256 + 128 + 72 numbers."""
    grey = luma(rgb).astype(float)
    grid = averaged(grey, GRID, GRID).ravel()
    grid = (grid - grid.mean()) / (grid.std() + 1e-6)
    px = averaged(grey, 64, 64)
    edge = np.pad(px, 1, mode="reflect")
    smooth = lambda m, axis: np.take(m, range(0, 64), axis) + 2 * np.take(m, range(1, 65), axis) + np.take(m, range(2, 66), axis)
    dx = smooth(edge[:, 2:] - edge[:, :-2], 0)
    dy = smooth(edge[2:] - edge[:-2], 1)
    turn = (np.degrees(np.arctan2(dy, dx)) % 360) * ORIENTATIONS / 360
    side = 64 // CELLS
    cell = (np.arange(64)[:, None] // side) * CELLS + np.arange(64)[None, :] // side
    found = np.bincount((cell * ORIENTATIONS + np.minimum(turn.astype(int), ORIENTATIONS - 1)).ravel(), weights=np.hypot(dx, dy).ravel(), minlength=CELLS * CELLS * ORIENTATIONS)
    length = np.linalg.norm(found)
    return np.concatenate((grid, found / length if length > 0 else found, color_histogram(rgb) if color is None else color)).astype(np.float32)


def turned(rgb: np.ndarray) -> list[np.ndarray]:
    """The eight variants: each quarter turn, and it mirrored; as variant_places orders them."""
    assert len(variant_places()) == 8
    return [v for k in range(4) for t in [np.rot90(rgb, k)] for v in (t, np.fliplr(t))]


def thumbnail(rgb: np.ndarray, most: int = 256) -> tuple[int, int, bytes]:
    """Width, height and rows of red, green, blue, with no side over most; never larger than the image."""
    height, width = rgb.shape[:2]
    scale = min(1.0, most / max(height, width))
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    px = np.stack([resized(rgb[:, :, i].astype(float), w, h) for i in range(3)], axis=2) if scale < 1 else rgb
    return w, h, np.ascontiguousarray(px, np.uint8).tobytes()


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A PNG file of rows of red, green, blue."""
    lines = np.zeros((height, 1 + 3 * width), np.uint8)
    lines[:, 1:] = np.frombuffer(rgb, np.uint8).reshape(height, 3 * width)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")
