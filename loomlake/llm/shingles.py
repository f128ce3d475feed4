"""Word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .rolling import mix

#: Blank, tab, LF, VT, FF and CR end a word.
BREAK = np.zeros(256, bool)
BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BLOCK_BYTES = 1 << 20
#: Words of more bytes are hashed by blake2b; shorter ones by eight bytes at a time, each step mixed over all bits.
LONG_WORD = 32
_KEY = b"loomlake shingles"
_START = np.uint64(0x6A09E667F3BCC909)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashed(block: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each word block[b:e]. No arithmetic of substrings is in it that made-up words could cancel."""
    size = e - b
    padded = np.concatenate((block, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = mix(size.astype(np.uint64) ^ _START)
    for at in range(0, LONG_WORD, 8):
        some = np.flatnonzero((size > at) & (size <= LONG_WORD))
        if not len(some):
            break
        lane = eights[b[some] + at].view("<u8").ravel() & _MASKS[np.minimum(size[some] - at, 8)]
        out[some] = mix((out[some] ^ lane) * np.uint64(0x9FB21C651E98DF25) + np.uint64(at + 1))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(block[b[i] : e[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return out


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash; long data go by blocks that end with a break, or grow until one ends so."""
    begins, hashes, at = [], [], 0
    while at < len(data):
        size = BLOCK_BYTES
        while True:
            block = np.frombuffer(data, np.uint8, min(size, len(data) - at), at)
            last = at + len(block) == len(data)
            stop = len(block) if last else int(len(block) - np.argmax(BREAK[block[::-1]])) if BREAK[block].any() else 0
            if stop:
                break
            size *= 2
        block = block[:stop]
        word = ~BREAK[block]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        b, e = edge[::2], edge[1::2]
        if len(b):
            begins.append(b + at)
            hashes.append(_hashed(block, b, e))
        at += stop
    return (np.concatenate(begins), np.concatenate(hashes)) if begins else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of its distinct shingles of so many words, A-Z in lower case.

    A text with fewer words has one shingle, all of them; none without words.
    """
    coded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    offsets = np.cumsum([0, *(len(x) + 1 for x in coded)])
    begins, hashes = word_hashes(b"\n".join(coded))
    edges = np.searchsorted(begins, offsets)
    h = hashes.copy()
    for _ in range(words - 1):  # h[i] goes on to be the hash of words i, i + 1, ...
        h = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[len(hashes) - len(h) + 1 :]) if len(h) else h
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= words:
            yield np.unique(h[a : b - words + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for y in hashes[a:b]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + y)
            yield x
        else:
            yield np.zeros(0, np.uint64)
