"""Token ids and counts of whole texts, as a tokenizer's library gives them.

Byte-pair encoding never merges across pre-tokens, and both splitting rules used here end a pre-token before any run of
white space that follows another character. So a text is split there, the distinct pieces of a batch are encoded by the
library in batches balanced by bytes, and the pieces' results are added up (or joined) in order. A piece stays whole
where white space other than blank, tab, CR and LF precedes, as libraries differ over what else is white space. Long
pieces without white space are split between a plain letter and a following digit or mark, which ends a pre-token too;
no special token holds such a place.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space to Python besides blank, tab, CR and LF.
_RARE = "\x0b\x0c\x1c-\x1f\x85\xa0  -     　"
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[ \t\r\n.,;:!?*$%&#()\"]|$)"
#: White space goes with the piece after it; letters end a piece before white space and common marks.
WITH_SPACE = re.compile(rf"\s*{_LETTERS}|\s*\S+(?:[{_RARE}]\s*\S*)*|\s+")
#: White space between pieces is dropped, as the tokenizer does.
WITHOUT_SPACE = re.compile(rf"{_LETTERS}|[^ \t\r\n]+")
_INSIDE = re.compile(r"(?<=[A-Za-z぀-ヿ一-鿿가-힣])(?=[0-9,.;:!?()。，、！？])")

LONG_PIECE = 4096
TOGETHER = 64
BATCH_BYTES = 1 << 20
CACHE_PIECES = 200_000
#: Words kept as arrays, some twenty bytes each.
CACHE_WORDS = 500_000
CACHE_PIECE_CHARS = 48


def _short(piece: str) -> list[str]:
    """A long piece, cut at safe places into parts of LONG_PIECE characters or more."""
    out, begin = [], 0
    for m in _INSIDE.finditer(piece):
        if m.start() - begin >= LONG_PIECE:
            out.append(piece[begin : m.start()])
            begin = m.start()
    return [*out, piece[begin:]]


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, which composition leaves alone and lower case maps one to one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pieces:
    """Encodes texts by their distinct pieces; what each piece gives is kept while there are not too many."""

    def __init__(self, path: str, lengths_only: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        settings = json.loads(self.library.to_str())
        self.kept_space = '"use_regex": true' in json.dumps(settings)
        self.lowers = '"type": "Lowercase"' in json.dumps(settings["normalizer"])
        suffix = settings["model"].get("end_of_word_suffix")
        self.ends = {i for token, i in self.library.get_vocab(with_added_tokens=False).items() if suffix and token.endswith(suffix)}
        self.split = (WITH_SPACE if self.kept_space else WITHOUT_SPACE).findall
        self.value = (lambda ids: len(ids)) if lengths_only else (lambda ids: array("I", ids).tobytes())
        self.known: dict[str, int | bytes] = {}
        self.words = Words(self)

    def lowered(self, text: str) -> str:
        """In lower case, if the tokenizer does that, no special token can arise, and all lower it alike."""
        return text.lower() if self.lowers and "<|" not in text and _latin(text) else text

    def pieces(self, text: str, lowered: bool = False) -> list[str]:
        text = text if lowered else self.lowered(text)
        found = self.split(text)
        if len(text) > LONG_PIECE and max(map(len, found), default=0) > 2 * LONG_PIECE:
            return [x for piece in found for x in (_short(piece) if len(piece) > 2 * LONG_PIECE else [piece])]
        return found

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters only are encoded TOGETHER, with blanks between; a word ends with an id that says so."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for at in range(0, len(groups), BATCH_BYTES // 1024):
            some = groups[at : at + BATCH_BYTES // 1024]
            for group, e in zip(some, self.library.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
                begin, word, ids = 0, iter(group), e.ids
                for i, x in enumerate(ids):
                    if x in self.ends:
                        self.known[next(word)] = self.value(ids[begin : i + 1])
                        begin = i + 1
                if next(word, None) is not None or begin != len(ids):
                    raise ValueError("words and ids do not match")

    def _encode(self, pieces: list[str]) -> None:
        if self.ends:
            words = [p for p in pieces if len(p) <= CACHE_PIECE_CHARS and p.isalpha() and _latin(p)]
            self._encode_words(words)
            pieces = [p for p in pieces if p not in self.known]
        pieces.sort(key=len)
        begin = total = 0
        for i, piece in enumerate([*pieces, None]):
            if piece is None or (i > begin and total + len(piece) > BATCH_BYTES // 4):
                for text, e in zip(pieces[begin:i], self.library.encode_batch_fast(pieces[begin:i], add_special_tokens=False)):
                    self.known[text] = self.value(e.ids)
                begin, total = i, 0
            total += len(piece or "")

    def each(self, texts: Iterable[str | None]) -> list[list[int | bytes]]:
        """For each text, what its pieces give, in order; none for null."""
        split = [self.pieces(t) if t else [] for t in texts]
        new: set[str] = set()
        for s in split:
            new.update(s)
        new -= self.known.keys()
        if new:
            self._encode(list(new))
        get = self.known.__getitem__
        out = [list(map(get, s)) for s in split]
        self._forget(new)
        return out

    def _forget(self, new: set[str]) -> None:
        full = len(self.known) > CACHE_PIECES  # then those seen first stay, which are the commoner ones
        for piece in new if full else [p for p in new if len(p) > CACHE_PIECE_CHARS]:
            del self.known[piece]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's begin and the last end. Not for lengths_only."""
        if not self.kept_space:
            return self.words.ids(texts)
        found = [b"".join(x) for x in self.each(texts)]
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *(len(x) // 4 for x in found)])


class Lists:
    """Lists of numbers, held as one array with where each begins and its length."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.begin = np.cumsum(size) - size

    def take(self, which: np.ndarray) -> Lists:
        size = self.size[which]
        out = Lists(self.flat[:0], size)
        if len(which):
            out.flat = self.flat[np.repeat(self.begin[which] - out.begin, size) + np.arange(size.sum())]
        return out

    def add(self, other: Lists) -> Lists:
        return Lists(np.concatenate((self.flat, other.flat)), np.concatenate((self.size, other.size)))

    def joined(self, counts: np.ndarray) -> Lists:
        """So many lists in a row as one."""
        ends = np.concatenate(([0], np.cumsum(self.size)))[np.concatenate(([0], np.cumsum(counts)))]
        return Lists(self.flat, np.diff(ends))


class Words:
    """Ids by distinct words, for tokenizers that drop white space; without a Python object for each word of a text.

    Words and parts of words that have been encoded are kept as Arrow strings beside an array of their ids, the first
    CACHE_WORDS of them, which are the commoner ones.
    """

    def __init__(self, own: Pieces):
        self.own = own
        self.ends = np.zeros(max(own.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.ends[list(own.ends)] = True
        self.known = pa.array([], pa.large_string())
        self.held = Lists(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word is among the known ones, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _encode(self, parts: list[str]) -> Lists:
        """Each part's ids. Words of letters only are encoded TOGETHER, with blanks between; a word ends with an id that says so."""
        plain = np.array([len(p) <= CACHE_PIECE_CHARS and p.isalpha() and _latin(p) for p in parts], bool) & bool(self.own.ends)
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        lines = [" ".join([parts[i] for i in words[k : k + TOGETHER].tolist()]) for k in range(0, len(words), TOGETHER)]
        flat: list[int] = []
        for k in range(0, len(lines), BATCH_BYTES // 1024):
            for e in self.own.library.encode_batch_fast(lines[k : k + BATCH_BYTES // 1024], add_special_tokens=False):
                flat += e.ids
        ids = np.array(flat, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or len(ids) != (ends[-1] if len(ends) else 0):
            raise ValueError("words and ids do not match")
        sizes, flat, total, group = np.diff(np.concatenate(([0], ends))), [], 0, []
        other_sizes: list[int] = []
        for n, i in enumerate(others.tolist()):
            group.append(parts[i])
            total += len(parts[i])
            if total > BATCH_BYTES // 4 or n + 1 == len(others):
                for e in self.own.library.encode_batch_fast(group, add_special_tokens=False):
                    flat += e.ids
                    other_sizes.append(len(e.ids))
                total, group = 0, []
        back = np.empty(len(parts), np.int64)
        back[np.concatenate((words, others))] = np.arange(len(parts))
        return Lists(ids, sizes).add(Lists(np.array(flat, np.uint32), np.array(other_sizes, np.int64))).take(back)

    def _miss(self, words: pa.Array) -> Lists:
        """Ids of words that aren't known, by parts; what is short is known from now on."""
        split = [self.own.pieces(w, lowered=True) for w in words.to_pylist()]
        counts = np.array([len(x) for x in split], np.int64)
        coded = pa.array([p for x in split for p in x], pa.large_string()).dictionary_encode()
        at = self._places(coded.dictionary)
        new = np.flatnonzero(at < 0)
        lacking = coded.dictionary.take(pa.array(new))
        made = self._encode(lacking.to_pylist())
        at[new] = len(self.known) + np.arange(len(new))
        found = self.held.add(made).take(at).take(coded.indices.to_numpy()).joined(counts)
        if len(self.known) < CACHE_WORDS:
            several = np.flatnonzero(counts != 1)
            strings, lists = pa.concat_arrays([lacking, words.take(pa.array(several))]), made.add(found.take(several))
            short = np.flatnonzero(pc.utf8_length(strings).to_numpy() <= CACHE_PIECE_CHARS)[: CACHE_WORDS - len(self.known)]
            self.known, self.held = pa.concat_arrays([self.known, strings.take(pa.array(short))]), self.held.add(lists.take(short))
        return found

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array([self.own.lowered(t or "") for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        held = self.held
        at = self._places(coded.dictionary)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            at[miss] = len(held.size) + np.arange(len(miss))
            held = held.add(self._miss(coded.dictionary.take(pa.array(miss))))
        found = held.take(at).take(coded.indices.to_numpy())
        ends = np.concatenate((found.begin, [len(found.flat)]))
        return found.flat, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


@cache
def pieces(path: str, lengths_only: bool) -> Pieces:
    """One for each worker process, as what is known serves the next tasks too."""
    return Pieces(path, lengths_only)
