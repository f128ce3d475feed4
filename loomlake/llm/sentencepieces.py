"""SentencePiece models encoded and decoded by the tokenizers library.

The model's protobuf is read field by field; its normaliser, white-space marker, scores and byte pieces are rebuilt as a
tokenizers pipeline, whose ids are the result. Where no piece goes on past a marker, a text is split before each run of
blanks, and the distinct parts of a batch are encoded, many in a line: a piece that begins with a marker begins a part. A
marker in a text is a blank to the model, so it is one here too. Every whole text is also encoded by sentencepiece: parity says whether both agreed on it. It changes
no ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .util import byte_slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SLICE_BYTES = 4 << 20
#: Parts that are encoded in a line, with blanks between.
TOGETHER = 64
CACHE_PARTS = 400_000
CACHE_PART_CHARS = 48
#: Of so many texts one is compared with sentencepiece as a whole, so each one is.
WHOLE_EVERY = 1
_PARTS = re.compile(r" +[^ ]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield field, data[at : at + size]
        at += size


class Model:
    """pieces (text, score, kind), kind of model, normaliser settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap, self.dummy_prefix, self.squeeze = normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def splits(self) -> bool:
        """Whether encoding a text's parts gives what encoding the text gives."""
        plain = not self.charsmap and self.dummy_prefix and not self.squeeze
        return plain and not any(MARK in p.lstrip(MARK) or k == USER for p, _, k in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a normal piece, best piece first."""
        score = {p: (-s, i) for i, (p, s, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        found = [(score[p], score[p[:i]][1], score[p[i:]][1], (p[:i], p[i:])) for p in score for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
        return [pair for *_, pair in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == BPE:
            unk = self.pieces[self.unknown][0]
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError(f"no backend for models of kind {self.kind}")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] * self.dummy_prefix + [normalizers.Replace(" ", MARK)]
        out.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.backend = self.model.tokenizer()
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_parts = self.model.splits()
        #: A blank at a text's end, which is a part without anything after its marker.
        self.last = self.backend.token_to_id(MARK)
        self.begins = np.array([p.startswith(MARK) for p, *_ in self.model.pieces], bool)
        self.known: dict[str, bytes] = {}
        #: Known parts that decoding doesn't give back.
        self.odd: set[str] = set()

    def parts(self, text: str) -> list[str]:
        """Each without the blank before it, which encoding adds."""
        if not self.by_parts or not text:
            return [text] if text else []
        text = text.replace(MARK, " ")
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [p[1:] for p in _PARTS.findall(" " + text)]

    def _encode_each(self, parts: list[str]) -> None:
        ours = [e.ids for e in self.backend.encode_batch_fast(parts, add_special_tokens=False)]
        back = self.backend.decode_batch(ours, skip_special_tokens=False)
        for part, ids, text in zip(parts, ours, back):
            self.known[part] = array("I", ids).tobytes() if part else array("I", [self.last]).tobytes()
            if part and text != part:
                self.odd.add(part)

    def _encode(self, parts: list[str]) -> None:
        """Parts without blanks are encoded TOGETHER; in such a line no piece but a part's first has a marker."""
        if not self.by_parts or self.model.kind != BPE:
            return self._encode_each(parts)
        plain = [p for p in parts if p and p[0] != " "]
        alone = [p for p in parts if not p or p[0] == " "]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        lines = [" ".join(g) for g in groups]
        ours = [e.ids for e in self.backend.encode_batch_fast(lines, add_special_tokens=False)]
        for group, line, ids, text in zip(groups, lines, ours, self.backend.decode_batch(ours, skip_special_tokens=False)):
            held = np.array(ids, np.uint32)
            at = np.flatnonzero(self.begins[held])
            if text != line or len(at) != len(group) or at[0]:
                alone += group
                continue
            data, at = held.tobytes(), [*(4 * at).tolist(), 4 * len(held)]
            for part, i, j in zip(group, at, at[1:]):
                self.known[part] = data[i:j]
        if alone:
            self._encode_each(alone)

    def each(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """ids (unsigned 32-bit), parity and round trip of each text."""
        split = [self.parts(t or "") for t in texts]
        new = set().union(*split) - self.known.keys()
        if new:
            self._encode(list(new))
        out = []
        get = self.known.__getitem__
        for t, s in zip(texts, split):
            ids = b"".join(map(get, s))
            same = not t or array("I", self.other.encode([t], num_threads=1)[0]).tobytes() == ids
            out.append((ids, same, self.odd.isdisjoint(s if self.odd else ()) and MARK not in (t or "")))
        full = len(self.known) > CACHE_PARTS
        for part in new if full else [p for p in new if len(p) > CACHE_PART_CHARS]:
            del self.known[part]
            self.odd.discard(part)
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, ids (array<int>), parity, round_trip of every row's whole text, without begin or end ids.

    A null or empty text has no ids. round_trip is whether decoding gives the text; one with a marker comes back with a
    blank there. Repeated rows give a row each, null ids stay null, an empty table gives none; other
    columns are not read.
    """
    return _run(docs, model, id_col, text_col, "ids array<int>", lambda ids: pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int32())), ["ids"])


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, with n_ids and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) instead of ids."""
    return _run(docs, model, id_col, text_col, "n_ids bigint, ids_crc32 bigint", lambda ids: [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["n_ids", "ids_crc32"])


def _run(docs: DataFrame, model: str, id_col: str, text_col: str, kinds: str, columns, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                text = batch.column("text")
                found = own.each(text.to_pylist())
                made = columns([x[0] for x in found])
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                flags = [pa.array([x[i] for x in found], pa.bool_()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), size, *(made if isinstance(made, list) else [made]), *flags], names=["doc_id", "n_bytes", *names, "parity", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, {kinds}, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids and empty ones give an empty text, markers in what was encoded come back as blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = own.backend.decode_batch([x or [] for x in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
