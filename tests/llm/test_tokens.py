from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomlake.llm import packing, sentencepieces, token_counts
from loomlake.llm.tokens import Pieces

from .conftest import documents

TEXTS = [
    None, "", " ", "a b", "a  b\n\n c\t d", "x\xa0 y", "x\xa0  y  z", " <|endoftext|> a<|endoftext|>b", "it's can't ' s 'S", "!\x1c?\x1c a", "中文" * 6000 + "1。" * 5000, "\n\n",
    "İı Σς ὈΔΥΣΣΕΎΣ é ́a", "a\x85 b \x0b c\x0c\x0b d", "e　 　f", "ŒUVRE ÀÉ <|ENDOFTEXT|> ªº µ ÿ", "word," * 4000, "🙂🙃 tail  ", "12345 3.14 a1b2", "<|startoftext|>x",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_what_the_library_gives(tokenizers_path, name):
    pieces = Pieces(tokenizers_path(name), lengths_only=False)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("aB é.,'|<>\n\t\xa0 19中") for _ in range(200)) for _ in range(300)]
    for text, got in zip(texts, pieces.each(texts)):
        assert np.frombuffer(b"".join(got), "<u4").tolist() == pieces.library.encode(text or "", add_special_tokens=False).ids, text


def test_counts(spark, tokenizers_path):
    path = tokenizers_path("byte_bpe_50k.json")
    rows = [*enumerate(TEXTS), (None, "null id"), (3, "a b")]
    got = token_counts.count_tokens(documents(spark, rows, clashes=True), path, 2).collect()
    library = Pieces(path, True).library
    expected = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 2) for r in got)
    assert token_counts.count_tokens(documents(spark, []), path, 2).count() == 0


def test_counts_by_sentencepiece(spark, tokenizers_path):
    import sentencepiece

    path = tokenizers_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, enumerate(TEXTS)), path, 512).collect()}
    assert got == {i: len(own.encode(t or "")) for i, t in enumerate(TEXTS)}


def test_sentencepiece_backend(spark, tokenizers_path):
    import sentencepiece

    path = tokenizers_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = TEXTS + ["<s> </s> <0x41> <unk>", "  a  b ", "▁a ▁b", "a" * 70, "----- ====", "a\u0000b"]
    docs = documents(spark, [*enumerate(texts), (None, "x")], clashes=True)
    rows = sentencepieces.encode(docs, path)
    got = {r.doc_id: r for r in rows.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == own.encode(t or ""), t
        assert got[i].parity and got[i].n_bytes == len((t or "").encode())
    back = {r.doc_id: r.text for r in sentencepieces.decode(rows, path).collect()}
    for i, t in enumerate(texts):
        assert "▁" in (t or "") or (back[i] == (t or "") and got[i].round_trip), t
    digests = {r.doc_id: (r.n_ids, r.ids_crc32) for r in sentencepieces.encode_digests(docs, path).collect()}
    assert digests == {i: (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for i, r in got.items()}
    assert sentencepieces.encode(documents(spark, []), path).count() == 0


def test_markers_and_blanks_as_the_library_takes_them(tokenizers_path):
    encoder = sentencepieces.Encoder(tokenizers_path("piece_bpe_32k.model"))
    rng = random.Random(11)
    texts = [" ▁ ", "▁ ", "▁▁", *("".join(rng.choice("ab ▁\n") for _ in range(rng.randrange(1, 24))) for _ in range(4000))]
    for text, (ids, parity, back) in zip(texts, encoder.each(texts)):
        assert parity and np.frombuffer(ids, "<u4").tolist() == encoder.other.encode(text), text
        assert back == ("▁" not in text)


def test_a_backend_that_differs_shows(tokenizers_path, monkeypatch):
    monkeypatch.setattr(sentencepieces, "WHOLE_EVERY", 1)
    path = tokenizers_path("piece_bpe_32k.model")

    class Other:
        def __init__(self, own):
            self.own = own

        def piece_to_id(self, piece):
            return self.own.piece_to_id(piece)

        def encode(self, x, **how):
            return [i + [7] for i in self.own.encode(x, **how)] if isinstance(x, list) else self.own.encode(x)

    encoder = sentencepieces.Encoder(path)
    right = encoder.each(["some words here"])[0]
    assert right[1]
    encoder.known.clear()
    encoder.other = Other(encoder.other)
    ids, parity, _ = encoder.each(["some words here"])[0]
    assert ids == right[0] and not parity  # the backend's ids stay
    encoder = sentencepieces.Encoder(path)
    encoder.parts = lambda text: text.split(" ")[:-1]  # a wrong split shows on whole texts
    assert not encoder.each(["some words here"])[0][1]


def test_words_are_encoded_alike_with_any_cache(tokenizers_path, monkeypatch):
    from loomlake.llm import tokens

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abÉ.,9中'") for _ in range(rng.randrange(1, 7))) for _ in range(30)) for _ in range(200)] + TEXTS
    library = Pieces(tokenizers_path("word_bpe_49k.json"), False).library
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for words in (0, 50, 500_000):
        monkeypatch.setattr(tokens, "CACHE_WORDS", words)
        own = Pieces(tokenizers_path("word_bpe_49k.json"), False)
        for k in range(0, len(texts), 40):
            ids, at = own.ids(texts[k : k + 40])
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == expected[k : k + 40]
        assert len(own.words.known) <= words


def test_unigram_model_round_trip(tmp_path):
    """A small unigram model written field by field."""
    import struct

    def field(n, kind, value):
        body = value if kind != 2 else bytes([len(value)]) + value
        return bytes([n << 3 | kind]) + body

    def piece(text, score, kind=1):
        inner = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, inner)

    data = piece("<unk>", 0, 2) + b"".join(piece(t, s) for t, s in [("▁", -3), ("a", -2), ("b", -2), ("▁ab", -1.5), ("ab", -2.5), ("▁a", -2.2)])
    data += field(2, 2, field(3, 0, bytes([1]))) + field(3, 2, field(1, 2, b"identity") + field(3, 0, bytes([1])) + field(4, 0, bytes([0])))
    path = tmp_path / "small.model"
    path.write_bytes(data)
    encoder = sentencepieces.Encoder(str(path))
    for text, (ids, parity, _) in zip(["ab ab", "a b", "abab", "ba"], encoder.each(["ab ab", "a b", "abab", "ba"])):
        assert parity and np.frombuffer(ids, "<u4").tolist() == encoder.other.encode(text)


def test_packing(spark, tokenizers_path, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    path = tokenizers_path("word_bpe_49k.json")
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "x1", "zeta."]) for _ in range(rng.randrange(300))), ["big", "big", "mid", None][i % 4]) for i in range(120)]
    rows += [(500 + i, t, "odd") for i, t in enumerate(TEXTS)] + [(7, "twice", "big"), (7, "twice", "big"), (None, "no id", "big")]
    got = packing.pack(documents(spark, rows, clashes=True), path, 256).collect()
    library = Pieces(path, True).library
    left = Counter()
    for i, t, s in rows:
        left[i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    pieces: dict = {}
    by_sequence: dict = {}
    ids_of = {(i, len(x)): x for i, t, _ in rows for x in [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")]}
    covered = Counter()
    for r in got:
        whole = ids_of[r.doc_id, r.doc_tokens]
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) and r.length > 0
        covered.update((r.doc_id, r.doc_tokens, r.start + k) for k in range(r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    times = Counter((i, len(ids_of[i, n])) for i, n in ((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows))
    assert covered == Counter({(i, n, k): c for (i, n), c in times.items() for k in range(n)})
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or (at < 256 and at & (at - 1) == 0)
    assert packing.pack(documents(spark, []), path, 256).count() == 0


def test_round_robin_keeps_to_targets():
    queues = [[(i, 700) for i in range(60)], [(100 + i, 90) for i in range(150)], [(500, 9000)]]
    sizes = np.array([sum(n for _, n in q) for q in queues], float)
    targets = sizes / sizes.sum()
    taken, total, worst = np.zeros(3), 0, 0.0
    source = lambda d: 0 if d < 100 else 1 if d < 500 else 2
    for doc, _, length, _, _ in packing.round_robin(queues, targets, np.zeros(3), 2048):
        taken[source(doc)] += length
        total += length
        if total < sizes.sum() - 4096:
            worst = max(worst, np.abs(taken - targets * total).max())
    assert (taken == sizes).all() and worst <= 2 * packing.QUANTUM


def test_lags_carry_over_shards(spark):
    counts = spark.createDataFrame([(0, "a", 10), (0, "b", 30), (1, "a", 20), (2, None, 20), (3, "a", 1)], "shard bigint, source string, n bigint")
    got = {(r.shard, r.source): (round(r.target, 4), round(r.lag, 4)) for r in packing.lags(counts, {"a": 1, "b": 1}).collect()}
    assert got == {(0, "a"): (0.5, 0), (0, "b"): (0.5, 0), (1, "a"): (0.5, 10), (2, None): (0, 0), (3, "a"): (0.5, 10)}


def test_parity_is_of_every_whole_text(tokenizers_path):
    """sentencepiece differs on whole texts only, by their words' order, which no part shows; none of them is left out."""
    encoder = sentencepieces.Encoder(tokenizers_path("piece_bpe_32k.model"))
    own = encoder.other
    odd = lambda text, ids: ids + [7] if " " in text else ids

    class Other:
        def piece_to_id(self, piece):
            return own.piece_to_id(piece)

        def encode(self, x, **how):
            return [odd(t, i) for t, i in zip(x, own.encode(x, **how))] if isinstance(x, list) else odd(x, own.encode(x))

    texts = [f"two{i} words" if i % 2 else f"one{i}" for i in range(300)]
    encoder.other = Other()
    assert [same for _, same, _ in encoder.each(texts)] == [not i % 2 for i in range(300)]


def test_distinct_parts_are_encoded_in_lines(tokenizers_path):
    """The backend gets a line for many parts, and each part has the ids that it has alone."""
    encoder = sentencepieces.Encoder(tokenizers_path("piece_bpe_32k.model"))
    backend, given = encoder.backend, []

    class Counted:
        def encode_batch_fast(self, x, **how):
            given.extend(x)
            return backend.encode_batch_fast(x, **how)

        def decode_batch(self, x, **how):
            return backend.decode_batch(x, **how)

    encoder.backend = Counted()
    rng = random.Random(13)
    words = sorted({"".join(rng.choice("abÉ.,9中\n\x00🙂<>") for _ in range(rng.randrange(1, 9))) for _ in range(2000)})
    (ids, parity, back), *_ = encoder.each([" ".join(words) + "  two  blanks "])
    assert parity and back and len(given) < len(words) / 32
    for w in words:
        assert np.frombuffer(encoder.known[w], "<u4").tolist() == backend.encode(w, add_special_tokens=False).ids, w
