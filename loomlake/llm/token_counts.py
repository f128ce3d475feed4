"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .tokens import pieces
from .util import byte_slices

SLICE_BYTES = 4 << 20


def _library_counts(path: str):
    """Texts to counts, for either library's files."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
    encoder = pieces(path, lengths_only=True)
    return lambda texts: [sum(x) for x in encoder.each(texts)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    Counts are the library's without begin, end or added special tokens; strings of special tokens inside a text count
    as the library takes them by default. A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated
    ids give repeated rows, null ids stay null, an empty table gives none, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _library_counts(tokenizer)
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                text = batch.column("text")
                n = counts(text.to_pylist())
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
