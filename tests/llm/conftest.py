from __future__ import annotations

import pytest

#: Columns whose names operators use inside.
CLASHES = ("_id", "_hash", "text_hash", "key", "n", "g", "kept", "rank", "__runs", "d", "th", "component_id", "ids", "row", "w")
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, clashes: bool = False):
    """documents of (doc_id, text) or (doc_id, text, source) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    out = spark.createDataFrame(full, DOCUMENT)
    if clashes:
        for c in CLASHES:
            out = out.selectExpr("*", f"'x' as `{c}`")
    return out


@pytest.fixture(scope="session")
def tokenizers_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path
