from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows, extra: bool = True):
    """rows: (doc_id, text, lang); with columns whose names an operator may want for itself."""
    full = [(i, t, lang, "src", None if t is None else len(t), 0.5, "x", 1) for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, node string, scan int")


#: Nulls, empty and blank texts, ties, repeated rows, marks alone, and a very long text.
ODD = [
    (1, None, None), (2, "", "en"), (3, "   \n", "en"), (4, "12 34 %%", "de"), (5, "one", "en"), (5, "one", "en"),
    (6, "É" * 5, "fr"), (7, "word " * 60_000, "en"), (8, "a<|endoftext|>b it's", None), (None, "no id here", "en"), (9, "\x00\x1f\u2003x", "en"),
]
