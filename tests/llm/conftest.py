from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix_copies string, line_gone string, node string, bucket string"
EXTRA = ("x", "y", "z", "w")


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names operators use."""
    words = [f"w{k}" for k in range(4000)]
    long = "\n".join(" ".join(words[k : k + 40]) for k in range(0, 4000, 40))
    near = long.replace("w17 ", "changed ")
    rows = [
        (1, long, "en", "a"), (2, long, "en", "a"), (2, long, "en", "a"), (3, near, "en", "b"), (4, "", "en", "b"), (5, None, None, None),
        (None, "no id here at all", "en", "c"), (None, None, None, None), (6, "Released under the MIT License.\nplain words", "en", "a"),
        (7, "mail bob@example.com or +1 (555) 555-0100, 10.0.0.1 and 4111 1111 1111 1111", "en", "b"), (8, " \n\t ", "en", "c"), (9, "a" * 50_000, "en", "c"),
        (10, "ümläut Ünd ÇA <|endoftext|> İ Σας", "de", "b"), (11, "one two three four five six\none two three four five six", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None, *EXTRA) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
