import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_words import words  # noqa: E402

#: Names that operators use inside; tables may have columns with these names.
CLASHING = "key string, block int, row string, hash long, rank int, score double, copies int, fingerprint string, component_id long, spans string, _score double, _key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, ties, and columns with clashing names."""
    same = words(1, 120)
    rows = [
        (1, same, "en", "src1", 5), (1, same, "en", "src1", 5), (2, same.upper(), "en", "src2", 5), (3, same.replace("w", "w", 1) + " end", "de", None, 5), (4, None, None, "src1", None), (5, "", "en", "src1", 0),
        (6, " \n\t ", "fr", "src3", 3), (None, words(2, 60), "en", "src1", 9), (None, None, None, None, None), (None, same, "en", "src1", 5), (7, words(3, 30_000, 100_000), "en", "src1", 9), (8, "é" * 700, "fr", "src4", 700),
        (9, "one two", "en", "src5", 7), (10, "one two", "en", "src5", 7), (11, "a" * 1000, "en", "src1", 1000), (-12, words(4, 80), "en", "src1", 9), (13, "null\x00inside 漢字 😀 " * 40, "zh", "src1", 9),
    ]
    blank = (None,) * 12
    return spark.createDataFrame([(*r, *blank) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
