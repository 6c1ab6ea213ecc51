import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_helpers import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, score double, kept boolean, bucket int"

@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns that operators use as names."""
    long = prose(1, 60_000)
    base = prose(2, 300)
    near = " ".join(w if i != 150 else "changed" for i, w in enumerate(base.split()))
    rows = [
        (1, base, "en", 1.0, True, 3), (2, near, "en", None, False, None), (3, base, None, 0.5, True, 1), (4, None, "en", 1.0, None, 2), (5, "", "en", 1.0, True, 2), (6, "   \n ", "en", 1.0, True, 2),
        (7, long, "en", 1.0, True, 2), (8, long + " tail", "en", 1.0, True, 2), (None, base, "en", 1.0, True, 2), (None, "lonely words without a number", "en", 1.0, True, 2), (9, "word", "en", 1.0, True, 2),
        (10, "word", "en", 1.0, True, 2), (10, "word", "en", 1.0, True, 2), (11, "日本語 ünïcödé Σ 😀 <|endoftext|>", "ja", 1.0, True, 2), (12, "x" * 5000, "en", 1.0, True, 2), (13, prose(3, 300), "en", 1.0, True, 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
