import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""

    def make(rows, parts=3):
        frame = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
        clashing = {n: "x" for n in ("digest", "row_hash", "key", "_text", "part", "kept", "n", "set")}
        for name, value in clashing.items():
            frame = frame.selectExpr("*", f"'{value}' AS `{name}`")
        return frame.repartition(parts)

    return make


@pytest.fixture
def dice():
    return random.Random(5)

