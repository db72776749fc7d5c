import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def documents(small):
    """doc_id -> text of the small table."""
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, long), (None, "x y z"), (None, None), (5, "a b c d e f g"), (6, "  \n\n ")]
    inner = "digest words pii score predicted k_id k_key own_key text_key item row shard bin piece start is_target t_id h class_id found key made line host removed places label toxic a.b start.x".split()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in inner)
    return spark.createDataFrame([(i, t, None, "s", 7, *range(len(inner))) for i, t in rows], schema)
