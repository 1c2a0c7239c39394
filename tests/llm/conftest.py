from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark):
    """A few documents as a table, with columns whose names the operators use inside."""

    def make(rows, extra=True):
        schema = "doc_id long, text string" + (", row_hash string, key string, n long, pos int, _gone string" if extra else "")
        tail = ("x", "y", 7, 1, "z") if extra else ()
        return spark.createDataFrame([(*r, *tail) for r in rows], schema)

    return make
