"""Runs registered queries next to their SQL twins in DuckDB and compares the rows."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _normal(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=key)


def difference(spark_df, relation) -> str | None:
    """None if both hold the same columns and rows, otherwise what differs."""
    mine, other = sorted(spark_df.columns), sorted(relation.columns)
    if mine != other:
        return f"columns {mine} vs {other}"
    families = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = {c: families.get(t, t) for c, t in spark_df.dtypes}
    other_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    wrong = {c: (types[c], other_types[c]) for c in mine if types[c] != other_types[c]}
    left = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = _rows(relation.columns, relation.fetchall())
    if left != right:
        gone = [r for r in left if r not in set(right)][:3] if len(left) < 200_000 else []
        new = [r for r in right if r not in set(left)][:3] if len(right) < 200_000 else []
        return f"rows {len(left)} vs {len(right)}; only spark {gone}; only sql {new}; columns {mine}"
    return f"types {wrong}" if wrong else None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from tidemark import build_session

    spark = build_session(
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            problem = difference(queries[name](spark, sf_dir), con.sql(oracle[name]))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            if names:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(names or queries)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
