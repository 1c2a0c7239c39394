"""Fingerprints of whole relations.

``multiset_digest`` adds row hashes up, so it needs no order and no shuffle of
rows: each task keeps four sums. Two relations have equal digests exactly when
they hold the same rows equally often (up to hash collisions).

``ordered_digest`` hashes rows in key order through a tree. Each tree node
joins at most ``fan_out`` child hashes, so no row ever holds the whole relation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import floor_div, row_hash

_WORD_STARTS = (1, 16, 31, 46)  # four words of 15 hex digits, 60 bits each


def _words(hash_column: str) -> list[Column]:
    return [
        F.conv(F.substring(hash_column, start, 15), 16, 10).cast("decimal(20,0)")
        for start in _WORD_STARTS
    ]


def digest_aggregates(
    hash_column: str, prefix: str = "__d", weight: Column | None = None
) -> list[Column]:
    """Row count and the four word sums; ``weight`` says how many copies a row stands for."""
    copies = (F.lit(1) if weight is None else weight).cast("decimal(18,0)")
    return [
        F.coalesce(F.sum(part * copies), F.lit(0)).cast("decimal(38,0)").alias(f"{prefix}{i}")
        for i, part in enumerate([F.lit(1).cast("decimal(20,0)"), *_words(hash_column)])
    ]


def digest_of_aggregates(prefix: str = "__d") -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(f"{prefix}{i}").cast("string") for i in range(5)]), 256)


def multiset_digest(df: DataFrame, columns: Sequence[Column], name: str = "digest") -> DataFrame:
    """One row: ``row_count`` and the digest of the given columns."""
    return (
        df.select(row_hash(*columns).alias("__h"))
        .agg(*digest_aggregates("__h"))
        .select(F.col("__d0").cast("bigint").alias("row_count"), digest_of_aggregates().alias(name))
    )


def ordered_digest(
    df: DataFrame,
    key: str,
    columns: Sequence[Column],
    name: str = "digest",
    fan_out: int = 4096,
    levels: int = 6,
) -> DataFrame:
    """One row with the root hash over ``df`` in order of the integer ``key``.

    Copies of a key are folded by addition first, so a repeated key costs one
    leaf. ``fan_out ** levels`` has to reach the key range; the defaults do for
    every long.
    """
    level = (
        df.select(F.col(key).cast("bigint").alias("__k"), row_hash(*columns).alias("__h"))
        .groupBy("__k")
        .agg(*digest_aggregates("__h"))
        .select("__k", digest_of_aggregates().alias("__h"))
    )
    for _ in range(levels):
        ordered = F.array_sort(F.collect_list(F.struct("__k", "__h")))
        joined = F.array_join(F.transform(ordered, lambda x: x["__h"]), "")
        level = (
            level.groupBy(floor_div(F.col("__k"), fan_out).alias("__p"))
            .agg(F.sha2(joined, 256).alias("__h"))
            .withColumnRenamed("__p", "__k")
        )
    # negative and non-negative keys meet in at most two roots
    ordered = F.array_sort(F.collect_list(F.struct("__k", "__h")))
    return level.agg(
        F.sha2(F.array_join(F.transform(ordered, lambda x: x["__h"]), ""), 256).alias(name)
    )
