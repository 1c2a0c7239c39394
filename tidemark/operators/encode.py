"""Rows back to envelopes: snapshots, repairs and fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import ORDER_COLUMNS

_NULL_ROW = (
    "struct<order_id:bigint,business_key:string,event_id:bigint,customer_id:bigint,"
    "status:string,amount_cents:bigint,updated_at:variant,seed:int>"
)


def number_variant(n: Column) -> Column:
    return F.try_parse_json(n.cast("string"))


def epoch_millis_variant(ts: Column) -> Column:
    """An NTZ column as the epoch millisecond number the wire carries by default."""
    return number_variant(F.unix_millis(ts.cast("timestamp")))


def wire_row(prefix: str = "", updated_at: Column | None = None) -> Column:
    """The order columns as the row struct of an envelope; ``updated_at`` is a VARIANT."""
    ts = updated_at if updated_at is not None else epoch_millis_variant(F.col(prefix + "updated_at"))
    return F.struct(
        *[(ts if c == "updated_at" else F.col(prefix + c)).alias(c) for c in ORDER_COLUMNS]
    )


def null_row() -> Column:
    return F.lit(None).cast(_NULL_ROW)


def envelope(
    op: Column,
    before: Column,
    after: Column,
    ts_ms: Column,
    source: dict[str, Column] | None = None,
) -> Column:
    """Envelope JSON as bytes. ``source`` overrides or extends the source block."""
    nothing = F.lit(None).cast("string")
    block = {
        "version": F.lit("1"),
        "connector": F.lit("mysql"),
        "name": F.lit("orders"),
        "ts_ms": ts_ms,
        "snapshot": F.when(op == "r", F.lit("true")).otherwise(F.lit("false")),
        "db": F.lit("shop"),
        "table": F.lit("orders"),
        "server_id": F.lit(1),
        "gtid": nothing,
        "file": F.lit("changes"),
        "pos": F.lit(0),
        "row": F.lit(0),
        **(source or {}),
    }
    document = F.struct(
        before.alias("before"),
        after.alias("after"),
        F.struct(*[v.alias(k) for k, v in block.items()]).alias("source"),
        op.alias("op"),
        ts_ms.alias("ts_ms"),
        nothing.alias("transaction"),
    )
    return F.to_json(document, {"ignoreNullFields": "false"}).cast("binary")


def snapshot_records(table: DataFrame, topic: str, ts_ms: Column) -> DataFrame:
    """Table rows as snapshot records that sort before every logged change.

    Their partition and offset are ``-1``: a key occurs once in a snapshot, so the position
    needs to order it only against the log, whatever partition that has the key on.
    """
    return table.select(
        F.lit(topic).alias("topic"),
        F.lit(-1).alias("partition"),
        F.lit(-1).cast("bigint").alias("offset"),
        ts_ms.cast("bigint").alias("timestamp_ms"),
        F.col("order_id").cast("string").cast("binary").alias("key"),
        envelope(F.lit("r"), null_row(), wire_row(), ts_ms.cast("bigint")).alias("value"),
    )


def snapshot_then_log(table: DataFrame, log: DataFrame, topic: str, ts_ms: Column) -> DataFrame:
    """Initial snapshot followed by the changes."""
    return snapshot_records(table, topic, ts_ms).unionByName(log)
