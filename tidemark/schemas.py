"""Record and table shapes, and the fixed names they use."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Row kinds of the change log.
INSERT, UPDATE_BEFORE, UPDATE_AFTER, DELETE = "+I", "-U", "+U", "-D"
DEAD_LETTER_VERSION = 1
REPAIR_FORMAT = "intended-order-v1"
# Numbers below this magnitude are epoch milliseconds, others microseconds.
MICROS_FROM = 100_000_000_000_000
# ------------------------------------------------------------------------------

ORDER_COLUMNS = [
    "order_id",
    "business_key",
    "event_id",
    "customer_id",
    "status",
    "amount_cents",
    "updated_at",
    "seed",
]

ORDER_ROW = T.StructType(
    [
        T.StructField("order_id", T.LongType(), False),
        T.StructField("business_key", T.StringType(), False),
        T.StructField("event_id", T.LongType(), False),
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("amount_cents", T.LongType(), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
        T.StructField("seed", T.IntegerType(), False),
    ]
)

POSITION_COLUMNS = ["topic", "partition", "offset", "image_seq"]

LOG_RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("timestamp_ms", T.LongType(), False),
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)

CHANGE = T.StructType(
    [
        *LOG_RECORD.fields[:4],
        T.StructField("image_seq", T.IntegerType(), False),
        T.StructField("cdc_row_kind", T.StringType(), False),
        T.StructField("cdc_operation", T.StringType(), False),
        *ORDER_ROW.fields,
        T.StructField("source_ts_ms", T.LongType(), True),
    ]
)

CHANGELOG_COLUMNS = ORDER_COLUMNS + ["cdc_row_kind", "cdc_operation", "source_ts_ms"]

DEAD_LETTER = T.StructType(
    [
        T.StructField("dlq_schema_version", T.IntegerType()),
        T.StructField("quarantined_at", T.StringType()),
        T.StructField("original_topic", T.StringType()),
        T.StructField("original_partition", T.IntegerType()),
        T.StructField("original_offset", T.LongType()),
        T.StructField("original_timestamp_ms", T.LongType()),
        T.StructField("original_key_base64", T.StringType()),
        T.StructField("original_value_base64", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# One row per commit of a table set; written last, it makes the commit visible.
COMMIT = T.StructType(
    [
        T.StructField("batch_id", T.LongType(), False),
        T.StructField("committed_at_ms", T.LongType(), False),
        T.StructField("offsets", T.MapType(T.StringType(), T.LongType()), False),
        T.StructField("changelog_rows", T.LongType(), False),
        T.StructField("dead_letter_rows", T.LongType(), False),
    ]
)

# What the admission gate knows of a primary key after a batch, see streaming.gate.
GATE = T.StructType(
    [
        T.StructField("order_id", T.LongType(), False),
        T.StructField("records", T.LongType(), False),
        T.StructField("mismatched_keys", T.LongType(), False),
        T.StructField("low_partition", T.IntegerType(), False),
        T.StructField("high_partition", T.IntegerType(), False),
        T.StructField("order_violations", T.LongType(), False),
        T.StructField("offset_violations", T.LongType(), False),
        T.StructField("last_event_id", T.LongType(), True),
        T.StructField("last_offset", T.LongType(), True),
        T.StructField("highest_event_id", T.LongType(), True),
        T.StructField("rejected_in", T.LongType(), True),
    ]
)

ISOLATED = T.StructType([*LOG_RECORD.fields, T.StructField("order_id", T.LongType(), False)])

# Images that reach the tables beside the stream (repairs, snapshot chunks) come in patches. The
# row of a patch, written last, makes it visible in snapshots from ``after_batch`` on.
PATCH_COMMIT = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("committed_at_ms", T.LongType(), False),
        T.StructField("after_batch", T.LongType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("low", T.MapType(T.StringType(), T.LongType()), False),
        T.StructField("high", T.MapType(T.StringType(), T.LongType()), False),
    ]
)

# One attempt to repair a dead letter; without an error it worked.
REPAIR = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("document_sha256", T.StringType(), False),
        T.StructField("error_type", T.StringType(), True),
        T.StructField("error_message", T.StringType(), True),
    ]
)

RUN_FIELDS = [
    "run_id",
    "git_sha",
    "started_at",
    "finished_at",
    "stack_versions",
    "command",
    "logs",
]
