"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import ORDER_COLUMNS

INTEGER_VARIANTS = r"^(BIGINT|DECIMAL\(\d+,0\))$"
NUMBER_VARIANTS = r"^(BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?$"


def ts_text(ts: Column | str) -> Column:
    """Timestamp as text with exactly three fraction digits."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def wire_schema_id(value: Column) -> Column:
    """Schema id behind the magic zero byte, big endian; null if the header is invalid."""
    header_ok = (F.length(value) >= 5) & (F.substring(value, 1, 1) == F.unhex(F.lit("00")))
    return F.when(
        header_ok, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint")
    )


def with_wire_header(schema_id: Column, payload: Column) -> Column:
    """Prefix a payload with the magic byte and the schema id."""
    return F.concat(F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(schema_id), 8, "0"))), payload)


def metric_key(name: Column | str) -> Column:
    """Lower-case letters and digits only, for suffix matching."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def text_row(prefix: str = "") -> list[Column]:
    """The order row with every column as text, timestamps at millisecond precision."""
    return [
        (ts_text(prefix + c) if c == "updated_at" else F.col(prefix + c).cast("string")).alias(c)
        for c in ORDER_COLUMNS
    ]


def tsv_line(*columns: Column) -> Column:
    """Tab separated text, nulls spelled out."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NULL")) for c in columns])


def row_hash(*columns: Column) -> Column:
    """SHA-256 of the row; the separator is a control character no text column uses."""
    return F.sha2(
        F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256
    )


def iso_utc(ts: Column) -> Column:
    """Timestamp as ISO-8601 text with a Z suffix."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def floor_div(x: Column, n: int) -> Column:
    """Integer division rounding down (``div`` rounds towards zero)."""
    return F.floor(x / F.lit(n)) if n == 1 else ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint")
