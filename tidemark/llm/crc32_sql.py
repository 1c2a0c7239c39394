"""The CRC-32 checksum in the SQL of the twins, which have no function for it."""

from __future__ import annotations

# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

#: A common table expression: one row with the table of the 256 byte steps.
CRC_TABLE = (
    "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda a, k: "
    f"CASE WHEN a % 2 = 1 THEN xor(a // 2, {POLYNOMIAL}) ELSE a // 2 END)) AS steps)"
)


def crc32_of(text: str) -> str:
    """SQL for the unsigned checksum of the UTF-8 bytes of the SQL text ``text``; reads ``crc``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = "lambda a, v: xor(a // 256, crc.steps[xor(a % 256, v) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), {step}), 4294967295)"
