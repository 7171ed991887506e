"""Pieces of the SQL that queries are checked against."""

from __future__ import annotations

#: A relation of one row: the table of the reflected CRC-32 polynomial, an entry a byte.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) AS entries)"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, as BIGINT; the row of crc_table must be joined."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT"
    bytes_ = f"list_transform(range(1, strlen({text}) + 1), lambda k: {byte})"
    step = "xor(c >> 8, entries[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {step}), 4294967295)"
