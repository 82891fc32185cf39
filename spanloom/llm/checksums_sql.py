"""crc32 as a DuckDB expression, for the SQL of operators whose contract has it."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes: each byte is followed by eight steps of one bit."""
    bytes_ = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    steps = f"flatten(list_transform({bytes_}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT)"
