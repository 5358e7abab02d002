"""Pieces of SQL that several oracles of this subpackage share."""

from __future__ import annotations

#: Common table ``crc``: one row with the table of the CRC-32 of each byte (reflected polynomial 0xEDB88320).
CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda x: x::UBIGINT)),
                              lambda c, x: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT))) AS v
        FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """SQL of the CRC-32 of a text in UTF-8, where crc (CRC_TABLE) is among the tables of the query."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::UBIGINT)"
    return f"xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], {octets}), lambda c, x: xor(c >> 8, crc.tab[(xor(c, x) & 255)::BIGINT + 1])))"
