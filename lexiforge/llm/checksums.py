"""CRC-32 as DuckDB SQL, for the queries' checking SQL; DuckDB has no such function."""

from __future__ import annotations


def _remainder(byte: int) -> int:
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a SQL string expression's UTF-8 bytes, a fold over them."""
    table = ",".join(str(_remainder(k)) for k in range(256))
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    step = f"xor(c >> 8, ([{table}]::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
