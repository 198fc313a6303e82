"""CRC-32 in DuckDB, which has none: for the SQL of queries that draw rows by it."""

from __future__ import annotations

#: A relation of one row and column, both named crcs: the table of CRC-32, worked out by its rule.
CRCS = "crcs as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs)"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8, in a query that has ``crcs`` among its relations."""
    data = f"hex(encode({text}))"
    octets = f"list_transform(range(length({data}) // 2), lambda i: cast('0x' || substr({data}, cast(2 * i + 1 as int), 2) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, crcs[cast(xor(c, b) & 255 as int) + 1])), 4294967295)"
