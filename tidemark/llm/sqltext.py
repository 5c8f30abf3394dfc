"""Fragments of reference SQL that several queries share."""

#: The 256 entries of the reflected CRC-32 table as a list, by its bit rule.
CRC_TABLE = (
    "(SELECT list(list_reduce(list_prepend(b, range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) "
    "ELSE v >> 1 END) ORDER BY b) FROM range(256) AS r(b))"
)


def crc32(text: str, entries: str = "tab") -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes; ``entries`` names a column that holds the table."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    turn = f"xor(c >> 8, {entries}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {turn}), 4294967295)"


def lower_ascii(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
