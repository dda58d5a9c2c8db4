"""Addresses, big-endian integers and flag bits."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dotted-quad text with octets 0..255 and no leading zeros.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"


def uint_be(data: Column, offset: int | Column, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes at zero-based ``offset``."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    piece = F.substring(data, start, F.lit(width))
    return F.conv(F.hex(piece), 16, 10).cast("bigint")


def hex_uint(text: Column, offset: int | Column, width: int) -> Column:
    """Like ``uint_be`` on bytes already rendered as hexadecimal text."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) * 2 + 1
    return F.conv(F.substring(text, start, F.lit(width * 2)), 16, 10).cast("bigint")


def ip_text(ip: Column) -> Column:
    """Dotted text of a numeric address; NULL stays NULL."""
    octets = [F.shiftright(ip, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(ip.isNotNull(), F.concat_ws(".", *octets))


def ip_number(text: Column) -> Column:
    """Numeric address of dotted text; NULL when the text is no IPv4 address."""
    parts = F.split(text, r"\.")
    total = sum((parts.getItem(i).cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(text.rlike(IPV4_PATTERN), total)


def ip_literal(text: str) -> int:
    """Numeric address of an argument; raises ``ValueError`` when malformed."""
    try:
        return int(ipaddress.IPv4Address(text))
    except ipaddress.AddressValueError as err:
        raise ValueError(f"invalid IP address: {text!r}") from err


def has_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0
