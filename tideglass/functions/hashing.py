"""Stable fingerprint of a window's identity, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 64-bit FNV-1a. The prime is 2**40 + 435.
FNV_OFFSET_BASIS = 0xCBF29CE484222325
FNV_PRIME_LOW = 0x1B3
HASH_PREFIX = "v1-"

_LOW_32 = 0xFFFFFFFF


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as array<int>: read as Latin-1, each byte is one character."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.transform(F.filter(F.split(latin, ""), lambda c: c != ""), F.ascii)


def _length_bytes(text: Column) -> Column:
    """Byte length as 8 little-endian bytes; Spark texts stay below 2**31 bytes."""
    size = F.octet_length(text)
    low = [F.shiftright(size, shift).bitwiseAND(F.lit(0xFF)) for shift in (0, 8, 16, 24)]
    return F.array(*low, *[F.lit(0)] * 4)


def _mix(state: Column, byte: Column) -> Column:
    """One FNV-1a step modulo 2**64.

    Under ANSI a 64-bit product would raise, so the state is multiplied as two
    32-bit halves; shifts drop their overflow silently.
    """
    mixed = state.bitwiseXOR(byte.cast("bigint"))
    low = mixed.bitwiseAND(F.lit(_LOW_32))
    product = low * F.lit(FNV_PRIME_LOW)
    high = (
        F.shiftrightunsigned(mixed, 32) * F.lit(FNV_PRIME_LOW)
        + F.shiftleft(low, 8)
        + F.shiftrightunsigned(product, 32)
    )
    return F.shiftleft(high, 32).bitwiseOR(product.bitwiseAND(F.lit(_LOW_32)))


def fnv1a_hex(*parts: Column) -> Column:
    """FNV-1a over length-prefixed parts, as 16 lowercase hex digits."""
    data = F.concat(*[F.concat(_length_bytes(p), _utf8_bytes(p)) for p in parts])
    state = F.aggregate(data, F.lit(_signed(FNV_OFFSET_BASIS)).cast("bigint"), _mix)
    return F.lpad(F.lower(F.hex(state)), 16, "0")


def context_hash(
    app_name: Column, process_id: Column, process_path: Column, title: Column
) -> Column:
    """Fingerprint of (app, process id, process path, title); NULL parts count as ''.

    Costs one interpreted step per byte: apply it to distinct identities, not to events.
    """
    return F.concat(
        F.lit(HASH_PREFIX),
        fnv1a_hex(
            F.coalesce(app_name, F.lit("")),
            F.coalesce(process_id.cast("string"), F.lit("")),
            F.coalesce(process_path, F.lit("")),
            F.coalesce(title, F.lit("")),
        ),
    )
