"""Unsigned 64-bit arithmetic on BIGINT bit patterns, as native column expressions.

Sessions run in ANSI mode, where ``+`` and ``*`` raise on overflow. Narrow operands cannot overflow;
wide ones are combined as decimals and reduced modulo 2^64.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MIN = -(1 << 63)


def lit64(value: int) -> Column:
    """An unsigned 64-bit literal as its two's complement pattern."""
    value &= (1 << 64) - 1
    return F.lit(value - (1 << 64) if value >= (1 << 63) else value).cast("bigint")


def mask(width: int) -> Column:
    return lit64((1 << min(max(width, 0), 64)) - 1)


def mask_of(width: Column) -> Column:
    """Mask for a width column; 64 and above is all ones, 0 and below is empty."""
    drop = F.greatest(F.lit(64) - F.least(width, F.lit(64)), F.lit(0)).cast("int")
    kept = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.least(drop, F.lit(63)))
    return F.when(width <= 0, F.lit(0).cast("bigint")).otherwise(kept)


def slice_bits(bits: Column, offset: Column, width: Column) -> Column:
    """``width`` bits from ``offset``; the offset is clamped to 0..63, the width is at least 1."""
    at = F.greatest(F.least(F.coalesce(offset, F.lit(0)), F.lit(63)), F.lit(0)).cast("int")
    return F.call_function("shiftrightunsigned", bits, at).bitwiseAND(mask_of(F.greatest(width, F.lit(1))))


def unsigned_order(bits: Column) -> Column:
    """A signed BIGINT that sorts as the unsigned value of ``bits``; its own inverse."""
    return bits.bitwiseXOR(F.lit(LONG_MIN).cast("bigint"))


def unsigned_text(bits: Column) -> Column:
    return F.conv(F.hex(bits), 16, 10)


def unsigned_lt(a: Column, b: Column) -> Column:
    return unsigned_order(a) < unsigned_order(b)


def _dec(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _pow(n: int) -> Column:
    return F.lit(Decimal(1 << n)).cast("decimal(20,0)")


def _wrap(x: Column) -> Column:
    """A whole decimal modulo 2^64 as a pattern."""
    return (F.pmod(x + _pow(63), _pow(64)) - _pow(63)).cast("bigint")


def _unsigned(x: Column) -> Column:
    """The unsigned value of a pattern as a decimal."""
    return F.pmod(_dec(x), _pow(64)).cast("decimal(20,0)")


@dataclass(frozen=True)
class Bits:
    """An operand of a derived signal: its pattern, NULL when it is not known, and its width.

    Unknown operands spread by SQL's own null rules, so every operation below refers to its
    operands once or twice and nested expressions stay small enough for one generated loop.
    """

    bits: Column
    width: int

    def resize(self, width: int) -> "Bits":
        width = min(max(width, 1), 64)
        return Bits(self.bits.bitwiseAND(mask(width)), width)


def _wide(a: Bits, b: Bits) -> int:
    return max(a.width, b.width)


def u_lit(value: int, width: int | None = None) -> Bits:
    """A literal; without a width it is as wide as its value needs, as decimal literals are."""
    width = width or max(1, min(64, (value & ((1 << 64) - 1)).bit_length()))
    return Bits(lit64(value & ((1 << width) - 1)), width)


def u_hex(digits: str) -> Bits:
    """A hexadecimal literal, four bits per digit."""
    return u_lit(int(digits, 16), min(64, max(1, 4 * len(digits))))


def u_bin(digits: str) -> Bits:
    """A binary literal, one bit per digit."""
    return u_lit(int(digits, 2), min(64, max(1, len(digits))))


def u_pos(x: Bits) -> Bits:
    return x


def u_neg(x: Bits) -> Bits:
    return Bits(-x.bits if x.width < 64 else _wrap(-_dec(x.bits)), x.width).resize(x.width)


def u_inv(x: Bits) -> Bits:
    return Bits(F.bitwise_not(x.bits), x.width).resize(x.width)


def u_not(x: Bits) -> Bits:
    return Bits((x.bits == 0).cast("bigint"), 1)


def u_add(a: Bits, b: Bits) -> Bits:
    w = _wide(a, b)
    return Bits(a.bits + b.bits if w < 62 else _wrap(_dec(a.bits) + _dec(b.bits)), w).resize(w)


def u_sub(a: Bits, b: Bits) -> Bits:
    w = _wide(a, b)
    return Bits(a.bits - b.bits if w < 62 else _wrap(_dec(a.bits) - _dec(b.bits)), w).resize(w)


def u_mul(a: Bits, b: Bits) -> Bits:
    """Product; modulo 2^64 it does not matter that the factors are taken as signed.

    A signed product is at most 2^126, which a 38-digit decimal holds.
    """
    w = _wide(a, b)
    if a.width + b.width < 63:
        return Bits(a.bits * b.bits, w).resize(w)
    return Bits(_wrap(a.bits.cast("decimal(19,0)") * b.bits.cast("decimal(19,0)")), w).resize(w)


def u_div(a: Bits, b: Bits) -> Bits:
    """Quotient; dividing by 0 is not known."""
    w = _wide(a, b)
    if w < 64:
        return Bits(F.call_function("div", a.bits, F.nullif(b.bits, F.lit(0).cast("bigint"))), w).resize(w)
    # Only dividing by 1 gives a quotient of more than 63 bits.
    divisor = F.when(b.bits != 0, _unsigned(b.bits))
    return Bits(F.when(b.bits == 1, a.bits).otherwise(F.call_function("div", _unsigned(a.bits), divisor)), w).resize(w)


def u_mod(a: Bits, b: Bits) -> Bits:
    """Remainder; dividing by 0 is not known."""
    w = _wide(a, b)
    if w < 64:
        return Bits(F.try_mod(a.bits, b.bits), w).resize(w)
    return Bits(_wrap(F.try_mod(_unsigned(a.bits), _unsigned(b.bits))), w).resize(w)


def u_and(a: Bits, b: Bits) -> Bits:
    return Bits(a.bits.bitwiseAND(b.bits), _wide(a, b))


def u_or(a: Bits, b: Bits) -> Bits:
    return Bits(a.bits.bitwiseOR(b.bits), _wide(a, b))


def u_xor(a: Bits, b: Bits) -> Bits:
    return Bits(a.bits.bitwiseXOR(b.bits), _wide(a, b))


def _shift(name: str, a: Bits, b: Bits) -> Bits:
    """Java shifts use six bits of the amount; an amount of 64 or more clears the value instead."""
    moved = F.call_function(name, a.bits, b.bits.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    if b.width > 6:
        moved = moved.bitwiseAND(-(F.shiftrightunsigned(b.bits, 6) == 0).cast("bigint"))
    return Bits(moved, a.width).resize(a.width)


def u_shl(a: Bits, b: Bits) -> Bits:
    return _shift("shiftleft", a, b)


def u_shr(a: Bits, b: Bits) -> Bits:
    return _shift("shiftrightunsigned", a, b)


def _flag(test: Column) -> Bits:
    return Bits(test.cast("bigint"), 1)


def u_eq(a: Bits, b: Bits) -> Bits:
    return _flag(a.bits == b.bits)


def u_ne(a: Bits, b: Bits) -> Bits:
    return _flag(a.bits != b.bits)


def u_lt(a: Bits, b: Bits) -> Bits:
    return _flag(unsigned_lt(a.bits, b.bits))


def u_le(a: Bits, b: Bits) -> Bits:
    return _flag(~unsigned_lt(b.bits, a.bits))


def u_gt(a: Bits, b: Bits) -> Bits:
    return u_lt(b, a)


def u_ge(a: Bits, b: Bits) -> Bits:
    return u_le(b, a)


def u_land(a: Bits, b: Bits) -> Bits:
    """Logical and. Bitwise on flags, because SQL's AND would know ``false AND unknown``."""
    return Bits(_flag(a.bits != 0).bits.bitwiseAND(_flag(b.bits != 0).bits), 1)


def u_lor(a: Bits, b: Bits) -> Bits:
    """Logical or, also not known as soon as one operand is not."""
    return Bits(_flag(a.bits != 0).bits.bitwiseOR(_flag(b.bits != 0).bits), 1)
