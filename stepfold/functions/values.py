"""Value text to bits, and bits to value text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stepfold.functions.bits import mask_of, unsigned_text
from stepfold.functions.names import trim
from stepfold.operators.blocks import spread_join
from stepfold.schema import ABSENT, HIGH_Z, KNOWN, state

# Marker of an absent value in texts made here. Files have one of their own, which their reader and writer are told.
ABSENT_TEXT = "__ABSENT__"
# Display forms of an absent value and of Z.
ABSENT_SHOWN, Z_SHOWN = "-", "Z"
# Fixed value: the largest unsigned 64-bit number in decimal.
MAX_U64 = "18446744073709551615"
FLOAT_RADICES = ("float", "double")


def _digits(text: Column, pattern: str, base: int) -> Column:
    """Bits of a run of digits, null when the text is something else or exceeds 64 bits."""
    digits = F.regexp_extract(text, pattern, 1)
    short = F.regexp_replace(digits, "^0+", "")
    fits = {
        16: F.length(short) <= 16,
        2: F.length(short) <= 64,
        10: (F.length(short) < len(MAX_U64)) | ((F.length(short) == len(MAX_U64)) & (short <= MAX_U64)),
    }[base]
    # conv raises on overflow, so it only ever sees digits that fit.
    safe = F.when((F.length(digits) > 0) & fits, F.when(F.length(short) == 0, "0").otherwise(short))
    return F.conv(safe, base, -10).cast("bigint")


def text_bits(text: Column) -> Column:
    """Bits of a value text. Decimal is tried before hexadecimal; what is neither is 0."""
    t = trim(text)
    number = (F.when(t.rlike("^0[xX]"), _digits(t, "^0[xX]([0-9a-fA-F]+)$", 16))
              .when(t.rlike("^0[bB]"), _digits(t, "^0[bB]([01]+)$", 2))
              .when(t.rlike("^[0-9]+$"), _digits(t, "^([0-9]+)$", 10))
              .otherwise(_digits(t, "^([0-9a-fA-F]+)$", 16)))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def text_state(text: Column, absent_text: str = ABSENT_TEXT) -> Column:
    t = trim(text)
    return (F.when(t == absent_text, state(ABSENT)).when(F.lower(t) == "z", state(HIGH_Z)).otherwise(state(KNOWN)))


def normalize_values(rows: DataFrame, absent_text: str = ABSENT_TEXT) -> DataFrame:
    """(kind, width, value text) to (raw_bits, state); a one-bit signal is 1 only for exactly ``1``."""
    st = text_state(F.col("value"), absent_text)
    bits = (F.when(st != KNOWN, F.lit(0).cast("bigint"))
            .when(F.col("kind") == "bit", (trim(F.col("value")) == "1").cast("bigint"))
            .otherwise(text_bits(F.col("value")).bitwiseAND(mask_of(F.col("width")))))
    return rows.withColumns({"raw_bits": bits, "state": st})


def _padded(text: Column, size: Column) -> Column:
    missing = F.greatest(size - F.length(text), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("0"), missing), text)


def _with_point(text: str) -> str:
    """A float text always shows a decimal point; inf and nan stay as they are."""
    if "n" in text:
        return text
    mantissa, e, exponent = text.partition("e")
    return text if "." in mantissa else f"{mantissa}.0{e}{exponent}"


def _float_text(significant: tuple[int, int], force_point: bool):
    short, long = significant

    @F.pandas_udf(StringType())
    def shown(bits: pd.Series, double: pd.Series) -> pd.Series:
        raw = bits.fillna(0).to_numpy(dtype=np.int64)
        singles = (raw & 0xFFFFFFFF).astype(np.uint32).view(np.float32).astype(np.float64)
        doubles = raw.view(np.float64)
        out = []
        for is_double, s, d in zip(double, singles, doubles):
            text = f"%.{long}g" % d if is_double else f"%.{short}g" % s
            out.append(_with_point(text) if force_point else text)
        return pd.Series(out)

    return shown


def value_text(bits: Column, st: Column, width: Column, radix: Column, with_floats: bool = True) -> Column:
    """Display text of a value.

    Text of 32 and 64 bit floats needs C-style ``%g`` digits, which Spark SQL has no function for;
    it is the only part in Python, and only planned ``with_floats``, for rows that have such a radix.
    """
    masked = bits.bitwiseAND(mask_of(width))
    unsigned = unsigned_text(masked)
    signed32 = F.when(masked >= 1 << 31, masked - F.lit(1 << 32).cast("bigint")).otherwise(masked)
    text = (F.when(st == ABSENT, ABSENT_SHOWN).when(st == HIGH_Z, Z_SHOWN)
            .when(radix == "bin", _padded(F.bin(masked), F.greatest(width, F.lit(1))))
            .when(radix == "hex", _padded(F.hex(masked), F.greatest(F.ceil(width / 4).cast("int"), F.lit(1))))
            .when(radix == "int", F.when(width == 32, signed32.cast("string")).otherwise(masked.cast("string")))
            .when(radix.isin("int64", "uint64") & (width != 64), "N/A")
            .when(radix == "int64", masked.cast("string"))
            .when((radix == "float") & (width != 32), "N/A")
            .when((radix == "double") & (width != 64), "N/A"))
    if with_floats:
        is_float = radix.isin(*FLOAT_RADICES)
        shown = _float_text((8, 16), True)(F.when(is_float, masked), radix == "double")
        text = text.when(is_float, shown)
    return text.otherwise(unsigned)


def format_values(transitions: DataFrame, signals: DataFrame, radix: str | None = None) -> DataFrame:
    """Transitions with display text, in one radix or in each signal's own ``radix``."""
    own = F.col("radix") if radix is None else F.lit(radix)
    lookup = signals.select("trace_id", "signal_id", "width", own.alias("radix"))
    joined = spread_join(transitions, lookup, ["trace_id", "signal_id"], "cycle")
    columns = [F.col(c) for c in ("raw_bits", "state", "width", "radix")]
    return with_text(joined, lambda floats: value_text(*columns, with_floats=floats), radix).select(
        "trace_id", "signal_id", "cycle", "text")


def with_text(rows: DataFrame, text: Callable[[bool], Column], radix: str | None = None) -> DataFrame:
    """Add ``text``; only rows with a float radix go through Python. ``radix`` is known or each row's own."""
    if radix is not None:
        return rows.withColumn("text", text(radix in FLOAT_RADICES))
    is_float = F.coalesce(F.col("radix").isin(*FLOAT_RADICES), F.lit(False))
    return rows.where(~is_float).withColumn("text", text(False)).unionByName(
        rows.where(is_float).withColumn("text", text(True)))


def export_text(bits: Column, st: Column, kind: Column, width: Column, radix: Column, with_floats: bool = True,
                absent_text: str = ABSENT_TEXT) -> Column:
    """Text of a value in an export: prefixed, and a known bit is ``0`` or ``1``."""
    size = F.greatest(width, F.lit(1))
    masked = bits.bitwiseAND(mask_of(size))
    text = (F.when(st == ABSENT, absent_text).when(st == HIGH_Z, Z_SHOWN)
            .when(kind == "bit", bits.bitwiseAND(F.lit(1).cast("bigint")).cast("string"))
            .when(radix == "bin", F.concat(F.lit("0b"), _padded(F.bin(masked), size)))
            .when(radix == "hex", F.concat(F.lit("0x"), _padded(F.hex(masked), F.ceil(size / 4).cast("int")))))
    if with_floats:
        is_float = radix.isin(*FLOAT_RADICES)
        shown = _float_text((9, 17), False)(F.when(is_float, F.when(radix == "double", bits).otherwise(masked)),
                                           radix == "double")
        text = text.when(is_float, shown)
    return text.otherwise(unsigned_text(masked))
