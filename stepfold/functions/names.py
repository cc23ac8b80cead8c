"""Names, paths, ranges and kinds of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# All white space of Unicode.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# A display range such as "[15:0]" after at least one character, digits required.
RANGE_PATTERN = r"^(.+?)\s*\[[0-9:\s]*[0-9][0-9:\s]*\]$"


def trim(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def strip_range(name: Column) -> Column:
    """Drop a trailing display range and the blanks around the name."""
    trimmed = trim(name)
    hit = F.regexp_extract(trimmed, RANGE_PATTERN, 1)
    return F.when(F.length(hit) > 0, hit).otherwise(trimmed)


def leaf_of(path: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(path, ".", -1)


def last_segment(path: Column) -> Column:
    """As ``leaf_of``; an empty path is ``root`` and a trailing dot ``unnamed``."""
    return (F.when(F.length(path) == 0, "root").when(F.endswith(path, F.lit(".")), "unnamed")
            .otherwise(leaf_of(path)))


def child_path(parent: Column, child: Column) -> Column:
    """Compose a path; an index segment such as ``[3]`` follows its parent without a dot."""
    return (F.when(F.length(parent) == 0, child)
            .when(F.startswith(child, F.lit("[")), F.concat(parent, child))
            .otherwise(F.concat(parent, F.lit("."), child)))


def side_path(path: Column, side: str) -> Column:
    """Path of one side of a comparison: the leaf is prefixed with the side."""
    leaf = leaf_of(path)
    parent = F.substr(path, F.lit(1), F.length(path) - F.length(leaf) - 1)
    return F.when(F.contains(path, F.lit(".")), F.concat(parent, F.lit(f".{side} "), leaf)).otherwise(
        F.concat(F.lit(f"{side} "), path))


def with_range(name: Column, width: Column) -> Column:
    return F.when(width <= 1, name).otherwise(F.concat(name, F.lit("["), (width - 1).cast("string"), F.lit(":0]")))


def display_names(signals: DataFrame) -> DataFrame:
    """All display forms of each signal's name."""
    path = F.coalesce("path", F.lit(""))
    named = F.when(F.length(trim(path)) > 0, path).otherwise(
        F.concat(F.lit("sig_"), F.col("signal_id").cast("string")))
    return signals.select(
        "trace_id", "signal_id",
        named.alias("display_name"),
        with_range(named, F.col("width")).alias("ranged_name"),
        strip_range(with_range(named, F.col("width"))).alias("bare_name"),
        last_segment(path).alias("leaf"),
        side_path(named, "A").alias("a_path"),
        side_path(named, "B").alias("b_path"),
        F.concat(F.lit("node_"), F.col("node_id").cast("string")).alias("default_node_name"))


def kind_of(value_type: Column, width: Column) -> Column:
    return F.when((value_type == "Bool") | (width == 1), "bit").otherwise("bus")


def display_radix(radix: Column, value_type: Column, width: Column) -> Column:
    """Radix a signal is shown in, from its declared radix, type and width."""
    auto = (F.when(value_type == "F32", "float").when(value_type == "F64", "double")
            .when(value_type == "I64", "int64").when(value_type == "U64", "uint64")
            .when(value_type.isin("I8", "I16", "I32"), "int")
            .when(value_type.isin("U8", "U16", "U32"), "uint")
            .when((width == 1) | (value_type == "Bool"), "bin")
            .otherwise("hex"))
    wide_float = (width == 64) | (value_type == "F64")
    return (F.when(radix.isin("bin", "dec", "hex"), radix)
            .when(radix == "float", F.when(wide_float, "double").otherwise("float"))
            .otherwise(auto))


def stored_type(runtime_kind: Column, width: Column) -> Column:
    """Stored type of a runtime kind: anything not boolean or float is an integer by width."""
    sign = F.when(runtime_kind == "SignedInt", "I").otherwise("U")
    size = F.when(width <= 8, "8").when(width <= 16, "16").when(width <= 32, "32").otherwise("64")
    return (F.when(runtime_kind == "Bool", "Bool")
            .when(runtime_kind == "Float64", F.when(width <= 32, "F32").otherwise("F64"))
            .otherwise(F.concat(sign, size)))


def default_radix(runtime_kind: Column) -> Column:
    return (F.when(runtime_kind == "Bool", "bin").when(runtime_kind == "SignedInt", "dec")
            .when(runtime_kind == "Float64", "float").otherwise("hex"))


def classify_signals(signals: DataFrame) -> DataFrame:
    """Stored type and radix from (runtime_kind, width) where given, then kind and display radix."""
    typed = signals
    if "runtime_kind" in signals.columns:
        typed = typed.withColumns({
            "value_type": stored_type(F.col("runtime_kind"), F.col("width")),
            "radix": F.coalesce("radix", default_radix(F.col("runtime_kind")))})
    return typed.withColumns({
        "kind": kind_of(F.col("value_type"), F.col("width")),
        "display_radix": display_radix(F.col("radix"), F.col("value_type"), F.col("width"))})
