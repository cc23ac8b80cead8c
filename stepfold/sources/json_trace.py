"""Trace documents in JSON: reading with errors set aside, extents, and writing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.functions.names import trim
from stepfold.functions.values import ABSENT_TEXT, export_text, normalize_values, with_text
from stepfold.operators.blocks import spread_join
from stepfold.schema import DEFAULT_END, DEFAULT_START, DEFAULT_TIMESCALE, DEFAULT_TITLE

# Values may be text, numbers or booleans, and a time that is not text is an error, so both are
# read as variants that keep their JSON type.
DOCUMENT = T.StructType([
    T.StructField("meta", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("title", T.VariantType()), T.StructField("timescale", T.VariantType()),
        T.StructField("start", T.VariantType()), T.StructField("end", T.VariantType())])),
    T.StructField("signals", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.VariantType()), T.StructField("kind", T.VariantType()),
        T.StructField("width", T.VariantType()), T.StructField("radix", T.VariantType()),
        T.StructField("samples", T.ArrayType(T.ArrayType(T.VariantType())))]))),
])
# Radix names of a document.
RADICES = ["bin", "hex", "dec", "int", "uint", "float", "int64", "uint64", "double"]


@dataclass(frozen=True)
class JsonTrace:
    """Tables of a set of documents; ``errors`` lists what a strict reader would refuse."""

    meta: DataFrame
    signals: DataFrame
    samples: DataFrame
    errors: DataFrame


def _text(v: Column) -> Column:
    """The text of a JSON string, null for any other type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _tick(v: Column) -> Column:
    """A 64-bit time written as a string; null for anything else."""
    return trim(_text(v)).try_cast("bigint")


def _value_text(v: Column) -> Column:
    """Sample value as text: strings as they are, numbers as whole numbers, booleans as 1 and 0."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "decimal(20,0)")
    return (F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "1").otherwise("0"))
            .when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), number.cast("string"))
            .otherwise("x"))


def parse_json_traces(documents: DataFrame, absent_text: str = ABSENT_TEXT) -> JsonTrace:
    """Tables from documents (trace_id, text). Documents of one trace are parts of it.

    A signal is numbered by its place in the document, or has the ``id`` that an export in parts gives it.
    """
    parsed = documents.select("trace_id", F.from_json("text", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"))
    meta = parsed.select(
        "trace_id", F.col("d.meta").isNotNull().alias("has_meta"),
        F.coalesce(_text(F.col("d.meta.title")), F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce(_text(F.col("d.meta.timescale")), F.lit(DEFAULT_TIMESCALE)).alias("timescale"),
        _tick(F.col("d.meta.start")).alias("start"), _tick(F.col("d.meta.end")).alias("end"),
        F.coalesce(F.size("d.signals"), F.lit(-1)).alias("n"))
    signal = parsed.select("trace_id", F.posexplode("d.signals").alias("i", "s"))
    number = F.coalesce(F.col("s.id"), (F.col("i") + 1).cast("bigint")).alias("signal_id")
    kind = F.when(F.lower(trim(_text(F.col("s.kind")))) == "bus", "bus").otherwise("bit")
    given = F.lower(trim(_text(F.col("s.radix"))))
    radix = (F.when(given.isNull(), F.when(kind == "bus", "hex").otherwise("bin"))
             .when(given.isin(RADICES), given).otherwise("bin"))
    width = F.try_variant_get(F.col("s.width"), "$", "int")
    signals = signal.select(
        "trace_id", number, _text(F.col("s.name")).alias("name"), kind.alias("kind"),
        F.greatest(F.coalesce(width, F.lit(1)), F.lit(1)).alias("width"), radix.alias("radix"),
        F.col("s.samples").isNull().alias("no_samples"))
    sample = signal.select(
        "trace_id", number, kind.alias("kind"),
        F.greatest(F.coalesce(width, F.lit(1)), F.lit(1)).alias("width"), F.posexplode("s.samples").alias("seq", "item"))
    sample = sample.select(
        "trace_id", "signal_id", "kind", "width", F.col("seq").cast("bigint").alias("seq"), F.size("item").alias("parts"),
        _tick(F.get("item", F.lit(0))).alias("cycle"), _value_text(F.get("item", F.lit(1))).alias("value"))
    good = sample.where("parts >= 2 AND cycle IS NOT NULL")
    samples = normalize_values(good, absent_text).select("trace_id", "signal_id", "cycle", "seq", "value", "raw_bits", "state")

    def errors(rows: DataFrame, rule: str, signal_id: Column | None = None, seq: Column | None = None) -> DataFrame:
        null = F.lit(None).cast("bigint")
        return rows.select("trace_id", (null if signal_id is None else signal_id).alias("signal_id"),
                           (null if seq is None else seq).alias("seq"), F.lit(rule).alias("rule"))

    sid, seq = F.col("signal_id"), F.col("seq")
    found = (errors(meta.where("n < 0"), "signals_missing")
             .unionByName(errors(meta.where("n = 0"), "signals_empty"))
             .unionByName(errors(meta.where("has_meta AND start IS NULL"), "meta_start_not_text"))
             .unionByName(errors(meta.where("has_meta AND `end` IS NULL"), "meta_end_not_text"))
             .unionByName(errors(signals.where("coalesce(name, '') = ''"), "name_missing", sid))
             .unionByName(errors(signals.where("no_samples"), "samples_missing", sid))
             .unionByName(errors(sample.where("parts < 2"), "sample_too_short", sid, seq))
             .unionByName(errors(sample.where("parts >= 2 AND cycle IS NULL"), "time_not_text", sid, seq)))
    heads = meta.select("trace_id", F.struct(
        "title", "timescale", F.coalesce("start", F.lit(DEFAULT_START).cast("bigint")).alias("start"),
        F.coalesce("end", F.lit(DEFAULT_END).cast("bigint")).alias("end")).alias("head"))
    heads = heads.groupBy("trace_id").agg(F.min("head").alias("head")).select("trace_id", "head.*")
    # One row per signal: its parts carry the same columns.
    columns = [F.min(c).alias(c) for c in ("name", "kind", "width", "radix")]
    return JsonTrace(trace_extents(heads, samples), signals.groupBy("trace_id", "signal_id").agg(*columns), samples, found)


def read_json_trace(spark: SparkSession, path: str, absent_text: str, lines: bool = False) -> JsonTrace:
    """Read one document per file, or with ``lines`` one per line, in parallel over them.

    ``absent_text`` is the marker of an absent value in these files. A file is named by its full path; a line names its
    trace by ``meta.id``, else its title, else its file.
    """
    files = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    if lines:
        name = F.coalesce(F.get_json_object("value", "$.meta.id"), F.get_json_object("value", "$.meta.title"), "file")
    else:
        name = F.col("file")
    return parse_json_traces(files.select(name.alias("trace_id"), F.col("value").alias("text")), absent_text)


def trace_extents(meta: DataFrame, samples: DataFrame) -> DataFrame:
    """Range of each trace: the header's if it is one, else that of its samples, else 0..100."""
    seen = samples.groupBy("trace_id").agg(F.min("cycle").alias("lo"), F.max("cycle").alias("hi"))
    joined = meta.join(seen, "trace_id", "left")
    kept, sampled = F.col("end") > F.col("start"), F.coalesce(F.col("hi") > F.col("lo"), F.lit(False))

    def pick(own: str, other: str, default: int) -> Column:
        return F.when(kept, F.col(own)).when(sampled, F.col(other)).otherwise(F.lit(default).cast("bigint"))

    return joined.select("trace_id", "title", "timescale", pick("start", "lo", DEFAULT_START).alias("start"),
                         pick("end", "hi", DEFAULT_END).alias("end"))


def export_rows(signals: DataFrame, transitions: DataFrame, absent_text: str = ABSENT_TEXT) -> DataFrame:
    """Export text of every transition: the columns of ``signals``, cycle and text."""
    joined = spread_join(transitions, signals, ["trace_id", "signal_id"], "cycle")
    columns = [F.col(c) for c in ("raw_bits", "state", "kind", "width", "radix")]
    texts = with_text(joined, lambda floats: export_text(*columns, with_floats=floats, absent_text=absent_text))
    return texts.select(*signals.columns, "cycle", "text")


def json_lines(meta: DataFrame, signals: DataFrame, transitions: DataFrame, part_cycles: int = 1 << 16,
               absent_text: str = ABSENT_TEXT) -> DataFrame:
    """JSON lines of a trace: each a document with the header and one signal's samples of one stretch of cycles.

    A line never holds more than ``part_cycles`` samples, so a signal with 10^8 events is many
    lines and no group grows with the trace. ``part`` orders the lines of a signal. Signals
    without samples get one empty line. ``id`` tells the parts of a trace and of a signal that belong together.
    """
    head = meta.select("trace_id", F.struct(
        F.col("trace_id").alias("id"), "title", "timescale", F.col("start").cast("string").alias("start"),
        F.col("end").cast("string").alias("end")).alias("meta"))
    shift = part_cycles.bit_length() - 1
    key, own = ["trace_id", "signal_id"], ["name", "kind", "width", "radix", "meta"]
    described = signals.select(*key, *own[:-1]).join(head, "trace_id", "left").select(*key, *own)
    pairs = export_rows(described, transitions, absent_text).groupBy(*key, *own, F.shiftright("cycle", shift).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("cycle", "text"))).alias("pairs"))
    silent = described.join(transitions.select(*key).distinct(), key, "left_anti").select(
        *key, *own, F.lit(0).cast("bigint").alias("part"), F.array().cast("array<struct<cycle:bigint,text:string>>").alias("pairs"))
    samples = F.transform("pairs", lambda p: F.array(p["cycle"].cast("string"), p["text"]))
    signal = F.struct(F.col("signal_id").alias("id"), "name", "kind", "width", "radix", samples.alias("samples"))
    body = F.to_json(F.struct("meta", F.array(signal).alias("signals")))
    return pairs.unionByName(silent).select(*key, "part", body.alias("line"))


def write_json_trace(meta: DataFrame, signals: DataFrame, transitions: DataFrame, path: str, absent_text: str,
                     part_cycles: int = 1 << 16) -> None:
    """Write traces as gzipped JSON lines in signal and time order, one folder per trace.

    ``read_json_trace`` with ``lines`` and the same ``absent_text`` reads them back.
    """
    lines = json_lines(meta, signals, transitions, part_cycles, absent_text)
    (lines.repartitionByRange("trace_id", "signal_id", "part").sortWithinPartitions("trace_id", "signal_id", "part")
     .select("trace_id", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("trace_id").option("compression", "gzip").text(path))
