"""The registered queries of this subpackage, over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm import collocations, fingerprint, hard_negatives, license_scan, line_dedup, mixing, near_dedup, packing, piece_codec, quality, token_cache, toxicity, url_reputation
from stepfold.plans.lineage import scratch

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents").select("doc_id", "text")).drop("text", "clean_text", "lost_share")


@query
def op2_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op3_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.groups(table(spark, d, "documents"))


@query
def op4_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


@query
def op5_url_reputation(spark: SparkSession, d: str) -> DataFrame:
    """A page is labelled through the document that its url names; a bad outcome is low quality or toxicity."""
    pages = table(spark, d, "pages").select("page_id", "url")
    named = pages.select("page_id", F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT)").alias("doc_id"))
    labels = table(spark, d, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    outcomes = named.join(labels, "doc_id").select("page_id", "bad")
    return url_reputation.judge(pages, outcomes, url_reputation.RULES).drop("url", "host_sd")


@query
def op6_paragraph_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, d, "documents"))


@query
def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan(table(spark, d, "documents")).drop("blocks")


@query
def op8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """A cold cache, so that every distinct text is encoded; a pipeline names a lasting one."""
    counts = token_cache.counted(table(spark, d, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), scratch(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, the lines that go and the earlier lines that they match."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return (docs.select("doc_id").join(line_dedup.removed_lines(docs), "doc_id", "left")
            .select("doc_id", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "lines", "matches"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@query
def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Learns from the labels that are not held out; a null doc_id is not."""
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return hard_negatives.mined(table(spark, d, "embeddings").select("vec_id", "label", "embedding"))


@query
def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents").select("lang", "text"))


@query
def op13_piece_codec(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    rows = piece_codec.encoded(table(spark, d, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


SQL: dict[str, str] = {
    "op1_quality_rules": quality.OP1_SQL,
    "op4_source_mixing": mixing.OP4_SQL,
    "op5_url_reputation": url_reputation.OP5_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
