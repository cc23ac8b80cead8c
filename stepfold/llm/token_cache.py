"""Token counts through a cache keyed by the digests of text and tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm.text import in_batches
from stepfold.llm.tokens import count_tokens

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, so that another version never meets the counts of this one."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def counted(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of their whole texts; counts already in ``cache`` are not made again.

    A text is normalised only where that can't change a count: null becomes empty. One row of each digest that the cache lacks
    is encoded, and the new counts are appended to the cache. A count stored twice, by a job that ran again, is read once.
    Other columns, repeated rows and rows without ``doc_id`` stay. Hot texts: digests are counted before rows move, and the join
    back by digest is one that Spark splits.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    stored = (_stored(spark, cache).filter(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    # One text of each digest: a partial aggregate leaves at most one per task and digest before rows move.
    misses = texts.dropDuplicates(["digest"]).join(stored, "digest", "left_anti")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"digest": frame["digest"], "n_tokens": count_tokens(tokenizer, frame["text"].tolist())})

    new = in_batches(misses).mapInPandas(encode, "digest binary, n_tokens long").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    new.write.mode("append").parquet(cache)
    counts = (_stored(spark, cache).filter(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*own, F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("__digest"))
    return keyed.join(counts.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")
