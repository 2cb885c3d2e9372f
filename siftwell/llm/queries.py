"""Queries over the operators of this package, by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontamination, embeddings, licenses, lm, mixing, resampling, secrets, simhash, toxicity, warc
from siftwell.llm.oracles import oracle_sql  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents = _table("documents")


labels = _table("labels")


def op1_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), spans=False)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def held_out(of: int, is_: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == is_, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir).where(~held_out(5, 0)))
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table("embeddings")(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_of(warc.read(warc.write(_table("pages")(spark, sf_dir)), payloads=False))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(documents(spark, sf_dir), ~held_out(7, 2))
    return found.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(documents(spark, sf_dir), _table("benchmark")(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}
