"""Extraction of entities: a seam for extractors, a default rule, caches, and samples for annotation."""

from __future__ import annotations

import hashlib
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.stats import sample_ids
from siftwell.sources import files


class Extractor(Protocol):
    """Names what texts mention; `name` tells the cached mentions of one extractor from those of another."""

    name: str

    def extract(self, texts: DataFrame) -> DataFrame:
        """(doc_id, surface, label) of texts(doc_id, text)."""


class LongTokens:
    """The default rule, without a model: distinct tokens of at least so many letters, all of one kept label."""

    def __init__(self, letters: int = 6, label: str = "ORG"):
        self.letters, self.label, self.name = letters, label, f"long-tokens-{letters}-{label}"

    def extract(self, texts: DataFrame) -> DataFrame:
        long = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= self.letters))
        return texts.select("doc_id", F.explode(long).alias("surface"), F.lit(self.label).alias("label"))


def mentions(docs: DataFrame, extractor: Extractor, cache: str | None = None) -> DataFrame:
    """What the extractor finds in docs, kept below `cache` by extractor and content."""
    found = extractor.extract(docs.select("doc_id", "text"))
    if cache:
        found = files.cached(found, cache, f"{hashlib.sha256(extractor.name.encode()).hexdigest()[:16]}-{files.corpus_fingerprint(docs)}")
    return found


def template(docs: DataFrame, size: int = 100, seed: int = 20260820) -> DataFrame:
    """(index, doc_id, text, entities, annotated) of a seeded sample of documents, in the order drawn, nothing filled in."""
    ids = sample_ids([r.doc_id for r in docs.select("doc_id").collect()], size, seed)
    drawn = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"index long, doc_id {dict(docs.dtypes)['doc_id']}")
    return docs.join(F.broadcast(drawn), "doc_id").select("index", "doc_id", "text", F.array().cast("array<string>").alias("entities"), F.lit(False).alias("annotated"))


def annotated(sample: DataFrame, doc_id: object, entities: str) -> DataFrame:
    """sample with what a rater typed for one document, a list with commas."""
    this = F.col("doc_id") == F.lit(doc_id)
    return sample.withColumn("entities", F.when(this, T.comma_list(F.lit(entities))).otherwise(F.col("entities"))).withColumn("annotated", F.col("annotated") | this)


def next_passage(sample: DataFrame) -> DataFrame:
    """The first passage that isn't annotated, or none."""
    return sample.where(~F.col("annotated")).orderBy("index").limit(1)


def progress(sample: DataFrame) -> DataFrame:
    """(n, done)."""
    return sample.agg(F.count("*").alias("n"), F.count_if("annotated").alias("done"))
