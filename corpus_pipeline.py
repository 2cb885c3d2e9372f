"""A corpus pipeline: STAGES over documents, each stage's rows written as Parquet and read again by the next.

toxicity      documents that the classifier rejects go
simhash       one document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, that with the smallest doc_id
contamination documents that hold a benchmark item go
secrets       spans found are replaced in the text (n_chars follows); all documents stay
mixing        documents that the mix takes, with the number of copies

All stages but the last return the columns of documents; the last adds size, copies and taken, in
place of columns of those names. Rows are told apart by doc_id and text, so null and repeated ids
cost no clean document: each row passes or goes by its own text. Of rows equal in both one stays,
that with the least other columns, read as JSON. A group of near-duplicates without any doc_id keeps
the row with the least hash of its text. Columns may have any names and types: those that a stage adds
for itself are named as no column of docs is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm import decontamination, mixing, secrets, simhash, toxicity
from siftwell.llm._spark import checkpoint_dir
from siftwell.llm.queries import held_out

#: SQL can't express the stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out(5, 0)))
    return toxicity.score(docs, model, keep=docs.columns)


def _key() -> Column:
    """A row's identity: rows without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def _own(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _is(docs: DataFrame, key: str) -> Column:
    """Whether a row of docs has that key."""
    return docs.doc_id.eqNullSafe(F.col(f"{key}.id")) & (F.xxhash64(docs.text) == F.col(f"{key}.hash"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.similar(docs.select(_key().alias("key"), "text"), id_col="key")
    kept_key, kept_text, kept_rest = (_own(docs, c) for c in ("kept_key", "kept_text", "kept_rest"))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept_key)).distinct()
    rows = docs.join(kept, _is(docs, kept_key), "left_semi")
    # rows equal in id and text become one by a partial aggregate, however many there are
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    one = rows.groupBy(_key().alias(kept_key)).agg(F.any_value("text").alias(kept_text), F.min_by(rest, F.to_json(rest)).alias(kept_rest))
    named = {"doc_id": F.col(f"{kept_key}.id"), "text": F.col(kept_text)}
    return one.select(*[named.get(c, F.col(kept_rest).getField(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontamination.contained(docs.select(_key().alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    leaking = _own(docs, "leaking")
    return docs.join(leaks.select(F.col("doc_id").alias(leaking)).distinct(), _is(docs, leaking), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(_key().alias("key"), "text", "source"), id_col="key").where("taken > 0")
    key, of, mix, nth = (_own(docs, c) for c in ("mix_key", "mix_of", "mix_taken", "mix_nth"))
    taken = mixed.groupBy(F.col("doc_id").alias(key), F.col("source").alias(of)).agg(F.struct(F.sum("copies").alias("copies"), F.count("*").alias("rows"), F.max("size").alias("size")).alias(mix))
    kept = [c for c in docs.columns if c.lower() not in ("size", "copies", "taken")]
    # of rows that share id, text and source, those come first whose other columns have the least hash, read as JSON
    order = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept])))
    joined = docs.join(taken, _is(docs, key) & docs.source.eqNullSafe(F.col(of))).select(*[docs[f"`{c}`"] for c in kept], mix)
    # copies of rows that share id, text and source are dealt to them in turn
    joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy(order)))
    copies = F.floor((F.col(f"{mix}.copies") + F.col(f"{mix}.rows") - F.col(nth)) / F.col(f"{mix}.rows")).cast("long")
    size = F.col(f"{mix}.size")
    return joined.where(copies > 0).select(*[F.col(f"`{c}`") for c in kept], size.alias("size"), copies.alias("copies"), (size * copies).alias("taken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
