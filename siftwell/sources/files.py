"""Sources and sinks: corpora in JSONL and TSV, parquet tables with nested titles, ranked artifacts, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, title) from JSONL with _id, title, text; text is title and body."""
    raw = spark.read.schema("_id string, title string, text string").json(path)
    return raw.select(F.col("_id").alias("doc_id"), T.title_text(F.col("title"), F.col("text")).alias("text"), F.coalesce("title", F.lit("")).alias("title"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Positive judgements of a TSV file with a header."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("query_id string, doc_id string, rel int").csv(path)
    return raw.where("rel > 0")


def load(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, judged queries, and judgements."""
    judged = qrels(spark, f"{folder}/qrels/{split}.tsv")
    return corpus(spark, f"{folder}/corpus.jsonl"), queries(spark, f"{folder}/queries.jsonl").join(judged, "query_id", "left_semi"), judged


def context(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, slot, title) from parquet with a nested list of titles."""
    return spark.read.parquet(path).select(F.col("id").alias("question_id"), F.posexplode("context.title").alias("slot", "title"))


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, type, context(title, sentences), gold) where facts and contexts are JSON text; exactly two gold titles."""
    pair = lambda c: F.from_json(c, "array<array<string>>")
    raw = spark.read.parquet(path).withColumn("gold", F.array_distinct(F.transform(pair(F.col("supporting_facts")), lambda f: F.get(f, F.lit(0)))))
    parts = F.transform(pair(F.col("context")), lambda x: F.struct(F.get(x, F.lit(0)).alias("title"), F.from_json(F.get(x, F.lit(1)), "array<string>").alias("sentences")))
    return raw.where(F.size("gold") == 2).select("id", "question", "type", parts.alias("context"), "gold")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below path."""
    return spark.read.format("binaryFile").load(path).select("path", T.digest(F.col("content")).alias("sha256"))


def check_manifest(found: DataFrame, recorded: DataFrame) -> None:
    """Raises if a recorded file has another fingerprint now."""
    name = F.element_at(F.split("path", "/"), -1)
    changed = found.select(name.alias("name"), "sha256").join(recorded.select(name.alias("name"), F.col("sha256").alias("was")), "name").where("sha256 <> was").limit(1).collect()
    if changed:
        raise ValueError(f"{changed[0].name} has changed since it was recorded")


def write_run(run: DataFrame, qrels_: DataFrame, path: str) -> None:
    """A JSON row for each query: its gold ids, and the ids retrieved in rank order."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    gold = qrels_.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("gold"))
    run.groupBy("query_id").agg(order.alias("retrieved")).join(gold, "query_id", "full").write.mode("errorifexists").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The run that write_run stored: (query_id, doc_id, score, rank), score counting down from the number retrieved."""
    raw = spark.read.schema("query_id string, gold array<string>, retrieved array<string>").json(path)
    rows = raw.select("query_id", F.size("retrieved").alias("n"), F.posexplode("retrieved").alias("at", "doc_id"))
    return rows.select("query_id", "doc_id", (F.col("n") - F.col("at")).cast("double").alias("score"), (F.col("at") + 1).alias("rank"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of the gold ids that write_run stored."""
    return spark.read.schema("query_id string, gold array<string>").json(path).select("query_id", F.explode("gold").alias("doc_id"), F.lit(1).alias("rel"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines below path, in place of what was there: written beside it first, then moved, so a failure leaves the rows before."""
    spark = rows.sparkSession
    target, beside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.new"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").json(f"{path.rstrip('/')}.new")
    fs.delete(target, True)
    if not fs.rename(beside, target):
        raise OSError(f"{path} could not be put in place")


def cached(df: DataFrame, path: str, key: str) -> DataFrame:
    """df kept as parquet under a key, computed only if it isn't there; what is there must have df's columns."""
    spark, at = df.sparkSession, f"{path.rstrip('/')}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(at)
    kept = spark.read.parquet(at)
    if kept.dtypes != df.dtypes:
        raise ValueError(f"{at} holds {kept.dtypes}, not {df.dtypes}")
    return kept


def corpus_fingerprint(docs: DataFrame) -> str:
    """A key of ids and texts that doesn't depend on their order: the sum of row hashes, and their number."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct("doc_id", "text")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = docs.agg(F.count("*"), F.sum(row)).first()
    return f"{n}-{int(total or 0):x}"
