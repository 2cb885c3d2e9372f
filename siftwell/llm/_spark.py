"""Session helpers: the shared checkpoint folder and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary one and any other raises."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = context._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siftwell-checkpoint-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; later plans read it, also after executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def grouped(df: DataFrame, keys: list[str], first: list[Column], then: list[Column], ways: int = 16) -> DataFrame:
    """df grouped by keys in two steps: by key and one of `ways` salts, then by key.

    Each map task leaves one partial row of a frequent key, so a plain aggregate of such a key reads as many rows in one
    task as there were map tasks; here it reads `ways` at most. `then` merges the columns that `first` makes.
    """
    salted = df.withColumn("salt_", F.spark_partition_id() % ways).groupBy(*keys, "salt_").agg(*first)
    return salted.groupBy(*keys).agg(*then)


def looked_up(rows: DataFrame, known: DataFrame, key: str, n: str = "n", parts: int = 256) -> DataFrame:
    """rows with the columns of `known`, which has each key once and the number `n` of rows that hold it; null where there is none.

    At most `parts` keys hold as much as 1/parts of all rows: these are broadcast. Their rows and those with a null key
    then have a salt that nothing else has, so the shuffle join of all other rows deals them evenly and matches none.
    """
    known = saved(known)
    total = known.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often = F.col(n) * parts >= total
    more = [c for c in known.columns if c not in (key, n)]
    few = known.where(often).select(F.col(key).alias("key_"), F.lit(True).alias("often_"), *[F.col(c).alias(f"{c}_few_") for c in more])
    many = known.where(~often).select(F.col(key).alias("key_"), F.lit(0).cast("long").alias("salt_"), *more)
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("key_"), "left").drop("key_")
    salt = F.when(F.col("often_") | F.col(key).isNull(), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    joined = marked.withColumn("salt", salt).join(many, (F.col(key) == F.col("key_")) & (F.col("salt") == F.col("salt_")), "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"{c}_few_"), F.col(c)).alias(c) for c in more])


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node in the undirected `edges` (a, b); component is the smallest node reachable.

    Alternating large and small stars: each round is grouped minima and equi-joins over
    the edges, no neighbour list is gathered, and a path of length n needs about log n rounds.
    Edges with a null end or equal ends are ignored; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    last = None
    for _ in range(most_rounds):
        edges = saved(edges)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            break
        last = seen
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
    else:
        raise RuntimeError(f"no fixed point of components in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
