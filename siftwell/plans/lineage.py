"""Cutting lineage in the shared checkpoint folder, and global positions without a task that holds all rows."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir, so later plans read it, also after executors are lost.

    Where no folder is set a local master (tests) gets a temporary one; any other master raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="siftwell-checkpoint-"))
    return df.checkpoint(eager=True)


def positions(df: DataFrame, *order: Column | str, name: str = "place", total: str | None = None) -> DataFrame:
    """df with the place (from 0) of each row by `order`, and with `total` the number of rows.

    Rows are sorted over range partitions; only each partition's count comes to the driver.
    """
    placed = saved(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part_ int, before_ long")
    out = placed.join(F.broadcast(offsets), part == F.col("part_")).withColumn(name, F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)))
    if total:
        out = out.withColumn(total, F.lit(before[-1]).cast("long"))
    return out.drop("at_", "part_", "before_")


def running(df: DataFrame, *order: Column | str, value: str, how: str = "sum", name: str = "running") -> DataFrame:
    """df with the sum or max of `value` up to each row by `order`: within range partitions, and over what comes before each."""
    fold, start = {"sum": (lambda a, b: a + b, 0), "max": (max, float("-inf"))}[how]
    function = {"sum": F.sum, "max": F.max}[how]
    placed = saved(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("at_", 33).cast("int")))
    sizes = sorted((r.part_, r.v) for r in placed.groupBy("part_").agg(function(value).alias("v")).collect())
    before = list(accumulate((v for _, v in sizes), fold, initial=start))
    kind = placed.schema[value].dataType.simpleString()
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], f"p_ int, before_ {'double' if how == 'max' else kind}")
    inner = function(value).over(Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0))
    both = F.col("before_") + inner if how == "sum" else F.greatest("before_", inner)
    return placed.join(F.broadcast(offsets), F.col("part_") == F.col("p_")).withColumn(name, both).drop("at_", "part_", "p_", "before_")


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """df computed once, and marked to be broadcast if it holds no more than `rows` rows; larger ones are joined by shuffle."""
    kept = saved(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
