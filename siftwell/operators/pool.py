"""Pools of titled passages: slots, resolution against a corpus, collisions and text variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_titles(context: DataFrame) -> DataFrame:
    return context.select("title").distinct()


def counts(context: DataFrame, titles: DataFrame) -> DataFrame:
    """Slots, distinct titles, those resolved in the corpus, and those not."""
    pooled = pool_titles(context).join(titles.where("title <> ''").select("title").distinct().withColumn("known", F.lit(1)), "title", "left")
    return context.agg(F.count("*").alias("n_slots")).crossJoin(pooled.agg(F.count("*").alias("n_titles"), F.count("known").alias("n_resolved"), F.count_if(F.col("known").isNull()).alias("n_unresolved")))


def collisions(titles: DataFrame) -> DataFrame:
    return titles.where("title <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


def resolve(context: DataFrame, titles: DataFrame) -> DataFrame:
    """Documents whose title is pooled; raises where a pooled title names several."""
    kept = titles.where("title <> ''").join(pool_titles(context), "title", "left_semi")
    twice = collisions(kept).limit(1).collect()
    if twice:
        raise ValueError(f"title {twice[0].title!r} names {twice[0].n} documents")
    return kept


def majority_text(variants: DataFrame) -> DataFrame:
    """(title, text): the most frequent text of a title, ties by text."""
    n = variants.groupBy("title", "text").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("n"), "text"))
    return n.withColumn("best", best).where("best = 1").select("title", "text", "n")


def gold_contained(gold: DataFrame, titles: DataFrame) -> DataFrame:
    """(n_queries, n_contained) of gold(query_id, title): queries whose gold titles are all pooled."""
    known = gold.join(titles.select("title").distinct().withColumn("known", F.lit(True)), "title", "left")
    return known.groupBy("query_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_in")).agg(F.count("*").alias("n_queries"), F.count_if("all_in").alias("n_contained"))
