"""Running an arm: controls first, then the ranking, its scores, and the artifacts; rescoring from artifacts; the command line.

    python -m siftwell.plans.runner --folder data/scifact --arm bm25 --out results/bm25
"""

from __future__ import annotations

import argparse
import json
import platform
import subprocess
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import evaluation as E
from siftwell.operators import extraction as X
from siftwell.operators import graph as G
from siftwell.operators import retrieval as R
from siftwell.operators import stats as B
from siftwell.plans.lineage import saved
from siftwell.sources import files


def environment(spark: SparkSession, folder: str = ".", allow_changes: bool = False) -> dict[str, object]:
    """What ran a measurement: versions, settings, and the sources' commit and state, where git knows them."""

    def git(*words: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=True).stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            return None

    status = git("status", "--porcelain")
    tree = E.clean_tree(status, allow_changes) if status is not None else {"clean": None}
    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}
    return {"spark": spark.version, "python": platform.python_version(), "numpy": np.__version__, "commit": git("rev-parse", "HEAD"), "tree": tree, "conf": conf}


def run_arm(arm: R.Arm, docs: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 100, out: str | None = None, ndcg: tuple[int, ...] = (10,), recall: tuple[int, ...] = (10, 100), after: Callable[[dict], None] | None = None, about: dict | Callable[[], dict] | None = None) -> tuple[DataFrame, dict]:
    """(per-query scores, summary). A control that fails raises before anything is written; `after` may raise too."""
    if k < 10:
        raise ValueError("k is 10 at least, as ndcg_10 is reported")
    E.gold_present(qrels, docs)
    E.one_row_each(docs)
    run = saved(arm(docs, queries, k))
    E.no_terms_no_rows(run, queries)
    E.strict_order(R.strictly_decreasing(run))
    scores = E.metrics(queries, run, qrels, ndcg, recall)
    measures = [c for c in scores.columns if c != "query_id"]
    row = scores.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures]).first().asDict()
    more = about() if callable(about) else about or {}
    empty = E.empty_queries(scores, run).count()
    summary = {k_: v if k_ == "queries" else round(v, 6) for k_, v in row.items()} | {"retrieved_nothing": empty} | more | {"spark": docs.sparkSession.version}
    if after:
        after(summary)
    if out:
        files.write_run(run, qrels, f"{out}/per_query")
        docs.sparkSession.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.text(f"{out}/summary")
    return scores, summary


def rescore(spark: SparkSession, path: str, ndcg: tuple[int, ...] = (10,), recall: tuple[int, ...] = (10, 100)) -> dict[str, dict[str, float]]:
    """Means with intervals from the stored order of a run, without retrieving again: measure -> mean, low, high."""
    run, qrels = files.read_run(spark, path), files.read_gold(spark, path)
    scores = E.metrics(qrels.select("query_id").distinct(), run, qrels, ndcg, recall).orderBy("query_id").toPandas()
    return {m: dict(zip(("mean", "low", "high"), B.bootstrap_mean(scores[m].to_numpy(float)), strict=True)) for m in scores.columns if m != "query_id"}


def graph_arm(extractor: X.Extractor | None = None, damping: float = 0.5, specific: bool = True, mean: bool = False, indexed: DataFrame | None = None) -> R.Arm:
    """The entity graph: built from `indexed`, or from the corpus that is ranked, which must be the same."""

    def arm(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        if indexed is not None:
            E.same_corpus(indexed, docs)
        by = extractor or X.LongTokens()
        inc = saved(G.incidence(X.mentions(docs, by)))
        named = G.incidence(X.mentions(queries.select(F.col("query_id").alias("doc_id"), "text"), by)).select(F.col("doc_id").alias("query_id"), "node")
        return G.retrieve(inc, G.seeds(named, G.nodes(inc), specific), k, mean, damping)

    return arm


def arms() -> dict[str, R.Arm]:
    """The rankers by name."""
    cells = {f"lexical-{R.cell_name(m)}": R.lexical_arm(*c) for m, c in enumerate(R.CELLS)}
    dense = R.dense_arm(R.HashedWords())
    return cells | {"bm25": R.lexical_arm(), "coordination": R.coordination_arm(), "substring": R.coordination_arm(False), "dense": dense, "hybrid": R.hybrid_arm(R.lexical_arm(), dense), "graph": graph_arm(), "anchor": R.anchor}


def main(words: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(description="Ranks a corpus for its queries and scores the ranking.")
    parser.add_argument("--folder", required=True, help="corpus.jsonl, queries.jsonl and qrels/test.tsv")
    parser.add_argument("--arm", choices=sorted(arms()), default="bm25")
    parser.add_argument("--top-k", type=int, default=100)
    parser.add_argument("--queries", type=int, help="a seeded sample of so many queries; the corpus is whole")
    parser.add_argument("--out")
    given = parser.parse_args(words)
    spark = SparkSession.builder.getOrCreate()
    docs, queries, qrels = files.load(spark, given.folder)
    if given.queries:
        queries = B.select_queries(queries, given.queries)
        qrels = qrels.join(queries, "query_id", "left_semi")
    _, summary = run_arm(arms()[given.arm], docs, queries, qrels, given.top_k, given.out, about=lambda: {"arm": given.arm, "python": platform.python_version()})
    print(json.dumps(summary, indent=2))
    return summary


if __name__ == "__main__":
    main()
