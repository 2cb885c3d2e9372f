"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

index_build stores the lexical index once; bm25_stored_top10 is retrieval alone from what is stored, the
other queries start from the tables.
"""

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from siftwell import catalog  # noqa: E402
from siftwell.operators import retrieval  # noqa: E402

HEADLINE = ["bm25_top10", "factorial_scores", "coordination_top10", "coordination_substring_top10", "dense_top10", "rrf_hybrid_top10", "ndcg_recall_bm25", "mean_metrics_by_arm", "entity_incidence", "node_degrees", "ppr_no_walk_top10", "query_properties", "spearman_rho"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="siftwell-bench-")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{folder}/checkpoints"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["tokenize_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up and compilation
    seconds = {}

    def timed(name, run):
        began = time.time()
        out = run()
        if out is not None:
            out.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    try:
        timed("index_build", lambda: retrieval.Index(catalog.docs(spark, sf)).store(f"{folder}/index") and None)
        timed("bm25_stored_top10", lambda: retrieval.lexical(retrieval.Index.load(spark, f"{folder}/index"), catalog.items(spark, sf), 10))
        for name in HEADLINE:
            timed(name, lambda name=name: queries[name](spark, sf))
        print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
        spark.stop()
    finally:
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
