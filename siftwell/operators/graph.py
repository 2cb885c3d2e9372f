"""An entity graph: documents and the entities they name, walked by personalised PageRank.

Two entities are adjacent where a document names both; the walk goes through documents, so
entity pairs are never made.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.retrieval import contained_runs, top_k
from siftwell.operators.stats import upper_percentile
from siftwell.plans.lineage import positions, saved, small

#: Entity labels that are kept on both sides.
WHITELIST = ["PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE"]


def incidence(mentions: DataFrame) -> DataFrame:
    """Distinct (doc_id, node) of mentions(doc_id, surface, label)."""
    kept = mentions.where(F.col("label").isin(WHITELIST)) if "label" in mentions.columns else mentions
    # what is plain already, as tokens are, isn't cleaned again
    plain = F.length(F.translate("surface", "abcdefghijklmnopqrstuvwxyz0123456789", "")) == 0
    return kept.select("doc_id", F.when(plain, F.col("surface")).otherwise(T.node(F.col("surface"))).alias("node")).where("node <> ''").distinct()


def nodes(inc: DataFrame) -> DataFrame:
    """(node, df, specificity, degree): degree counts walks to other entities through shared documents."""
    sizes = inc.groupBy("doc_id").agg(F.count("*").alias("size"))
    by = inc.join(sizes, "doc_id").groupBy("node").agg(F.count("*").alias("df"), F.sum("size").alias("walks"))
    return by.select("node", "df", (1 / F.col("df")).alias("specificity"), (F.col("walks") - F.col("df")).alias("degree"))


def seeds(query_nodes: DataFrame, graph: DataFrame, specific: bool = True) -> DataFrame:
    """(query_id, node, mass) summing to 1 a query, of query_nodes(query_id, node): by specificity, or each node alike."""
    raw = query_nodes.distinct().join(graph, "node").select("query_id", "node", (F.col("specificity") if specific else F.lit(1.0)).alias("w"))
    total = raw.groupBy("query_id").agg(F.sum("w").alias("t"))
    return raw.join(total, "query_id").select("query_id", "node", (F.col("w") / F.col("t")).alias("mass"))


class Walker:
    """The graph as two edge lists for numpy, one by document and one by node, from numbers of each; the walk of several queries."""

    def __init__(self, d: np.ndarray, n: np.ndarray, docs: int, nodes: int):
        order = np.argsort(d, kind="stable")
        self.node_of, self.doc_start = n[order], np.searchsorted(d, np.arange(docs), sorter=order)
        order = np.argsort(n, kind="stable")
        self.doc_of, self.node_start = d[order], np.searchsorted(n, np.arange(nodes), sorter=order)
        self.df = np.bincount(n, minlength=nodes).astype(float)
        self.degree = np.add.reduceat(np.bincount(d, minlength=docs)[self.doc_of], self.node_start) - self.df if len(n) else self.df

    #: Edges that are summed together: what is gathered for them stays in a processor's cache.
    EDGES = 1 << 16

    @staticmethod
    def sums(x: np.ndarray, of: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Sums of x[of] over the groups that begin at start, none of which is empty."""
        out, low = np.empty(len(start)), 0
        while low < len(start):
            high = max(low + 1, int(np.searchsorted(start, start[low] + Walker.EDGES)) - 1)
            high = high if high < len(start) - 1 else len(start)
            first, last = start[low], start[high] if high < len(start) else len(of)
            out[low:high] = np.add.reduceat(x.take(of[first:last]), start[low:high] - first)
            low = high
        return out

    def by_document(self, x: np.ndarray) -> np.ndarray:
        """Sums of x, a value for each node, over each document's nodes."""
        return self.sums(x, self.node_of, self.doc_start)

    def walk(self, restart: np.ndarray, damping: float, rounds: int, tolerance: float) -> np.ndarray:
        """The masses of one query."""
        dangling = np.flatnonzero(self.degree <= 0)
        share = np.where(self.degree <= 0, 0.0, 1 / np.where(self.degree <= 0, 1.0, self.degree))
        rank = restart
        for _ in range(rounds):
            x = rank * share
            spread = self.sums(self.by_document(x), self.doc_of, self.node_start) - self.df * x + rank[dangling].sum() * restart
            new = damping * restart + (1 - damping) * spread
            new /= new.sum()
            rank, change = new, np.abs(new - rank).sum()
            if change < tolerance:
                break
        return rank


#: Edges of a graph that is sent to the executors (8 bytes each in every task), and queries that a task walks.
MOST_EDGES, QUERIES = 1 << 24, 4


def _numbers(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with numbers from 0."""
    return saved(positions(df.select(column).distinct(), column, name=f"{column}_no").withColumn(f"{column}_no", F.col(f"{column}_no").cast("int")))


def _walked(inc: DataFrame, seed: DataFrame, damping: float, rounds: int, tolerance: float, give, column: str, value: str) -> DataFrame:
    """(query_id, column, value): give(walker, masses of a query) says numbers of the column and values, over a graph of bounded size.

    The driver gets two numbers for each edge; names stay in tables and are joined to what the walks give.
    """
    docs, nodes = _numbers(inc, "doc_id"), _numbers(inc, "node")
    edges = inc.join(small(docs), "doc_id").join(small(nodes), "node").select("doc_id_no", "node_no").toArrow()
    n_docs, n_nodes = docs.count(), nodes.count()
    walker = Walker(edges["doc_id_no"].to_numpy(), edges["node_no"].to_numpy(), n_docs, n_nodes)
    del edges
    queries = seed.select("query_id").distinct().count()
    kind = dict(seed.dtypes)["query_id"]

    def block(found: pa.Table) -> pa.Table:
        out = []
        for query in pc.unique(found["query_id"]):
            own = found.filter(pc.equal(found["query_id"], query))
            restart = np.zeros(n_nodes)
            restart[own["node_no"].to_numpy()] = own["mass"].to_numpy()
            at, values = give(walker, walker.walk(restart, damping, rounds, tolerance))
            out.append(pa.table({"query_id": pa.array([query.as_py()] * len(at), found.schema.field("query_id").type), "no": pa.array(at, pa.int32()), value: pa.array(values, pa.float64())}))
        return pa.concat_tables(out)

    known = seed.join(nodes, "node").select("query_id", "node_no", "mass")
    # as many tasks as blocks: walks are long, and a block is small
    blocks = max(1, -(-queries // QUERIES))
    dealt = positions(known.select("query_id").distinct(), "query_id").select("query_id", (F.col("place") % blocks).alias("block")).join(known, "query_id")
    walks = dealt.repartition(blocks, "block").groupBy("block").applyInArrow(lambda found: block(found), f"query_id {kind}, no int, {value} double")
    names = (docs if column == "doc_id" else nodes).withColumnRenamed(f"{column}_no", "no")
    return saved(walks).join(names, "no").select("query_id", column, value)


def pagerank(inc: DataFrame, graph: DataFrame, seed: DataFrame, damping: float = 0.5, rounds: int = 50, tolerance: float = 1e-10, most_edges: int = MOST_EDGES) -> DataFrame:
    """(query_id, node, mass) after at most `rounds` steps; a query ends once it changes by less than the tolerance.

    `damping` is the probability of a restart at the seeds; mass at nodes without a neighbour restarts too. A graph of
    `most_edges` edges at most goes to the executors, which walk blocks of queries; a larger one is walked by joins.
    """
    inc, seed = saved(inc), saved(seed)
    if inc.count() <= most_edges:

        def masses(walker: Walker, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(rank)
            return at, rank[at]

        return _walked(inc, seed, damping, rounds, tolerance, masses, "node", "mass")
    return _joined_walk(inc, saved(graph.select("node", "df", "degree")), seed, damping, rounds, tolerance)


def _joined_walk(inc: DataFrame, graph: DataFrame, seed: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """The walk by joins through documents. Each step is cut in the checkpoint folder; queries that ended leave the joins."""
    rank, done = seed, None
    for _ in range(rounds):
        x = rank.join(graph, "node")
        walking = x.where("degree > 0").select("query_id", "node", (F.col("mass") / F.col("degree")).alias("x"), "df")
        dangling = x.groupBy("query_id").agg(F.sum(F.when(F.col("degree") > 0, 0.0).otherwise(F.col("mass"))).alias("lost"))
        by_doc = walking.join(inc, "node").groupBy("query_id", "doc_id").agg(F.sum("x").alias("s"))
        spread = by_doc.join(inc, "doc_id").groupBy("query_id", "node").agg(F.sum("s").alias("m"))
        back = walking.select("query_id", "node", (-F.col("df") * F.col("x")).alias("m"))
        restart = seed.join(dangling, "query_id").select("query_id", "node", (F.col("mass") * (damping + (1 - damping) * F.col("lost"))).alias("m"))
        moved = spread.unionAll(back).select("query_id", "node", (F.col("m") * (1 - damping)).alias("m")).unionAll(restart)
        new = saved(moved.groupBy("query_id", "node").agg(F.sum("m").alias("mass")))
        total = new.groupBy("query_id").agg(F.sum("mass").alias("t"))
        new = saved(new.join(total, "query_id").select("query_id", "node", (F.col("mass") / F.col("t")).alias("mass")))
        change = new.alias("a").join(rank.alias("b"), ["query_id", "node"], "full").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("a.mass", F.lit(0.0)) - F.coalesce("b.mass", F.lit(0.0)))).alias("d"))
        ended = saved(change.where(F.col("d") < tolerance).select("query_id"))
        rank = new
        if not ended.isEmpty():
            over = new.join(ended, "query_id", "left_semi")
            done = over if done is None else done.unionAll(over)
            rank, seed = saved(new.join(ended, "query_id", "left_anti")), saved(seed.join(ended, "query_id", "left_anti"))
            if rank.isEmpty():
                return done
    return rank if done is None else done.unionAll(rank)


def retrieve(inc: DataFrame, seed: DataFrame, k: int, mean: bool = False, damping: float = 0.5, rounds: int = 50, tolerance: float = 1e-10, most_edges: int = MOST_EDGES) -> DataFrame:
    """(query_id, doc_id, score, rank) of the walk from the seeds: documents by the summed (or mean) mass of their entities."""
    inc, seed = saved(inc), saved(seed)
    if inc.count() > most_edges:
        return score_documents(inc, pagerank(inc, nodes(inc), seed, damping, rounds, tolerance, most_edges), k, mean)

    def best(walker: Walker, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = walker.by_document(rank)
        if mean:
            scores /= np.diff(np.append(walker.doc_start, len(walker.node_of)))
        place = scores.round(9)
        # ties at the edge stay: an id decides between them
        at = np.flatnonzero((scores > 0) & (place >= np.partition(place, len(place) - min(k, len(place)))[len(place) - min(k, len(place))]))
        return at, scores[at]

    return top_k(_walked(inc, seed, damping, rounds, tolerance, best, "doc_id", "score"), k)


def score_documents(inc: DataFrame, rank: DataFrame, k: int, mean: bool = False) -> DataFrame:
    """Documents by the summed (or mean) mass of their entities."""
    if mean:
        sizes = inc.groupBy("doc_id").agg(F.count("*").alias("size"))
        scored = inc.join(rank, "node").groupBy("query_id", "doc_id").agg(F.sum("mass").alias("s")).join(sizes, "doc_id").select("query_id", "doc_id", (F.col("s") / F.col("size")).alias("score"))
    else:
        scored = inc.join(rank, "node").groupBy("query_id", "doc_id").agg(F.sum("mass").alias("score"))
    return top_k(scored.where("score > 0"), k)


def summary(docs: DataFrame, inc: DataFrame) -> DataFrame:
    """Documents, those with an entity, distinct entities, and the mean number a document."""
    counts = docs.select("doc_id").join(inc.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").agg(F.count("*").alias("n_docs"), F.count("n").alias("n_with"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_entities"))
    return counts.crossJoin(inc.agg(F.countDistinct("node").alias("n_nodes")))


def seed_match_rate(queries: DataFrame, query_nodes: DataFrame, inc: DataFrame) -> DataFrame:
    hit = query_nodes.join(inc, "node", "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return queries.select("query_id").join(hit, "query_id", "left").agg(F.count("*").alias("n_queries"), F.count("hit").alias("n_matched"), F.avg(F.coalesce("hit", F.lit(0))).alias("rate"))


def sharing(inc: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shares) for pairs of documents: whether they name a common entity."""
    sets = inc.groupBy("doc_id").agg(F.collect_set("node").alias("nodes"))
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("nodes").alias(f"n_{c}")) for c in "ab")
    return pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce(F.arrays_overlap("n_a", "n_b"), F.lit(False)).alias("shares"))


def random_pair_rates(inc: DataFrame, pairs: int, rounds: int = 1000, seed: int = 20260820) -> tuple[list[str], DataFrame]:
    """Sorted ids, and (round, a, b) drawn as random.Random(seed).sample(ids, 2) for `pairs` pairs in each round."""
    ids = sorted(r.doc_id for r in inc.select("doc_id").distinct().collect())
    rng = random.Random(seed)
    rows = [(i, *rng.sample(ids, 2)) for i in range(rounds) for _ in range(pairs)] if len(ids) >= 2 else []
    kind = dict(inc.dtypes)["doc_id"]
    return ids, inc.sparkSession.createDataFrame(rows, f"round int, a {kind}, b {kind}")


def reachability(inc: DataFrame, gold_pairs: DataFrame, rounds: int = 1000, seed: int = 20260820) -> DataFrame:
    """(gold_pairs_scored, observed_share_rate, random_pair_rate_p95, random_pair_median, passed): do documents of one query share entities more often than random pairs?

    Pairs with a document that has no entities row don't count. The judged pairs bound what is drawn on the driver.
    """
    known = inc.select("doc_id").distinct()
    scored = gold_pairs.join(known.withColumnRenamed("doc_id", "a"), "a", "left_semi").join(known.withColumnRenamed("doc_id", "b"), "b", "left_semi")
    n, hits = sharing(inc, scored).agg(F.count("*"), F.count_if("shares")).first()
    observed = hits / n if n else 0.0
    _, drawn = random_pair_rates(inc, n, rounds, seed) if n else ([], None)
    rates = []
    if drawn is not None:
        shares = sharing(inc, drawn.select("a", "b").distinct())
        rates = sorted(r.rate for r in drawn.join(shares, ["a", "b"]).groupBy("round").agg(F.avg(F.col("shares").cast("double")).alias("rate")).collect())
    top = upper_percentile(np.array(rates)) if rates else 0.0
    middle = float(np.median(rates)) if rates else 0.0
    return inc.sparkSession.createDataFrame([(n, observed, top, middle, bool(n) and observed > top)], "gold_pairs_scored long, observed_share_rate double, random_pair_rate_p95 double, random_pair_median double, passed boolean")


def titles_as_entities(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """Distinct (doc_id, node): the titles whose whole token run stands in the document's text; titles(title) are joined on their first tokens, then verified."""
    named = titles.select(T.node(F.col("title")).alias("node")).where("node <> ''").distinct()
    return contained_runs(docs, named.select(F.col("node").alias("query_id"), F.col("node").alias("text"))).select("doc_id", F.col("query_id").alias("node")).distinct()
