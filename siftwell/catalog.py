"""Registered queries of the retrieval engine over the parquet tables, and the SQL that each equals.

Corpus: documents. Queries: benchmark items. A document that holds an item's whole token run
is relevant to it. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import scoring as S
from siftwell.functions import text as T
from siftwell.operators import evaluation as E
from siftwell.operators import graph as G
from siftwell.operators import pool as P
from siftwell.operators import retrieval as R
from siftwell.operators import stats as B
from siftwell.operators import extraction as X
from siftwell.plans.lineage import saved

Query = Callable[[SparkSession, str], DataFrame]
ROUNDS, SEED = 2000, 20260818
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def with_(*names: str) -> str:
    """The named fragments and those before them that they need, as a WITH clause."""
    wanted, out = set(names), []
    for name in reversed(FRAGMENTS):
        if name in wanted:
            body, needs = FRAGMENTS[name]
            wanted |= set(needs)
            out.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(reversed(out)) + "\n"


FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "tok": ("SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS term FROM documents) WHERE term <> ''", ()),
    "len": ("SELECT d.doc_id, coalesce(t.n, 0) AS length FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) t USING (doc_id)", ("tok",)),
    "post": ("SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2", ("tok",)),
    "dfs": ("SELECT term, count(*) AS df FROM post GROUP BY 1", ("post",)),
    "cs": ("SELECT count(*) AS n, avg(length) AS average FROM len", ("len",)),
    "qtok": ("SELECT query_id, term FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS term FROM benchmark) WHERE term <> ''", ()),
    "qterm": ("SELECT DISTINCT query_id, term FROM qtok", ("qtok",)),
    "m": ("SELECT query_id, doc_id, tf::DOUBLE AS tf, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, CASE WHEN average > 0 THEN 1 - 0.75 + 0.75 * length / average ELSE 1.0 END AS norm FROM qterm JOIN post USING (term) JOIN dfs USING (term) JOIN len USING (doc_id) CROSS JOIN cs", ("qterm", "post", "dfs", "len", "cs")),
    "cells": ("SELECT query_id, doc_id, sum(tf) AS c0, sum(idf * tf) AS c1, sum(tf * 2.2 / (tf + 1.2)) AS c2, sum(idf * tf * 2.2 / (tf + 1.2)) AS c3, sum(tf / norm) AS c4, sum(idf * tf / norm) AS c5, sum(tf * 2.2 / (tf + 1.2 * norm)) AS c6, sum(idf * tf * 2.2 / (tf + 1.2 * norm)) AS c7 FROM m GROUP BY 1, 2", ("m",)),
    "long": (" UNION ALL ".join(f"SELECT {i} AS mask, query_id, doc_id, c{i} AS score FROM cells WHERE c{i} > 0" for i in range(8)), ("cells",)),
    "ranked": ("SELECT * FROM (SELECT mask, query_id, doc_id, score, row_number() OVER (PARTITION BY mask, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM long) WHERE rank <= 100", ("long",)),
    "bm25": ("SELECT query_id, doc_id, score, rank FROM ranked WHERE mask = 7", ("ranked",)),
    "cterm": ("SELECT query_id, term FROM qterm WHERE term NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'how', 'i', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'their', 'there', 'these', 'this', 'to', 'was', 'what', 'when', 'where', 'which', 'who', 'why', 'will', 'with')", ("qterm",)),
    "uw": ("SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(replace(lower(coalesce(text, '')), 'ſ', 's'), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2", ()),
    "hits": ("SELECT query_id, doc_id, count(*) AS matched, sum(n)::BIGINT AS total FROM cterm JOIN uw USING (term) GROUP BY 1, 2", ("cterm", "uw")),
    "coord": ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, total DESC, doc_id) AS rank FROM hits) WHERE rank <= 100", ("hits",)),
    "dtext": ("SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS run FROM documents", ()),
    "qtext": ("SELECT item_id AS query_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS run FROM benchmark", ()),
    "qrels": ("SELECT query_id, doc_id, 1 AS rel FROM qtext JOIN dtext ON qtext.run <> '' AND contains(dtext.run, ' ' || qtext.run || ' ')", ("dtext", "qtext")),
    "gold": ("SELECT query_id, count(*) AS gold, sum(CASE WHEN p <= 10 THEN 1 / log2(p + 1) ELSE 0 END) AS ideal FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS p FROM qrels) GROUP BY 1", ("qrels",)),
    "runs": ("SELECT mask::VARCHAR AS arm, query_id, doc_id, rank FROM ranked UNION ALL SELECT 'coordination', query_id, doc_id, rank FROM coord", ("ranked", "coord")),
    "arms": ("SELECT DISTINCT arm FROM (SELECT unnest(['0','1','2','3','4','5','6','7','coordination']) AS arm)", ()),
    "scores": ("SELECT arm, query_id, coalesce(dcg / ideal, 0) AS ndcg_10, coalesce(h10 / gold, 0) AS recall_10, coalesce(h100 / gold, 0) AS recall_100 FROM arms CROSS JOIN gold LEFT JOIN (SELECT arm, query_id, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 100) AS h100 FROM runs JOIN qrels USING (query_id, doc_id) GROUP BY 1, 2) USING (arm, query_id)", ("arms", "gold", "runs", "qrels")),
    "pairs": ("SELECT a.query_id, a.ndcg_10 AS x, b.ndcg_10 AS y, row_number() OVER (ORDER BY a.query_id) - 1 AS place, count(*) OVER () AS n FROM scores a JOIN scores b USING (query_id) WHERE a.arm = '7' AND b.arm = 'coordination'", ("scores",)),
    "vec": ("SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN norm = 0 THEN 1 ELSE norm END) AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)", ()),
    "dense": ("SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, v.label = q.label AS same, list_dot_product(q.u, v.u) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, v.u), 9) DESC, v.vec_id) AS rank FROM vec q CROSS JOIN vec v WHERE q.vec_id % 50 = 0) WHERE rank <= 100", ("vec",)),
    "title": ("SELECT page_id AS doc_id, trim(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)) AS title FROM pages", ()),
    "ctx": ("SELECT conv_id AS question_id, turn AS slot, coalesce(title, '') AS title FROM conversations LEFT JOIN title ON doc_id = (conv_id * 7 + turn) % (SELECT count(*) FROM pages)", ("title",)),
    "inc": ("SELECT DISTINCT doc_id, term AS node FROM tok WHERE length(term) >= 6", ("tok",)),
    "dsize": ("SELECT doc_id, count(*) AS size FROM inc GROUP BY 1", ("inc",)),
    "nodes": ("SELECT node, count(*) AS df, 1.0 / count(*) AS specificity, sum(size)::BIGINT - count(*) AS degree FROM inc JOIN dsize USING (doc_id) GROUP BY 1", ("inc", "dsize")),
    "qnode": ("SELECT query_id, term AS node FROM qterm SEMI JOIN nodes ON term = node", ("qterm", "nodes")),
    "seed": ("SELECT query_id, node, specificity / sum(specificity) OVER (PARTITION BY query_id) AS mass FROM qnode JOIN nodes USING (node)", ("qnode", "nodes")),
}

@query("tokenize_counts", with_("len", "post") + "SELECT doc_id, any_value(length)::BIGINT AS n_tokens, count(term) AS n_terms FROM len LEFT JOIN post USING (doc_id) GROUP BY doc_id")
def tokenize_counts(spark, sf):
    t = T.tokens(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query("corpus_length_stats", with_("len") + "SELECT count(*) AS n_docs, round(avg(length), 6) AS mean_length, round(median(length), 6)::DOUBLE AS median_length, round(stddev_pop(length), 6) AS std_length, round(stddev_pop(length) / avg(length), 6) AS cv FROM len")
def corpus_length_stats(spark, sf):
    return rounded(E.length_stats(R.Index(docs(spark, sf)).lengths), "mean_length", "median_length", "std_length", "cv")


@query("postings", with_("post") + "SELECT doc_id, term, tf FROM post")
def postings(spark, sf):
    return R.Index(docs(spark, sf)).postings.select("doc_id", "term", "tf")


@query("term_df_idf", with_("dfs", "cs") + "SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfs CROSS JOIN cs")
def term_df_idf(spark, sf):
    return rounded(R.Index(docs(spark, sf)).idf().select("term", "df", "idf"), "idf")


def _cell(mask: int, name: str) -> None:
    @query(name, with_("ranked") + f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE mask = {mask} AND rank <= 10")
    def run(spark, sf):
        return rounded(R.lexical(R.Index(docs(spark, sf)), items(spark, sf), 10, *R.CELLS[mask]), "score")


for _m, _name in enumerate(["lexical_none", "lexical_idf", "lexical_tf", "lexical_idf_tf", "lexical_len", "lexical_idf_len", "lexical_tf_len", "bm25"]):
    _cell(_m, f"{_name}_top10")


@query("factorial_scores", with_("cells") + "SELECT query_id, doc_id, " + ", ".join(f"round(c{i}, 6) AS cell_{i}" for i in range(8)) + " FROM cells")
def factorial_scores(spark, sf):
    return rounded(R.factorial(R.Index(docs(spark, sf)), items(spark, sf)), *[f"cell_{i}" for i in range(8)])


@query("coordination_top10", with_("coord") + "SELECT query_id, doc_id, matched, total, rank FROM coord WHERE rank <= 10")
def coordination_top10(spark, sf):
    return R.coordination(docs(spark, sf), items(spark, sf), 10)


@query("coordination_set_sizes", with_("hits") + "SELECT round(avg(n), 6) AS mean_size, list_sort(list(n))[(count(*) // 2 + 1)::BIGINT] AS upper_median, count(*) FILTER (n = 0) AS n_empty FROM (SELECT item_id, count(doc_id) AS n FROM benchmark LEFT JOIN hits ON item_id = query_id GROUP BY 1)")
def coordination_set_sizes(spark, sf):
    n = R.coordination_hits(docs(spark, sf), items(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n"))
    return rounded(E.size_summary(items(spark, sf).join(n, "query_id", "left").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"))), "mean_size")


@query("coordination_substring_top10", with_("cterm") + ", low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), sub AS (SELECT doc_id, term, ((length(t) - length(replace(t, term, ''))) / length(term))::BIGINT AS n FROM low CROSS JOIN (SELECT DISTINCT term FROM cterm)), h AS (SELECT query_id, doc_id, count(*) AS matched, sum(n)::BIGINT AS total FROM sub JOIN cterm USING (term) WHERE n > 0 GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, total DESC, doc_id) AS rank FROM h) WHERE rank <= 10")
def coordination_substring_top10(spark, sf):
    return R.coordination(docs(spark, sf), items(spark, sf), 10, bounded=False)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id, rel): documents with the item's whole token run."""
    return saved(R.contained_runs(docs(spark, sf), items(spark, sf)).withColumn("rel", F.lit(1)))


@query("derived_qrels", with_("qrels") + "SELECT query_id, doc_id, rel FROM qrels")
def derived_qrels(spark, sf):
    return judged(spark, sf)


@query("gold_presence", with_("qrels") + "SELECT count(*) AS n_gold, count(*) - count(d.doc_id) AS n_missing FROM qrels LEFT JOIN documents d USING (doc_id)")
def gold_presence(spark, sf):
    there = docs(spark, sf).select("doc_id", F.lit(1).alias("there"))
    return judged(spark, sf).join(there, "doc_id", "left").agg(F.count("*").alias("n_gold"), F.count_if(F.col("there").isNull()).alias("n_missing"))


def arm_scores(spark: SparkSession, sf: str, rel: DataFrame | None = None) -> DataFrame:
    """(arm, query_id, ndcg_10, recall_10, recall_100) of the eight cells and coordination, over one list of runs."""
    d, q, rel = docs(spark, sf), items(spark, sf), rel or judged(spark, sf)
    runs = R.factorial_runs(R.Index(d), q, 100).select(F.col("mask").cast("string").alias("arm"), "query_id", "doc_id", "rank").unionAll(R.coordination(d, q, 100).select(F.lit("coordination"), "query_id", "doc_id", "rank"))
    arms = spark.createDataFrame([(str(i),) for i in range(8)] + [("coordination",)], "arm string")
    # an arm's query is one id for the shared kernel
    both = lambda df: df.crossJoin(F.broadcast(arms)).withColumn("query_id", F.struct("arm", "query_id"))
    m = E.metrics(both(q.select("query_id")), runs.withColumn("query_id", F.struct("arm", "query_id")), both(rel))
    return saved(m.select("query_id.arm", "query_id.query_id", "ndcg_10", "recall_10", "recall_100"))


@query("ndcg_recall_bm25", with_("scores") + "SELECT query_id, round(ndcg_10, 6) AS ndcg_10, round(recall_10, 6) AS recall_10, round(recall_100, 6) AS recall_100 FROM scores WHERE arm = '7'")
def ndcg_recall_bm25(spark, sf):
    q = items(spark, sf)
    return rounded(E.metrics(q, R.lexical(R.Index(docs(spark, sf)), q, 100), judged(spark, sf)), "ndcg_10", "recall_10", "recall_100")


@query("mean_metrics_by_arm", with_("scores") + "SELECT arm, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_10), 6) AS recall_10, round(avg(recall_100), 6) AS recall_100 FROM scores GROUP BY 1")
def mean_metrics_by_arm(spark, sf):
    return arm_scores(spark, sf).groupBy("arm").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ndcg_10", "recall_10", "recall_100")])


@query("set_recall_coordination", with_("hits", "qrels", "gold") + "SELECT query_id, round(coalesce(n, 0) / gold, 6) AS set_recall FROM gold LEFT JOIN (SELECT query_id, count(*) AS n FROM hits JOIN qrels USING (query_id, doc_id) GROUP BY 1) USING (query_id)")
def set_recall_coordination(spark, sf):
    return rounded(E.set_recall(items(spark, sf), R.coordination_hits(docs(spark, sf), items(spark, sf)), judged(spark, sf)), "set_recall")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("q_label"))


@query("dense_top10", with_("dense") + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def dense_top10(spark, sf):
    return rounded(R.dense(*vectors(spark, sf), 10), "score")


@query("dense_self_retrieval", with_("dense") + "SELECT count(*) AS n, round(avg((query_id = doc_id)::INT), 6) AS rate FROM dense WHERE rank = 1")
def dense_self_retrieval(spark, sf):
    return R.dense(*vectors(spark, sf), 1).agg(F.count("*").alias("n"), F.round(F.avg((F.col("query_id") == F.col("doc_id")).cast("int")), 6).alias("rate"))


def _dense_ndcg(spark, sf, shuffled: bool) -> DataFrame:
    v, q = vectors(spark, sf)
    if shuffled:  # every vector under the label of another
        n = v.count()
        v = v.join(v.select((F.pmod(F.col("doc_id") * 7919 + 13, F.lit(n))).alias("doc_id"), F.col("label").alias("l2")), "doc_id", "left").select("doc_id", "embedding", F.col("l2").alias("label"))
    run = R.dense(v, q, 10).join(v.select("doc_id", "label"), "doc_id").join(q.select("query_id", "q_label"), "query_id")
    gain = F.when(F.col("label") == F.col("q_label"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return run.groupBy("query_id").agg(F.round(F.sum(gain), 6).alias("dcg_10"))


@query("dense_label_dcg", with_("dense") + "SELECT query_id, round(sum(CASE WHEN same THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg_10 FROM dense WHERE rank <= 10 GROUP BY 1")
def dense_label_dcg(spark, sf):
    return _dense_ndcg(spark, sf, False)


@query("dense_shuffle_dcg", with_("dense") + ", o AS (SELECT (vec_id * 7919 + 13) % (SELECT count(*) FROM embeddings) AS vec_id, label AS l2 FROM embeddings) SELECT query_id, round(sum(CASE WHEN l2 = e.label THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg_10 FROM dense JOIN embeddings e ON e.vec_id = query_id LEFT JOIN o ON o.vec_id = doc_id WHERE rank <= 10 GROUP BY 1")
def dense_shuffle_dcg(spark, sf):
    return _dense_ndcg(spark, sf, True)


@query("rrf_hybrid_top10", with_("bm25", "coord") + "SELECT * FROM (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1 / (60 + rank)), 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM coord) GROUP BY 1, 2) WHERE rank <= 10")
def rrf_hybrid_top10(spark, sf):
    d, q = docs(spark, sf), items(spark, sf)
    return rounded(R.fuse(R.lexical(R.Index(d), q, 100), R.coordination(d, q, 100), k=10), "score")


PROPS = ", qi AS (SELECT query_id, max(coalesce(ln((n - df + 0.5) / (df + 0.5) + 1), ln((n + 0.5) / 0.5 + 1))) AS max_idf, avg(coalesce(ln((n - df + 0.5) / (df + 0.5) + 1), ln((n + 0.5) / 0.5 + 1))) AS mean_idf FROM qterm LEFT JOIN dfs USING (term) CROSS JOIN cs GROUP BY 1), ov AS (SELECT query_id, doc_id, count(*) AS i FROM qrels JOIN qterm USING (query_id) JOIN post USING (doc_id, term) GROUP BY 1, 2), qn AS (SELECT query_id, count(*) AS nq FROM qterm GROUP BY 1), dn AS (SELECT doc_id, count(*) AS nd FROM post GROUP BY 1), gj AS (SELECT query_id, avg(coalesce(i, 0) / (nq + nd - coalesce(i, 0))) AS gold_jaccard, count(*) AS gold_count FROM qrels JOIN qn USING (query_id) JOIN dn USING (doc_id) LEFT JOIN ov USING (query_id, doc_id) GROUP BY 1), ql AS (SELECT query_id, count(*) AS query_length FROM qtok GROUP BY 1), props AS (SELECT item_id AS query_id, coalesce(query_length, 0)::INT AS query_length, coalesce(max_idf, 0) AS max_idf, coalesce(mean_idf, 0) AS mean_idf, coalesce(gold_jaccard, 0) AS gold_jaccard, coalesce(gold_count, 0) AS gold_count FROM benchmark LEFT JOIN ql ON item_id = ql.query_id LEFT JOIN qi ON item_id = qi.query_id LEFT JOIN gj ON item_id = gj.query_id) "


def _properties(spark, sf):
    d, terms = docs(spark, sf), R.query_words(items(spark, sf))
    _, idf, _ = R.Index(d).held(terms)
    weights = spark.createDataFrame([(w, float(x)) for w, x in zip(terms.words.to_pylist(), idf, strict=True)], "term string, idf double")
    return E.query_properties(items(spark, sf), judged(spark, sf), d, weights, d.agg(F.count("*").alias("n")))


@query("query_properties", with_("qterm", "dfs", "cs", "qrels", "post") + PROPS + "SELECT query_id, query_length, round(max_idf, 6) AS max_idf, round(mean_idf, 6) AS mean_idf, round(gold_jaccard, 6) AS gold_jaccard, gold_count FROM props")
def query_properties(spark, sf):
    return rounded(_properties(spark, sf), "max_idf", "mean_idf", "gold_jaccard")


@query("winloss_by_property", with_("qterm", "dfs", "cs", "qrels", "post", "scores") + PROPS + ", b AS (SELECT query_id, (((4 * row_number() OVER (ORDER BY round(mean_idf, 9), query_id) - 1) // count(*) OVER ()))::INT AS bin FROM props SEMI JOIN gold USING (query_id)) SELECT bin, count(*) AS n, count(*) FILTER (round(x.ndcg_10, 9) > round(y.ndcg_10, 9)) AS wins, count(*) FILTER (round(x.ndcg_10, 9) < round(y.ndcg_10, 9)) AS losses, count(*) FILTER (round(x.ndcg_10, 9) = round(y.ndcg_10, 9)) AS ties, round(avg(round(x.ndcg_10, 9) - round(y.ndcg_10, 9)), 6) AS mean_diff, count(*) < 5 AS sparse FROM b JOIN scores x ON x.query_id = b.query_id AND x.arm = '7' JOIN scores y ON y.query_id = b.query_id AND y.arm = 'coordination' GROUP BY 1")
def winloss_by_property(spark, sf):
    s = arm_scores(spark, sf).select("arm", "query_id", F.round("ndcg_10", 9).alias("value"))
    judged_only = _properties(spark, sf).where("gold_count > 0").select("query_id", F.round("mean_idf", 9).alias("mean_idf"))
    arm = lambda a: s.where(F.col("arm") == a).select("query_id", "value")
    return rounded(E.win_loss(arm("7"), arm("coordination"), E.quantile_bins(judged_only, "mean_idf")), "mean_diff")


_MEANS = "means AS (SELECT arm::INT AS mask, avg(ndcg_10) AS value FROM scores WHERE arm <> 'coordination' GROUP BY 1)"
_SHAPLEY = "SELECT player, sum(CASE bit_count(c.mask) WHEN 1 THEN 1.0 / 6 ELSE 1.0 / 3 END * (d.value - c.value)) AS shapley FROM means c CROSS JOIN (SELECT unnest(['idf', 'tf_saturation', 'length_norm']) AS player, unnest([1, 2, 4]) AS bit) JOIN means d ON d.mask = c.mask | bit WHERE c.mask & bit = 0 GROUP BY 1"
PLAYERS = ["idf", "tf_saturation", "length_norm"]


@query("shapley_values", with_("scores") + f", {_MEANS} SELECT player, round(shapley, 6) + 0 AS shapley FROM ({_SHAPLEY})")
def shapley_values(spark, sf):
    means = arm_scores(spark, sf).where("arm <> 'coordination'").groupBy(F.col("arm").cast("int").alias("mask")).agg(F.avg("ndcg_10").alias("value"))
    return B.shapley(means, PLAYERS).select("player", (F.round("shapley", 6) + 0).alias("shapley"))


_DRAW = f"(r * 1103515245 + place * 12345 + {SEED}) % 2147483647 % n"


def _pairs(spark, sf):
    s = arm_scores(spark, sf)
    arm = lambda a, c: s.where(F.col("arm") == a).select("query_id", F.col("ndcg_10").alias(c))
    return arm("7", "x").join(arm("coordination", "y"), "query_id")


@query("paired_bootstrap_hash", with_("pairs") + f", drawn AS (SELECT r, {_DRAW} AS at FROM pairs CROSS JOIN (SELECT unnest(range({ROUNDS})) AS r)), draws AS (SELECT r, round(avg(p.x - p.y), 9) AS d FROM drawn JOIN pairs p ON p.place = drawn.at GROUP BY 1) SELECT round(list_sort(list(d))[51], 6) AS low, round(list_sort(list(d))[{ROUNDS} - 50], 6) AS high, round(least(1.0, 2 * least(count(*) FILTER (d <= 0) + 1, count(*) FILTER (d >= 0) + 1) / ({ROUNDS} + 1)), 6) AS p_value FROM draws")
def paired_bootstrap_hash(spark, sf):
    diffs = _pairs(spark, sf).select("query_id", (F.col("x") - F.col("y")).alias("d"))
    means = B.hashed_means(diffs, ROUNDS, SEED, "d").withColumn("d", F.round("d", 9))
    return rounded(B.hashed_interval(means, "d", ROUNDS), "low", "high", "p_value")


@query("paired_bootstrap_mt")
def paired_bootstrap_mt(spark, sf):
    return B.paired_mersenne(_pairs(spark, sf).select(F.lit("bm25 - coordination").alias("comparison"), "query_id", F.col("x").alias("a"), F.col("y").alias("b")))


@query("holm_adjusted", "WITH p AS (SELECT p_partkey AS idx, round(p_size / 10000.0, 6)::DOUBLE AS p FROM part), r AS (SELECT idx, p, (count(*) OVER () - row_number() OVER (ORDER BY p, idx) + 1) * p AS raw FROM p) SELECT idx, p, round(least(1.0, max(raw) OVER (ORDER BY p, idx ROWS UNBOUNDED PRECEDING)), 6) AS adjusted, least(1.0, max(raw) OVER (ORDER BY p, idx ROWS UNBOUNDED PRECEDING)) <= 0.05 AS rejected FROM r")
def holm_adjusted(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.round(F.col("p_size") / 10000.0, 6).alias("p"))
    return rounded(B.holm(p), "adjusted")


@query("spearman_rho", "WITH p AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM p) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman_rho(spark, sf):
    return rounded(B.spearman(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))), "rho")


def _named(spark, sf):
    gold = judged(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return gold.select("query_id", F.concat("lang", F.lit(" ("), "source", F.lit(")")).alias("title"))


_COVER = with_("qrels", "qtext") + ", cov AS (SELECT item_id AS query_id, least(count(*) FILTER (lang <> '' AND contains(' ' || run || ' ', ' ' || lang || ' ')), 2)::INT AS cls FROM benchmark JOIN qtext ON item_id = qtext.query_id LEFT JOIN qrels ON qrels.query_id = item_id LEFT JOIN documents d USING (doc_id) GROUP BY 1) "


@query("coverage_classes", _COVER + "SELECT query_id, cls FROM cov")
def coverage_classes(spark, sf):
    return E.coverage(items(spark, sf), _named(spark, sf))


@query("coverage_distribution", _COVER + "SELECT b.cls, count(cov.cls) AS n FROM (SELECT unnest([0, 1, 2]) AS cls) b LEFT JOIN cov USING (cls) GROUP BY 1")
def coverage_distribution(spark, sf):
    return E.class_distribution(E.coverage(items(spark, sf), _named(spark, sf)))


@query("coverage_reclassified", _COVER + ", raw AS (SELECT item_id AS query_id, least(count(*) FILTER (contains(' ' || run || ' ', ' ' || lang || ' ' || source || ' ')), 2)::INT AS cls FROM benchmark JOIN qtext ON item_id = qtext.query_id LEFT JOIN qrels ON qrels.query_id = item_id LEFT JOIN documents d USING (doc_id) GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (cov.cls <> raw.cls) AS n_reclassified FROM cov JOIN raw USING (query_id)")
def coverage_reclassified(spark, sf):
    q, t = items(spark, sf), _named(spark, sf)
    both = E.coverage(q, t).join(E.coverage(q, t, strip_title=False).withColumnRenamed("cls", "raw"), "query_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("cls") != F.col("raw")).alias("n_reclassified"))


@query("coverage_crosstab", _COVER + "SELECT lang, cls, count(*) AS n FROM cov JOIN qrels USING (query_id) JOIN documents USING (doc_id) GROUP BY 1, 2")
def coverage_crosstab(spark, sf):
    langs = judged(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return E.coverage(items(spark, sf), _named(spark, sf)).join(langs, "query_id").groupBy("lang", "cls").agg(F.count("*").alias("n"))


@query("per_class_profile", with_("scores", "qtext") + ", cov AS (SELECT q.query_id, least(count(*) FILTER (contains(' ' || run || ' ', ' ' || lang || ' ')), 2)::INT AS cls FROM qtext q LEFT JOIN qrels USING (query_id) LEFT JOIN documents d USING (doc_id) GROUP BY 1), v AS (SELECT query_id, recall_10 AS value, recall_100 = 0 AS empty, cls FROM scores JOIN cov USING (query_id) WHERE arm = '7') SELECT class, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(empty::INT), 6) AS empty_rate FROM (SELECT *, cls::VARCHAR AS class FROM v UNION ALL SELECT *, '01' FROM v WHERE cls < 2) GROUP BY 1")
def per_class_profile(spark, sf):
    values = arm_scores(spark, sf).where("arm = '7'").select("query_id", F.col("recall_10").alias("value"), (F.col("recall_100") == 0).alias("empty"))
    return rounded(E.profile(values, E.coverage(items(spark, sf), _named(spark, sf))), "mean_value", "empty_rate")


@query("headroom", with_("scores") + "SELECT a.query_id, round((a.ndcg_10 - b.ndcg_10) / (1 - b.ndcg_10), 6) + 0 AS deficit FROM scores a JOIN scores b USING (query_id) WHERE a.arm = '7' AND b.arm = '0' AND round(b.ndcg_10, 9) < 1")
def headroom(spark, sf):
    s = arm_scores(spark, sf)
    a, b = (s.where(F.col("arm") == k).select("query_id", F.col("ndcg_10").alias(c)) for k, c in (("7", "a"), ("0", "b")))
    return a.join(b, "query_id").where(F.round("b", 9) < 1).select("query_id", (F.round(S.deficit(F.col("a"), F.col("b")), 6) + 0).alias("deficit"))


def titles(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)).alias("title"))


def slots(spark, sf):
    n = table(spark, sf, "pages").count()
    at = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("slot"), ((F.col("conv_id") * 7 + F.col("turn")) % n).alias("doc_id"))
    return at.join(titles(spark, sf), "doc_id", "left").select("question_id", "slot", F.coalesce("title", F.lit("")).alias("title"))


@query("pool_titles", with_("ctx") + "SELECT DISTINCT title FROM ctx")
def pool_titles(spark, sf):
    return P.pool_titles(slots(spark, sf))


@query("pool_counts", with_("ctx", "title") + "SELECT (SELECT count(*) FROM ctx) AS n_slots, count(*) AS n_titles, count(t.title) AS n_resolved, count(*) - count(t.title) AS n_unresolved FROM (SELECT DISTINCT title FROM ctx) c LEFT JOIN (SELECT DISTINCT title FROM title WHERE title <> '') t USING (title)")
def pool_counts(spark, sf):
    return P.counts(slots(spark, sf), titles(spark, sf))


@query("title_collisions", with_("title") + "SELECT title, count(*) AS n FROM title WHERE title <> '' GROUP BY 1 HAVING count(*) > 1")
def title_collisions(spark, sf):
    return P.collisions(titles(spark, sf))


@query("majority_variant", "SELECT title, text, n FROM (SELECT source AS title, lang AS text, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def majority_variant(spark, sf):
    return P.majority_text(table(spark, sf, "documents").select(F.col("source").alias("title"), F.col("lang").alias("text")))


def entity_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Incidence by the default extraction rule."""
    return saved(G.incidence(X.mentions(docs(spark, sf), X.LongTokens())))


def query_nodes(spark, sf):
    return items(spark, sf).select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("node"))


@query("entity_incidence", with_("inc") + "SELECT doc_id, node FROM inc")
def entity_incidence(spark, sf):
    return entity_graph(spark, sf)


@query("node_degrees", with_("nodes") + "SELECT node, df, round(specificity, 6)::DOUBLE AS specificity, degree FROM nodes")
def node_degrees(spark, sf):
    return rounded(G.nodes(entity_graph(spark, sf)), "specificity")


@query("entity_graph_summary", with_("inc", "dsize") + "SELECT count(*) AS n_docs, count(size) AS n_with, round(avg(coalesce(size, 0)), 6) AS mean_entities, (SELECT count(DISTINCT node) FROM inc) AS n_nodes FROM documents LEFT JOIN dsize USING (doc_id)")
def entity_graph_summary(spark, sf):
    return rounded(G.summary(docs(spark, sf), entity_graph(spark, sf)), "mean_entities")


@query("seed_match_rate", with_("qnode") + "SELECT count(*) AS n_queries, count(q.query_id) AS n_matched, round(avg((q.query_id IS NOT NULL)::INT), 6) AS rate FROM benchmark LEFT JOIN (SELECT DISTINCT query_id FROM qnode) q ON item_id = q.query_id")
def seed_match_rate(spark, sf):
    return rounded(G.seed_match_rate(items(spark, sf), query_nodes(spark, sf), entity_graph(spark, sf)), "rate")


def _top(rank: str, how: str) -> str:
    score = "sum(mass)" if how == "sum" else "sum(mass) / any_value(size)"
    needs = (rank, "inc") if how == "sum" else (rank, "inc", "dsize")
    return with_(*needs) + f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, {score} AS score FROM {rank} JOIN inc USING (node)" + (" JOIN dsize USING (doc_id)" if how != "sum" else "") + " GROUP BY 1, 2) WHERE score > 0) WHERE rank <= 10"


def _seeds(spark, sf, inc, specific: bool = True):
    return G.seeds(query_nodes(spark, sf), G.nodes(inc), specific)


@query("ppr_top10")
def ppr_top10(spark, sf):
    inc = entity_graph(spark, sf)
    return rounded(G.retrieve(inc, _seeds(spark, sf, inc), 10), "score")


@query("graph_mean_scoring_top10")
def graph_mean_scoring_top10(spark, sf):
    inc = entity_graph(spark, sf)
    return rounded(G.retrieve(inc, _seeds(spark, sf, inc), 10, mean=True), "score")


@query("ppr_no_walk_top10", _top("seed", "sum"))
def ppr_no_walk_top10(spark, sf):
    inc = entity_graph(spark, sf)
    return rounded(G.score_documents(inc, _seeds(spark, sf, inc), 10), "score")


@query("graph_count_top10", with_("inc", "qnode") + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(1.0::DOUBLE / n) AS score FROM qnode JOIN (SELECT query_id, count(*) AS n FROM qnode GROUP BY 1) USING (query_id) JOIN inc USING (node) GROUP BY 1, 2)) WHERE rank <= 10")
def graph_count_top10(spark, sf):
    inc = entity_graph(spark, sf)
    return rounded(G.score_documents(inc, _seeds(spark, sf, inc, False), 10), "score")


@query("graph_mean_no_walk_top10", _top("seed", "mean"))
def graph_mean_no_walk_top10(spark, sf):
    inc = entity_graph(spark, sf)
    return rounded(G.score_documents(inc, _seeds(spark, sf, inc), 10, mean=True), "score")


@query("bridge_sharing", with_("inc") + "SELECT count(*) AS n_pairs, round(avg(s), 6) AS rate FROM (SELECT doc_id, (x.doc_id IS NOT NULL)::INT AS s FROM documents d LEFT JOIN (SELECT DISTINCT a.doc_id FROM inc a JOIN inc b ON a.node = b.node AND b.doc_id = a.doc_id + 1) x USING (doc_id) WHERE EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id + 1))")
def bridge_sharing(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("a"))
    pairs = d.join(docs(spark, sf).select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b")), "a")
    return G.sharing(entity_graph(spark, sf), pairs).agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.col("shares").cast("int")), 6).alias("rate"))


@query("extraction_prf", with_("inc", "tok") + ", g AS (SELECT doc_id, node FROM inc), p AS (SELECT DISTINCT doc_id, term AS node FROM tok WHERE length(term) >= 9), n AS (SELECT count(*) FILTER (g.node IS NOT NULL AND p.node IS NOT NULL) AS tp, count(*) FILTER (g.node IS NULL) AS fp, count(*) FILTER (p.node IS NULL) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.node = p.node) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM n")
def extraction_prf(spark, sf):
    p = R.Index(docs(spark, sf)).postings.where("length(term) >= 9").select("doc_id", F.col("term").alias("node"))
    return rounded(E.prf(entity_graph(spark, sf), p), "precision", "recall", "f1")


@query("rater_agreement", "WITH v AS (SELECT DISTINCT user_id AS doc_id, event_type AS rater, floor(value)::BIGINT AS node FROM events), s AS (SELECT doc_id, rater, list(node) AS ns FROM v GROUP BY 1, 2) SELECT a.rater AS r1, b.rater AS r2, round(avg(len(list_intersect(a.ns, b.ns)) / len(list_distinct(list_concat(a.ns, b.ns)))), 6) AS jaccard, count(*) AS n_docs FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY 1, 2")
def rater_agreement(spark, sf):
    return rounded(E.rater_agreement(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("rater"), F.floor("value").alias("node"))), "jaccard")


_CLS = ", cov AS (SELECT q.query_id, least(count(*) FILTER (contains(' ' || run || ' ', ' ' || lang || ' ')), 2)::INT AS cls FROM qtext q LEFT JOIN qrels USING (query_id) LEFT JOIN documents d USING (doc_id) GROUP BY 1), v AS (SELECT query_id, x.ndcg_10 AS graph, y.ndcg_10 AS bm25, cls FROM scores x JOIN scores y USING (query_id) JOIN cov USING (query_id) WHERE x.arm = 'coordination' AND y.arm = '7') "


def two_arms(spark, sf):
    """(query_id, cls, graph, bm25): nDCG of coordination, in the place of the arm under test, and of BM25, with coverage classes."""
    rel = judged(spark, sf)
    s = arm_scores(spark, sf, rel)
    arm = lambda a, c: s.where(F.col("arm") == a).select("query_id", F.col("ndcg_10").alias(c))
    return arm("coordination", "graph").join(arm("7", "bm25"), "query_id").join(E.coverage(items(spark, sf), _named(spark, sf)), "query_id")


def _strata(spark, sf):
    """The two arms by classes of the length of the query, as every class of coverage may not be there: 2 for those of an odd number of tokens, else 0."""
    odd = F.when(F.size(T.tokens(F.col("text"))) % 2 == 1, 2).otherwise(0)
    return two_arms(spark, sf).drop("cls").join(items(spark, sf).select("query_id", odd.alias("cls")), "query_id")


_STRATA = ", v AS (SELECT query_id, x.ndcg_10 AS graph, y.ndcg_10 AS bm25, CASE WHEN coalesce(n, 0) % 2 = 1 THEN 2 ELSE 0 END AS cls FROM scores x JOIN scores y USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM qtok GROUP BY 1) USING (query_id) WHERE x.arm = 'coordination' AND y.arm = '7') "


@query("class_contrast_mt")
def class_contrast_mt(spark, sf):
    return B.class_contrast(two_arms(spark, sf).select(F.lit("ndcg_10").alias("key"), "query_id", "cls", (F.col("graph") - F.col("bm25")).alias("value")))


@query("class_contrast_points", with_("scores", "qtok") + _STRATA + "SELECT count(*) FILTER (cls < 2) AS n_absent, count(*) FILTER (cls = 2) AS n_named, round(avg(graph - bm25) FILTER (cls < 2), 6) + 0 AS mean_absent, round(avg(graph - bm25) FILTER (cls = 2), 6) + 0 AS mean_named, round(avg(graph - bm25) FILTER (cls < 2) - avg(graph - bm25) FILTER (cls = 2), 6) + 0 AS difference FROM v HAVING n_absent > 0 AND n_named > 0")
def class_contrast_points(spark, sf):
    found = B.class_contrast(_strata(spark, sf).select(F.lit("ndcg_10").alias("key"), "query_id", "cls", (F.col("graph") - F.col("bm25")).alias("value")))
    return found.where("error is null").select("n_absent", "n_named", *[(F.round(c, 6) + 0).alias(c) for c in ("mean_absent", "mean_named", "difference")])


@query("own_class_difference_points", with_("scores", "qtok") + _STRATA + "SELECT round(avg(graph) FILTER (cls < 2) - avg(graph) FILTER (cls = 2), 6) + 0 AS difference FROM v HAVING count(*) FILTER (cls < 2) > 0 AND count(*) FILTER (cls = 2) > 0")
def own_class_difference_points(spark, sf):
    found = B.class_contrast(_strata(spark, sf).select(F.lit("ndcg_10").alias("key"), "query_id", "cls", F.col("graph").alias("value")))
    return found.where("error is null").select((F.round("difference", 6) + 0).alias("difference"))


@query("decomposition_points", with_("scores", "qtok") + _STRATA + ", t AS (SELECT avg(graph) FILTER (cls < 2) - avg(graph) FILTER (cls = 2) AS g, avg(bm25) FILTER (cls = 2) - avg(bm25) FILTER (cls < 2) AS b FROM v HAVING count(*) FILTER (cls < 2) > 0 AND count(*) FILTER (cls = 2) > 0) SELECT term, round(point, 6) + 0 AS point FROM (SELECT unnest(['differential', 'graph', 'bm25']) AS term, unnest([g + b, g, b]) AS point FROM t)")
def decomposition_points(spark, sf):
    found = B.decompose(_strata(spark, sf).withColumn("key", F.lit("ndcg_10"))).where("error is null and term <> 'bm25_share'")
    return found.select("term", (F.round("point", 6) + 0).alias("point"))


@query("headroom_by_class", with_("scores", "qtext") + _CLS + "SELECT class, n, round(b, 6) AS bm25, round(g, 6) AS graph, round(g - b, 6) + 0 AS raw_deficit, round(1 - b, 6) AS headroom, CASE WHEN round(b, 9) < 1 THEN round((g - b) / (1 - b), 6) + 0 END AS normalised_deficit FROM (SELECT CASE WHEN cls < 2 THEN 'bridge_absent' ELSE 'comparison' END AS class, count(*) AS n, avg(bm25) AS b, avg(graph) AS g FROM v GROUP BY 1)")
def headroom_by_class(spark, sf):
    found = B.headroom_by_class(two_arms(spark, sf).withColumns({c: F.round(c, 12) for c in ("graph", "bm25")}))
    cols = ("bm25", "graph", "raw_deficit", "headroom", "normalised_deficit")
    return found.select("class", "n", *[(F.round(c, 6) + 0).alias(c) for c in cols])


@query("registered_family_mt")
def registered_family_mt(spark, sf):
    v = two_arms(spark, sf).unionByName(_strata(spark, sf)).select(F.lit("ndcg_10").alias("key"), "query_id", "cls", (F.col("graph") - F.col("bm25")).alias("value"))
    return B.registered_family(v)


@query("shapley_bootstrap_mt")
def shapley_bootstrap_mt(spark, sf):
    cells = arm_scores(spark, sf).where("arm <> 'coordination'").select("query_id", F.col("arm").cast("int").alias("mask"), F.col("ndcg_10").alias("value"))
    return B.shapley_bootstrap(cells, PLAYERS)


_MASKS = ", ".join(f"avg(p.c{m}) AS value_{m}" for m in range(8))


def _phi(player: int) -> str:
    return " + ".join(f"{w:.17g} * value_{m}" for m, w in enumerate(B.shapley_matrix(3)[player]) if w)


@query("shapley_bootstrap_hash", with_("scores") + ", wide AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS place, count(*) OVER () AS n, " + ", ".join(f"max(ndcg_10) FILTER (arm = '{m}') AS c{m}" for m in range(8)) + f" FROM scores WHERE arm <> 'coordination' GROUP BY query_id), draws AS (SELECT r, {_MASKS} FROM (SELECT r, {_DRAW} AS spot FROM wide CROSS JOIN (SELECT unnest(range({ROUNDS})) AS r)) g JOIN wide p ON p.place = g.spot GROUP BY 1), phi AS (" + " UNION ALL ".join(f"SELECT '{p}' AS player, round({_phi(i)}, 9) AS d FROM draws" for i, p in enumerate(["idf", "tf_saturation", "length_norm"])) + f") SELECT player, round(list_sort(list(d))[51], 6) + 0 AS low, round(list_sort(list(d))[{ROUNDS} - 50], 6) + 0 AS high FROM phi GROUP BY 1")
def shapley_bootstrap_hash(spark, sf):
    cells = arm_scores(spark, sf).where("arm <> 'coordination'").groupBy("query_id").pivot("arm", [str(m) for m in range(8)]).agg(F.max("ndcg_10"))
    means = B.hashed_means(cells.select("query_id", *[F.col(str(m)).alias(f"value_{m}") for m in range(8)]), ROUNDS, SEED, *[f"value_{m}" for m in range(8)])
    out = None
    for i, player in enumerate(PLAYERS):
        d = means.select(F.round(F.expr(_phi(i)), 9).alias("d"))
        row = B.hashed_interval(d, "d", ROUNDS).select(F.lit(player).alias("player"), (F.round("low", 6) + 0).alias("low"), (F.round("high", 6) + 0).alias("high"))
        out = row if out is None else out.unionAll(row)
    return out


@query("spearman_interval_mt")
def spearman_interval_mt(spark, sf):
    return B.spearman_bootstrap(_properties(spark, sf).select(F.lit("length, idf").alias("comparison"), "query_id", F.col("query_length").cast("double").alias("x"), F.col("mean_idf").alias("y")))


@query("winloss_intervals_mt")
def winloss_intervals_mt(spark, sf):
    bins = E.quantile_bins(_properties(spark, sf).where("gold_count > 0").select("query_id", F.round("mean_idf", 9).alias("mean_idf")), "mean_idf")
    pairs = _pairs(spark, sf).join(bins, "query_id").select(F.col("bin").cast("string").alias("comparison"), "query_id", F.col("x").alias("a"), F.col("y").alias("b"))
    return B.paired_mersenne(pairs)


@query("winloss_by_gold_count", with_("scores", "gold") + "SELECT gold AS bin, count(*) AS n, count(*) FILTER (round(x.ndcg_10, 9) > round(y.ndcg_10, 9)) AS wins, count(*) FILTER (round(x.ndcg_10, 9) < round(y.ndcg_10, 9)) AS losses, count(*) FILTER (round(x.ndcg_10, 9) = round(y.ndcg_10, 9)) AS ties, round(avg(round(x.ndcg_10, 9) - round(y.ndcg_10, 9)), 6) + 0 AS mean_diff, count(*) < 5 AS sparse FROM gold JOIN scores x ON x.query_id = gold.query_id AND x.arm = '7' JOIN scores y ON y.query_id = gold.query_id AND y.arm = 'coordination' GROUP BY 1")
def winloss_by_gold_count(spark, sf):
    rel = judged(spark, sf)
    s = arm_scores(spark, sf, rel).select("arm", "query_id", F.round("ndcg_10", 9).alias("value"))
    arm = lambda a: s.where(F.col("arm") == a).select("query_id", "value")
    found = E.win_loss(arm("7"), arm("coordination"), E.value_bins(rel.groupBy("query_id").agg(F.count("*").alias("gold")), "gold"))
    return found.withColumn("mean_diff", F.round("mean_diff", 6) + 0)


@query("arms_across_sources", with_("scores", "qrels") + "SELECT source AS corpus, " + ", ".join(f"round(avg(ndcg_10) FILTER (arm = '{a}'), 6) AS \"{a}_ndcg_10\"" for a in ("7", "coordination")) + " FROM (SELECT DISTINCT query_id, source FROM qrels JOIN documents USING (doc_id)) JOIN scores USING (query_id) GROUP BY 1")
def arms_across_sources(spark, sf):
    rel = judged(spark, sf)
    of = rel.join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("corpus")), "doc_id").select("query_id", "corpus").distinct()
    wide = E.across_arms(arm_scores(spark, sf, rel).where("arm in ('7', 'coordination')").join(of, "query_id"), ["ndcg_10"])
    return rounded(wide, "7_ndcg_10", "coordination_ndcg_10")


@query("passage_counts", with_("inc", "tok") + ", p AS (SELECT DISTINCT doc_id, term AS node FROM tok WHERE length(term) BETWEEN 5 AND 8) SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, count(*) FILTER (g.node IS NOT NULL AND p.node IS NOT NULL) AS tp, count(*) FILTER (g.node IS NULL) AS fp, count(*) FILTER (p.node IS NULL) AS fn FROM inc g FULL JOIN p ON g.doc_id = p.doc_id AND g.node = p.node GROUP BY 1")
def passage_counts(spark, sf):
    words = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x).between(5, 8)))
    p = docs(spark, sf).select("doc_id", F.explode(words).alias("node"))
    return E.passage_counts(G.incidence(X.mentions(docs(spark, sf), X.LongTokens())), p)


@query("extraction_intervals_mt")
def extraction_intervals_mt(spark, sf):
    return B.clustered_intervals(passage_counts(spark, sf))


@query("majority_entities", "SELECT user_id AS doc_id, floor(value)::BIGINT AS node FROM (SELECT DISTINCT user_id, event_type, floor(value) AS value FROM events) GROUP BY 1, 2 HAVING count(*) >= 2")
def majority_entities(spark, sf):
    return E.majority(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("rater"), F.floor("value").alias("node")))


def _gold_pairs(spark, sf):
    rel = judged(spark, sf)
    return rel.alias("x").join(rel.alias("y"), "query_id").where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


@query("bridge_reachability_mt")
def bridge_reachability_mt(spark, sf):
    return G.reachability(entity_graph(spark, sf), _gold_pairs(spark, sf))


@query("bridge_reachability_observed", with_("inc", "qrels") + ", p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM qrels x JOIN qrels y USING (query_id) WHERE x.doc_id < y.doc_id), k AS (SELECT DISTINCT doc_id FROM inc), s AS (SELECT DISTINCT a, b FROM p JOIN inc i ON i.doc_id = a JOIN inc j ON j.doc_id = b AND i.node = j.node) SELECT count(*) AS gold_pairs_scored, round(coalesce(avg((s.a IS NOT NULL)::INT), 0), 6) AS observed_share_rate FROM p SEMI JOIN k ON k.doc_id = p.a LEFT JOIN s ON s.a = p.a AND s.b = p.b WHERE p.b IN (SELECT doc_id FROM k)")
def bridge_reachability_observed(spark, sf):
    return rounded(G.reachability(entity_graph(spark, sf), _gold_pairs(spark, sf), rounds=1).select("gold_pairs_scored", "observed_share_rate"), "observed_share_rate")


@query("oracle_entity_graph", with_("dtext", "qtext") + ", n AS (SELECT DISTINCT array_to_string(list_slice(string_split(run, ' '), 1, 4), ' ') AS node FROM qtext) SELECT doc_id, node FROM dtext JOIN n ON node <> '' AND contains(run, ' ' || node || ' ')")
def oracle_entity_graph(spark, sf):
    titles = items(spark, sf).select(F.array_join(F.slice(T.tokens(F.col("text")), 1, 4), " ").alias("title"))
    return G.titles_as_entities(docs(spark, sf), titles)


@query("gold_containment", with_("qrels", "title") + "SELECT count(*) AS n_queries, count(*) FILTER (c) AS n_contained FROM (SELECT query_id, bool_and(t.title IS NOT NULL) AS c FROM (SELECT query_id, coalesce(title, '') AS title FROM qrels LEFT JOIN title USING (doc_id)) g LEFT JOIN (SELECT DISTINCT title FROM title) t USING (title) GROUP BY 1)")
def gold_containment(spark, sf):
    return P.gold_contained(E.gold_titles(judged(spark, sf), titles(spark, sf)), titles(spark, sf))


@query("dense_encoded_top10")
def dense_encoded_top10(spark, sf):
    return rounded(R.dense_arm(R.HashedWords())(docs(spark, sf), items(spark, sf), 10), "score")


@query("hybrid_lexical_dense_top10")
def hybrid_lexical_dense_top10(spark, sf):
    return rounded(R.hybrid_arm(R.lexical_arm(), R.dense_arm(R.HashedWords()))(docs(spark, sf), items(spark, sf), 10), "score")


@query("anchor_top10", with_("tok", "qterm") + ", t2 AS (SELECT doc_id, term FROM tok WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in "a an and are as at be by for from has have how i in is it its of on or that the their there these this to was what when where which who why will with".split()) + ")), l2 AS (SELECT d.doc_id, coalesce(n, 0) AS length FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM t2 GROUP BY 1) USING (doc_id)), p2 AS (SELECT doc_id, term, count(*) AS tf FROM t2 GROUP BY 1, 2), d2 AS (SELECT term, count(*) AS df FROM p2 GROUP BY 1), s2 AS (SELECT count(*) AS n, avg(length) AS average FROM l2) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average))) AS score FROM qterm JOIN p2 USING (term) JOIN d2 USING (term) JOIN l2 USING (doc_id) CROSS JOIN s2 GROUP BY 1, 2)) WHERE rank <= 10")
def anchor_top10(spark, sf):
    return rounded(R.anchor(docs(spark, sf), items(spark, sf), 10), "score")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return ndcg_recall_bm25(spark, sf)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
