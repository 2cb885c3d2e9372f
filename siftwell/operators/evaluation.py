"""Ranking metrics, controls that halt, query properties, coverage classes and win or loss by property."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import scoring as S
from siftwell.functions import text as T
from siftwell.plans.lineage import positions, small


class ControlFailed(AssertionError):
    pass


def metrics(queries: DataFrame, run: DataFrame, qrels: DataFrame, ndcg: tuple[int, ...] = (10,), recall: tuple[int, ...] = (10, 100)) -> DataFrame:
    """(query_id, ndcg_k.., recall_k..) for every query with judgements; one that retrieves nothing has 0. Only ranks count."""
    gain = F.col("rel") / F.log2(F.col("place") + 1)
    ideal = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("gold"), *[F.sum(F.when(F.col("place") <= k, gain).otherwise(0.0)).alias(f"ideal_{k}") for k in ndcg])
    hits = run.withColumnRenamed("rank", "place").join(qrels, ["query_id", "doc_id"])
    got = hits.groupBy("query_id").agg(*[F.sum(F.when(F.col("place") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in ndcg], *[F.count_if(F.col("place") <= k).alias(f"hit_{k}") for k in recall])
    rows = queries.select("query_id").join(ideal, "query_id").join(got, "query_id", "left")
    return rows.select("query_id", *[F.coalesce(F.col(f"dcg_{k}") / F.col(f"ideal_{k}"), F.lit(0.0)).alias(f"ndcg_{k}") for k in ndcg], *[F.coalesce(F.col(f"hit_{k}") / F.col("gold"), F.lit(0.0)).alias(f"recall_{k}") for k in recall])


def set_recall(queries: DataFrame, hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Recall over everything matched, before any cut."""
    got = hits.join(small(qrels), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    gold = qrels.groupBy("query_id").agg(F.count("*").alias("gold"))
    return queries.select("query_id").join(gold, "query_id").join(got, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.col("gold")).alias("set_recall"))


def size_summary(sizes: DataFrame) -> DataFrame:
    """Mean, upper median and zero count of sizes(n)."""
    placed = positions(sizes.select("n"), "n", total="total")
    return placed.agg(F.avg("n").alias("mean_size"), F.max(F.when(F.col("place") == F.floor(F.col("total") / 2), F.col("n"))).alias("upper_median"), F.count_if(F.col("n") == 0).alias("n_empty"))


def length_stats(lengths: DataFrame) -> DataFrame:
    agg = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), F.median("length").alias("median_length"), F.stddev_pop("length").alias("std_length"))
    return agg.withColumn("cv", S.ratio0(F.col("std_length"), F.col("mean_length")))


def query_properties(queries: DataFrame, qrels: DataFrame, docs: DataFrame, idf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(query_id, query_length, max_idf, mean_idf, gold_jaccard, gold_count); a term in no document has df 0."""
    each = queries.select("query_id", T.tokens(F.col("text")).alias("terms"))
    unseen = S.idf(F.col("n"), F.lit(0))
    weights = each.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).join(idf.select("term", "idf"), "term", "left").crossJoin(F.broadcast(n_docs)).groupBy("query_id").agg(F.max(F.coalesce("idf", unseen)).alias("max_idf"), F.avg(F.coalesce("idf", unseen)).alias("mean_idf"))
    # only judged documents are taken apart and joined
    texts = docs.join(small(qrels.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", T.tokens(F.col("text")).alias("doc_terms"))
    overlap = qrels.join(each, "query_id").join(texts, "doc_id", "left").groupBy("query_id").agg(F.avg(S.jaccard(F.col("terms"), F.coalesce("doc_terms", F.array().cast("array<string>")))).alias("gold_jaccard"), F.count("*").alias("gold_count"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return each.join(weights, "query_id", "left").join(overlap, "query_id", "left").select("query_id", F.size("terms").alias("query_length"), zero("max_idf"), zero("mean_idf"), zero("gold_jaccard"), F.coalesce("gold_count", F.lit(0)).alias("gold_count"))


def quantile_bins(df: DataFrame, value: str, bins: int = 4, key: str = "query_id") -> DataFrame:
    """Adds bin: equal counts by (value, key), remainders last."""
    placed = positions(df, value, key, name="place_", total="total_")
    return placed.withColumn("bin", F.floor((bins * (F.col("place_") + 1) - 1) / F.col("total_")).cast("int")).drop("place_", "total_")


def value_bins(df: DataFrame, value: str) -> DataFrame:
    """Adds bin: each value of a discrete property is its own."""
    return df.withColumn("bin", F.col(value))


def win_loss(a: DataFrame, b: DataFrame, binned: DataFrame, sparse_below: int = 5) -> DataFrame:
    """Wins, losses and ties of a over b in each bin; a, b(query_id, value)."""
    pairs = binned.join(a.withColumnRenamed("value", "x"), "query_id").join(b.withColumnRenamed("value", "y"), "query_id")
    return pairs.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.avg(F.col("x") - F.col("y")).alias("mean_diff")).withColumn("sparse", F.col("n") < sparse_below)


def coverage(queries: DataFrame, gold_titles: DataFrame, strip_title: bool = True) -> DataFrame:
    """(query_id, cls): how many gold titles the query names, 0 to 2."""
    title = T.without_disambiguator(F.col("title")) if strip_title else F.col("title")
    named = queries.join(gold_titles, "query_id", "left").select("query_id", T.run_inside(T.tokens(title), T.tokens(F.col("text"))).alias("hit"))
    return named.groupBy("query_id").agg(F.least(F.count_if("hit"), F.lit(2)).cast("int").alias("cls"))


def class_distribution(classes: DataFrame) -> DataFrame:
    bins = classes.sparkSession.range(3).select(F.col("id").cast("int").alias("cls"))
    return bins.join(classes.groupBy("cls").agg(F.count("*").alias("n")), "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))


def class_label(cls: Column) -> Column:
    """Classes 0 and 1 against 2; a missing class is in neither."""
    return F.when(cls.isin(0, 1), "unnamed").when(cls == 2, "named")


def profile(values: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean and empty rate in the overlapping classes 0, 1, 2 and 01; values(query_id, value, empty)."""
    labels = F.array(F.col("cls").cast("string"), F.when(F.col("cls") < 2, "01"))
    rows = values.join(classes, "query_id").select("value", "empty", F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("class"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg(F.col("empty").cast("double")).alias("empty_rate"))


def passage_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, tp, fp, fn) of (doc_id, node) sets: both are dealt by both columns once, and not joined."""
    marked = lambda df, g, p: df.select("doc_id", "node", F.lit(g).alias("g"), F.lit(p).alias("p"))
    each = marked(gold, True, False).unionAll(marked(predicted, False, True))
    # a null equals nothing
    each = each.groupBy("doc_id", "node", F.when(F.col("doc_id").isNull() | F.col("node").isNull(), F.col("g"))).agg(F.bool_or("g").alias("g"), F.bool_or("p").alias("p"))
    return each.groupBy("doc_id").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g")).alias("fp"), F.count_if(~F.col("p")).alias("fn"))


def prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pooled true and false positives, misses, precision, recall and F1 of (doc_id, node) sets."""
    n = passage_counts(gold, predicted).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    n = n.withColumn("precision", S.ratio0(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", S.ratio0(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", S.f1(F.col("precision"), F.col("recall")))


def across_arms(scores: DataFrame, measures: list[str]) -> DataFrame:
    """A row for each corpus with a column for each measure and arm, of scores(corpus, arm, query_id, measures..)."""
    means = scores.groupBy("corpus").pivot("arm").agg(*[F.avg(m).alias(m) for m in measures])
    return means if len(measures) > 1 else means.select("corpus", *[F.col(c).alias(f"{c}_{measures[0]}") for c in means.columns if c != "corpus"])


def empty_queries(queries: DataFrame, run: DataFrame) -> DataFrame:
    """(query_id) of the queries for which nothing was retrieved."""
    return queries.select("query_id").join(run.select("query_id").distinct(), "query_id", "left_anti")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, a, b) of two arms' (query_id, value); raises unless both score the same queries."""
    both = a.select("query_id", F.col("value").alias("a")).join(b.select("query_id", F.col("value").alias("b")), "query_id", "full")
    if not both.where("a is null or b is null").isEmpty():
        raise ValueError("the arms don't score the same queries")
    return both


def gold_titles(qrels: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, title) of the judged documents; one without a title has an empty one."""
    return qrels.join(titles.select("doc_id", "title"), "doc_id", "left").select("query_id", F.coalesce("title", F.lit("")).alias("title"))


def better(scores: DataFrame, measure: str) -> str:
    """The arm of scores(arm, query_id, measure) with the larger mean; of equal ones the first by name."""
    return scores.groupBy("arm").agg(F.avg(measure).alias("m")).orderBy(F.desc(F.round("m", 9)), "arm").first().arm


def majority(votes: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, node) that at least so many raters of votes(doc_id, rater, node) name."""
    return votes.groupBy("doc_id", "node").agg(F.countDistinct("rater").alias("n")).where(F.col("n") >= least).select("doc_id", "node")


def rater_agreement(votes: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard of raters over documents."""
    sets = votes.groupBy("doc_id", "rater").agg(F.collect_set("node").alias("nodes"))
    a, b = (sets.select("doc_id", F.col("rater").alias(f"r{i}"), F.col("nodes").alias(f"n{i}")) for i in (1, 2))
    return a.join(b, "doc_id").where("r1 < r2").groupBy("r1", "r2").agg(F.avg(S.jaccard(F.col("n1"), F.col("n2"))).alias("jaccard"), F.count("*").alias("n_docs"))


# controls: each raises ControlFailed, before anything is written


def gold_present(qrels: DataFrame, docs: DataFrame) -> None:
    missing = qrels.join(docs, "doc_id", "left_anti").limit(1).collect()
    if missing:
        raise ControlFailed(f"judged document {missing[0].doc_id} isn't in the corpus")


def one_row_each(docs: DataFrame) -> None:
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ControlFailed(f"document {twice[0].doc_id} has {twice[0]['count']} rows")


def strict_order(run: DataFrame) -> None:
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    if not run.withColumn("before", before).where("score >= before").isEmpty():
        raise ControlFailed("scores don't fall strictly")


def no_terms_no_rows(run: DataFrame, queries: DataFrame) -> None:
    empty = queries.where(F.size(T.tokens(F.col("text"))) == 0)
    if not run.join(empty, "query_id", "left_semi").isEmpty():
        raise ControlFailed("a query without terms retrieves documents")


def within(name: str, value: float, low: float, high: float) -> None:
    if not low - 1e-9 <= value <= high + 1e-9:
        raise ControlFailed(f"{name} is {value:.4f}, not in [{low}, {high}]")


def closure(value: float, published: float, slack: float = 0.10) -> None:
    within("closure", abs(value - published), 0.0, slack)


#: Published recall at 2 and at 5 of the nested subset, and the slack that is allowed.
SUBSET_RECALL, SUBSET_SLACK = {"recall_2": 0.554, "recall_5": 0.722}, 0.05


def subset_closure(scores: DataFrame, published: dict[str, float] = SUBSET_RECALL, slack: float = SUBSET_SLACK) -> dict[str, float]:
    """Mean measures of a judged subset's scores, each held against its published value."""
    found = scores.agg(*[F.avg(m).alias(m) for m in published]).first().asDict()
    for m, value in published.items():
        closure(found[m], value, slack)
    return found


def self_retrieval(run: DataFrame, least: float = 0.98) -> float:
    """The share of queries, which are documents, whose first result is themselves; raises below `least`."""
    rate = run.where("rank = 1").agg(F.avg((F.col("query_id") == F.col("doc_id")).cast("int"))).first()[0] or 0.0
    within("self retrieval", rate, least, 1.0)
    return rate


def shuffled(ndcg: float, most: float = 0.15) -> None:
    within("nDCG over shuffled vectors", ndcg, 0.0, most)


def set_recall_covers(set_recall_: float, recall_100: float) -> None:
    """What all matches recall can't be less than what the first hundred do."""
    if set_recall_ < recall_100 - 1e-9:
        raise ControlFailed(f"set recall {set_recall_:.4f} is below recall at 100 {recall_100:.4f}")


def same_corpus(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both have the same document ids: a graph ranks only the corpus it was built from."""
    if not (a.select("doc_id").exceptAll(b.select("doc_id")).isEmpty() and b.select("doc_id").exceptAll(a.select("doc_id")).isEmpty()):
        raise ControlFailed("the corpus isn't the one that was indexed")


def all_annotated(sample: DataFrame) -> None:
    left = sample.where(~F.col("annotated")).count()
    if left:
        raise ControlFailed(f"{left} passages aren't annotated")


def frozen_counts(found: dict[str, int], wanted: dict[str, int]) -> None:
    off = {k: (found.get(k), v) for k, v in wanted.items() if found.get(k) != v}
    if off:
        raise ControlFailed(f"counts differ (found, wanted): {off}")


def pool_controls(counts: DataFrame, titles: DataFrame, wanted: dict[str, int]) -> None:
    """Frozen counts of a pool; no title unresolved, and none that names two documents."""
    frozen_counts(counts.first().asDict(), {**wanted, "n_unresolved": 0})
    if not titles.where("title <> ''").groupBy("title").count().where("count > 1").isEmpty():
        raise ControlFailed("a title names two documents")


def coverage_controls(classes: DataFrame, plain: DataFrame, wanted: dict[int, int], reclassified: int) -> None:
    """Frozen sizes of the coverage classes, and how many queries another definition puts elsewhere."""
    frozen_counts({str(r.cls): r.n for r in class_distribution(classes).collect()}, {str(k): v for k, v in wanted.items()})
    moved = classes.join(plain.withColumnRenamed("cls", "other"), "query_id").where("cls <> other").count()
    frozen_counts({"reclassified": moved}, {"reclassified": reclassified})


def clean_tree(status: str, allow: bool = False) -> dict[str, object]:
    """What a summary says of the sources, from `git status --porcelain`; raises on changes unless they are allowed, and then records that."""
    if status.strip() and not allow:
        raise ControlFailed("the sources have changes that aren't committed")
    return {"clean": not status.strip(), "allowed": bool(status.strip())}


def partition_of_labels(whole: set[str], *parts: set[str]) -> None:
    if reduce(set.union, parts, set()) != whole or sum(map(len, parts)) != len(whole):
        raise ControlFailed("label sets overlap or leave some out")
