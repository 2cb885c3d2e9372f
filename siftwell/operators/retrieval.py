"""Rankers. Each gives (query_id, doc_id, score, rank): at most k documents a query, by score and then id.

Scores are rounded to nine places before they are compared, so the order in which a cluster
adds them up can't change a ranking.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import scoring as S
from siftwell.functions import text as T
from siftwell.operators import matching as M
from siftwell.plans.lineage import positions, saved, small
from siftwell.sources import files

CELLS = [(bool(m & 1), bool(m & 2), bool(m & 4)) for m in range(8)]
LADDER = [0, 1, 3, 7]
#: Bytes of query vectors that are sent to the executors at once.
QUERY_BYTES = 64 << 20
#: Queries that a task holds against 8,192 vectors at once: 8 MB for each of the few arrays of their cosines.
ABREAST = 128


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    order = order or (F.desc(F.round("score", 9)), F.col("doc_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class Index:
    """Postings with document lengths, document frequencies, and the corpus's size and mean length.

    Built from docs(doc_id, text), or read from a folder that `store` wrote; a stored index is read by term.
    """

    BUCKETS = 64

    def __init__(self, docs: DataFrame):
        self.docs = docs
        each = docs.select("doc_id", T.tokens(F.col("text")).alias("terms"))
        self.lengths = each.select("doc_id", F.size("terms").cast("long").alias("length"))
        self.tokens = each.select("doc_id", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
        self.postings = self.tokens.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
        self.df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.stats = self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))
        self.path = None

    @staticmethod
    def _bucket(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(Index.BUCKETS)).cast("int")

    def store(self, path: str) -> Index:
        """Writes postings by bucket of term and sorted by term, lengths, df and stats below path, and gives the index that reads them."""
        rows = self.postings.withColumn("bucket", self._bucket(F.col("term")))
        rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("term", F.lit(1)), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")
        stored = Index.load(self.lengths.sparkSession, path, False)
        stored.postings.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/df")
        self.stats.write.parquet(f"{path}/stats")
        return Index.load(self.lengths.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str, whole: bool = True) -> Index:
        index = Index.__new__(Index)
        index.path, index.docs, index.tokens = path, None, None
        index.postings, index.lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
        if whole:
            index.df, index.stats = spark.read.parquet(f"{path}/df"), spark.read.parquet(f"{path}/stats")
        return index

    def idf(self) -> DataFrame:
        return self.df.crossJoin(F.broadcast(self.stats)).withColumn("idf", S.idf(F.col("n"), F.col("df")))

    def held(self, terms: M.Terms) -> tuple[DataFrame, np.ndarray, float]:
        """What each document holds of the terms (as matching.counted gives it), their idf by number, and the mean length."""
        if self.path is None:
            hits, apart = M.tokenised(self.docs, T.lowered(F.col("text")), terms)
            found = hits.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
            stats = hits.agg(F.count("*").alias("n"), F.avg(F.col("lengths")[0]).alias("average")) if apart else self.stats
        else:
            spark = self.lengths.sparkSession
            numbers = spark.createDataFrame(pa.table({"term": terms.words, "number": pa.array(np.arange(len(terms.words)), pa.int32())}))
            known = small(numbers.withColumn("bucket", self._bucket(F.col("term"))))
            buckets = [r.bucket for r in known.select("bucket").distinct().collect()]
            wanted = self.postings.where(F.col("bucket").isin(buckets)).join(known, ["bucket", "term"])
            rows = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("length").cast("bigint").alias("length"), "number", F.col("tf").cast("int").alias("tf"))).alias("x"))
            hits = saved(rows.select("doc_id", F.col("x.length").alias("lengths"), F.col("x.number").alias("terms"), F.col("x.tf").alias("counts")))
            found, stats = self.df.join(small(numbers), "term"), self.stats
        n, average = stats.first()
        df = np.zeros(len(terms.words))
        for r in found.select("number", "df").collect():
            df[r.number] = r.df
        return hits, np.log((n - df + 0.5) / (df + 0.5) + 1), average or 0.0


def query_words(queries: DataFrame) -> M.Terms:
    return M.Terms(queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")))


def cell_scores(cells: list[tuple[bool, bool, bool]], idf: np.ndarray, average: float) -> M.Measures:
    """The scores of some cells of the lexical factorial."""

    def scores(chunk: M.Chunk) -> list[np.ndarray]:
        own, norm = idf[chunk.term], S.length_norms(chunk.length, average)
        return [chunk.sum(S.term_weights(chunk.count, own, norm, *c)) for c in cells]

    return scores


def lexical(index: Index, queries: DataFrame, k: int, use_idf: bool = True, saturation: bool = True, use_length: bool = True) -> DataFrame:
    """One cell of the lexical factorial; all three on is BM25."""
    terms = query_words(queries)
    hits, idf, average = index.held(terms)
    return top_k(M.best(hits, terms, k, cell_scores([(use_idf, saturation, use_length)], idf, average)).drop("cell"), k)


def factorial(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, cell_0 .. cell_7) in one pass: bit 1 idf, 2 saturation, 4 length."""
    terms = query_words(queries)
    hits, idf, average = index.held(terms)
    return M.every(hits, terms, cell_scores(CELLS, idf, average), [f"cell_{m}" for m in range(8)])


def factorial_runs(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(mask, query_id, doc_id, score, rank) for all eight cells."""
    terms = query_words(queries)
    hits, idf, average = index.held(terms)
    found = M.best(hits, terms, k, cell_scores(CELLS, idf, average), 8).withColumnRenamed("cell", "mask")
    rank = F.row_number().over(Window.partitionBy("mask", "query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries whose runs of tokens go to the executors; more are joined.
MOST_RUNS = 1 << 17


def contained_runs(docs: DataFrame, queries: DataFrame, head: int = 4, most: int = MOST_RUNS) -> DataFrame:
    """(query_id, doc_id): documents with the query's whole run of tokens.

    Up to `most` queries go to the documents, which are read once; more are joined on hashes of the first `head` tokens, then verified.
    """
    q = saved(queries.select("query_id", T.tokens(F.col("text")).alias("q")).where(F.size("q") > 0).withColumn("of", F.least(F.size("q"), F.lit(head))))
    if 0 < q.count() <= most:
        return M.runs_inside(docs, T.lowered(F.col("text")), q, head)
    d = docs.select("doc_id", T.tokens(F.col("text")).alias("d"))
    hashed = lambda c, i, n: F.xxhash64(*[F.get(c, i + j) for j in range(n)])
    found = None
    for n in sorted(r.of for r in q.select("of").distinct().collect()):
        heads = q.where(F.col("of") == n).select("query_id", hashed(F.col("q"), F.lit(0), n).alias("h"))
        grams = F.transform(F.sequence(F.lit(0), F.size("d") - n), lambda i: hashed(F.col("d"), i, n))  # noqa: B023
        met = d.where(F.size("d") >= n).select("doc_id", F.explode(grams).alias("h")).join(small(heads), "h").select("query_id", "doc_id").distinct()
        found = met if found is None else found.unionAll(met)
    if found is None:
        return docs.join(queries, F.lit(False)).select("query_id", "doc_id")
    pairs = small(found.join(q, "query_id"))
    return d.join(pairs, "doc_id").where(T.run_inside(F.col("q"), F.col("d"))).select("query_id", "doc_id").distinct()


def _coordinated(docs: DataFrame, queries: DataFrame, bounded: bool) -> tuple[M.Terms, DataFrame]:
    """Query terms without stop words, and each document's places of them."""
    terms = M.Terms(queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term")))
    hits, _ = M.counted(docs, T.unicode_words(F.col("text")), terms) if bounded else M.inside(docs, T.folded(F.col("text")), terms)
    return terms, hits


def _matched(chunk: M.Chunk) -> list[np.ndarray]:
    return [chunk.sum(np.ones(len(chunk.term))), chunk.sum(chunk.count)]


def coordination_hits(docs: DataFrame, queries: DataFrame, bounded: bool = True) -> DataFrame:
    """(query_id, doc_id, matched, total): distinct query terms in the document, and their places."""
    terms, hits = _coordinated(docs, queries, bounded)
    return M.every(hits, terms, _matched, ["matched", "total"], "bigint")


def coordination(docs: DataFrame, queries: DataFrame, k: int, bounded: bool = True) -> DataFrame:
    """As coordination_hits, the best k of each query."""
    terms, hits = _coordinated(docs, queries, bounded)

    def both(chunk: M.Chunk) -> list[np.ndarray]:
        matched, total = _matched(chunk)
        return [(matched.astype(np.int64) << 32) + total.astype(np.int64)]  # below 2**53, as terms and places are

    found = M.best(hits, terms, k, both, whole=True).select("query_id", "doc_id", F.shiftright("score", 32).alias("matched"), F.col("score").bitwiseAND(F.lit((1 << 32) - 1)).alias("total"))
    return top_k(found, k, F.desc("matched"), F.desc("total"), F.col("doc_id"))


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, not empty, and without null or non-finite components."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def dense(vectors: DataFrame, queries: DataFrame, k: int, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact cosine of every query to every vector of its length. vectors(doc_id, embedding), queries(query_id, embedding).

    Vectors that are not usable are in no ranking, and such queries have none. Queries go out in loads of `most_bytes`,
    each of which reads the vectors once; a task keeps its best k of each query for each block of vectors, so what is
    shuffled depends on blocks, queries and k only.
    """
    kinds = [dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]]
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    rows = queries.where(usable(F.col("embedding"))).select("query_id", S.unit(F.col("embedding")).alias("u")).toLocalIterator()
    targets = vectors.where(usable(F.col("embedding"))).select("doc_id", S.unit(F.col("embedding")).alias("u"))

    def near(load: dict[int, list]) -> DataFrame:
        blocks = {dim: (pa.array([i for i, _ in own]), np.array([u for _, u in own])) for dim, own in load.items()}

        def best(ids: pa.Array, q: np.ndarray, docs: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            sims = q @ x.T
            place = sims.round(9)
            if k < len(x):
                # ties at the edge stay: an id decides between them
                edge = np.partition(place, len(x) - k, axis=1)[:, len(x) - k]
                who, where = np.nonzero(place >= edge[:, None])
            else:
                who, where = (i.ravel() for i in np.indices(sims.shape))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(who)), docs.take(pa.array(where)), pa.array(sims[who, where])], names=["query_id", "doc_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for dim in np.intersect1d(np.unique(sizes), list(blocks)):
                    own = pa.array(np.flatnonzero(sizes == dim))
                    docs, x = batch.column(0).take(own), batch.column(1).take(own).flatten().to_numpy().reshape(-1, dim)
                    ids, q = blocks[dim]
                    for first in range(0, len(q), ABREAST):
                        for low in range(0, len(x), 8192):
                            yield best(ids.slice(first, ABREAST), q[first : first + ABREAST], docs.slice(low, 8192), x[low : low + 8192])

        return targets.mapInArrow(run, schema)

    out, load, held = vectors.sparkSession.createDataFrame([], schema), {}, 0
    for r in rows:
        load.setdefault(len(r.u), []).append((r.query_id, r.u))
        held += 8 * len(r.u)
        if held >= most_bytes:
            out, load, held = out.unionAll(near(load)), {}, 0
    return top_k(out.unionAll(near(load)) if load else out, k)


def fuse(*runs: DataFrame, k: int, rrf_k: int = S.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of runs."""
    every = runs[0].select("query_id", "doc_id", "rank")
    for r in runs[1:]:
        every = every.unionAll(r.select("query_id", "doc_id", "rank"))
    return top_k(every.groupBy("query_id", "doc_id").agg(F.sum(S.rrf(F.col("rank"), rrf_k)).alias("score")), k)


class Arm(Protocol):
    """A ranker: at most k documents a query."""

    def __call__(self, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class Encoder(Protocol):
    """Turns texts into vectors; `name` tells cached vectors of one encoder from those of another."""

    name: str
    dim: int

    def documents(self, texts: DataFrame) -> DataFrame:
        """(doc_id, embedding) of texts(doc_id, text)."""

    def queries(self, texts: DataFrame) -> DataFrame:
        """(query_id, embedding) of texts(query_id, text)."""


class HashedWords:
    """The default encoder, without a model: counts of tokens in hashed places, with signs, and a prefix for queries only."""

    def __init__(self, dim: int = 64, prefix: str | None = None):
        self.dim, self.prefix, self.name = dim, prefix, f"hashed-words-{dim}-{prefix or ''}"

    def _encode(self, texts: DataFrame, key: str, text: Column) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, self.dim))
                places, hashes = batch.column(1), batch.column(1).flatten().to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
                np.add.at(out, (owner, (hashes >> 1) % self.dim), np.where(hashes & 1, 1.0, -1.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * self.dim), pa.array(out.ravel()))], names=[key, "embedding"])

        rows = texts.select(key, F.transform(T.tokens(text), lambda t: F.xxhash64(t)).alias("h"))
        return rows.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<double>")

    def documents(self, texts: DataFrame) -> DataFrame:
        return self._encode(texts, "doc_id", F.col("text"))

    def queries(self, texts: DataFrame) -> DataFrame:
        return self._encode(texts, "query_id", T.prefixed(F.col("text"), self.prefix))


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors, if all of them have that length; otherwise it raises."""
    wrong = vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).limit(1).collect()
    if wrong:
        raise ValueError(f"an encoder of {dim} dimensions gave {wrong[0]}")
    return vectors


def dense_arm(encoder: Encoder, cache: str | None = None, shuffle: int | None = None) -> Arm:
    """Exact cosine over the encoder's vectors; those of a corpus are kept below `cache` by encoder and content. With `shuffle`, a seed, every document has another's vector."""

    def arm(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        vectors = encoder.documents(docs)
        if cache:
            vectors = files.cached(vectors, cache, f"{hashlib.sha256(encoder.name.encode()).hexdigest()[:16]}-{files.corpus_fingerprint(docs)}")
        vectors = checked(vectors, encoder.dim)
        if shuffle is not None:
            ids = positions(vectors.select("doc_id"), "doc_id")
            dealt = positions(vectors.select("doc_id", "embedding"), F.xxhash64("doc_id", F.lit(shuffle)), "doc_id")
            vectors = ids.join(dealt.select("place", "embedding"), "place").select("doc_id", "embedding")
        return dense(vectors, checked(encoder.queries(queries), encoder.dim), k)

    return arm


def lexical_arm(use_idf: bool = True, saturation: bool = True, use_length: bool = True) -> Arm:
    return lambda docs, queries, k: lexical(Index(docs), queries, k, use_idf, saturation, use_length)


def coordination_arm(bounded: bool = True) -> Arm:
    score = F.col("matched") + F.col("total") / (F.col("total") + 1)
    return lambda docs, queries, k: coordination(docs, queries, k, bounded).select("query_id", "doc_id", score.alias("score"), "rank")


def hybrid_arm(*arms: Arm, rrf_k: int = S.RRF_K, candidate_k: int = 100) -> Arm:
    """Reciprocal rank fusion; each arm is asked for candidate_k documents at least."""
    return lambda docs, queries, k: fuse(*[arm(docs, queries, max(k, candidate_k)) for arm in arms], k=k, rrf_k=rrf_k)


def cell_name(mask: int) -> str:
    """The name of a cell of the factorial: its mechanisms in the ladder's order, none for the plain one."""
    return "+".join(n for n, on in zip(("idf", "tf_saturation", "length_norm"), CELLS[mask], strict=True) if on) or "none"


def anchor(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 without stop words on either side, as an outside anchor; words are not stemmed here."""
    kept = lambda df: df.withColumn("text", F.array_join(F.filter(T.tokens(F.col("text")), lambda x: ~x.isin(T.STOPWORDS)), " "))
    return lexical(Index(kept(docs)), kept(queries), k)


def strictly_decreasing(run: DataFrame) -> DataFrame:
    """Scores lowered by a billionth a place, so that ties fall strictly."""
    return run.withColumn("score", F.col("score") - (F.col("rank") - 1) * 1e-9)
