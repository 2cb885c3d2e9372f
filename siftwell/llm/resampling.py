"""Importance resampling of raw text toward a target: hashed n-gram models and Gumbel top-k.

Tokens (words with their case, and runs of marks) and their bigrams are hashed to buckets. The
raw model has the counts of all documents, the target model those of labelled good ones, at
most `most_target` of them. A document's log weight is the sum over its n-grams of the log
ratio of the two. Adding Gumbel noise, a hash of the row, and keeping the k largest keys draws
k documents without replacement in proportion to their weights; k is the rate times the rows,
and the rate is the share of good ones among all labels unless it is given.

The k-th key is found by counting keys in ever narrower bins, so nothing is sorted in one
task. Null and empty texts have log weight 0. Null ids are allowed, equal rows have equal
keys and ties at the k-th key go by id. Without labels the weights are 0; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import _text as T
from siftwell.llm._spark import saved
from siftwell.plans.lineage import positions

BUCKETS = 10_000
#: Labelled good documents in the target model at most.
MOST_TARGET = 20_000


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, row) of every unigram and bigram."""
    w = T.words(data, offsets, T.WORD_OR_MARK, T.IDENTITY)
    h = T.word_hashes(w)
    two = T.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    same = w.row[:-1] == w.row[1:] if len(h) > 1 else np.zeros(0, bool)
    return (np.concatenate([h, two[same]]) % np.uint64(buckets)).astype(np.int64), np.concatenate([w.row, w.row[:-1][same] if len(h) > 1 else w.row[:0]]), w.rows


def fit(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw for each bucket. docs(doc_id, text); good(doc_id): few enough to send to every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flags = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            for low, data, offsets in T.slices(batch.column(0)):
                at, row, rows = _grams(data, offsets, buckets)
                raw += np.bincount(at, minlength=buckets)
                target += np.bincount(at[flags[low : low + rows][row]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    marked = docs.join(F.broadcast(good.select("doc_id").distinct().withColumn("flag", F.lit(True))), "doc_id", "left")
    counts = marked.select("text", F.coalesce("flag", F.lit(False)).alias("flag")).mapInArrow(count, "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # as many as buckets at most
    raw, target = np.ones(buckets), np.ones(buckets)
    for b, r, t in rows:
        raw[b] += r
        target[b] += t
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value of a double column without nulls, by counting in bins; 1 <= k <= rows."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    while low < high:
        width = (high - low) / bins
        if not low < low + width < high:
            break
        at = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1))
        counts = df.where(F.col(col).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if r.n >= k:
                low, high = r.low, r.high
                break
            k -= r.n
    if low == high:
        return low
    # no more than a few doubles lie so close together
    for value, n in df.where(F.col(col).between(low, high)).groupBy(col).count().orderBy(F.desc(col)).collect():
        if n >= k:
            return value
        k -= n
    raise ValueError("fewer values than k")


def resample(docs: DataFrame, labels: DataFrame, rate: float | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, most_target: int = MOST_TARGET, seed: int = 11) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept) of the documents drawn; labels(doc_id, quality) with 1 for good."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.where("quality is not null")
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_target)
    ratio = fit(rows, good, buckets)
    if rate is None:
        rate = labels.agg(F.avg("quality")).first()[0]
        rate = 1.0 if rate is None else rate

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for low, data, offsets in T.slices(batch.column(1)):
                at, row, count = _grams(data, offsets, buckets)
                n[low : low + count] = np.bincount(row, minlength=count)
                weight[low : low + count] = np.bincount(row, ratio[at], minlength=count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), batch.column(2)], names=["doc_id", "n_grams", "log_weight", "u"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.withColumn("u", F.xxhash64("doc_id", "text", F.lit(seed))).mapInArrow(score, f"doc_id {kind}, n_grams long, log_weight double, u long")
    uniform = (F.pmod("u", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = saved(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).drop("u"))
    k = round(rate * scored.count())
    if k <= 0:
        return scored.limit(0).withColumn("kept", F.lit(True))
    cut = kth_largest(scored, "gumbel_key", k)
    above = scored.where(F.col("gumbel_key") > cut)
    ties = positions(scored.where(F.col("gumbel_key") == cut), "doc_id").where(F.col("place") < k - above.count()).drop("place")
    return above.unionAll(ties).withColumn("kept", F.lit(True))
