"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of n words is shingled by min(5, n) words, so short items are found inside long texts
too; documents are shingled by each of these lengths that some item has. Items are partitioned
by length of shingle and by size, that is by the power of two above their number of distinct
shingles. For each partition that has items, every document is cut into windows of
twice that many shingles, so an item inside even the longest document has a Jaccard
similarity with some window that doesn't depend on the document's length; an item on a seam
overlaps two windows by half or more. A window is a candidate for an item if one of
`PERMUTATIONS` minima agrees (bands of one row). Candidates are verified by exact containment:
the share of the item's distinct shingles, as 64-bit hashes, that the whole document has.

Minima and shingles that no item can have are dropped on the executors by two bitmaps, whose
size follows the items to `MOST_BITS`; what passes is joined, so neither the items nor the
documents are gathered. A document keeps its shingles in one row, and only candidates meet
them. Minima of items are broadcast up to `BROADCAST` rows, and joined by shuffle beyond.
Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII.
Null or empty texts are in no pair. Each row of docs and each item row counts by itself;
repeated rows give repeated pairs, null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import _text as T
from siftwell.llm._spark import grouped, looked_up, saved

PERMUTATIONS = 64
#: log2 of the bits in each bitmap at most, and the rows of item minima that are broadcast at most.
MOST_BITS, BROADCAST = 26, 1 << 20

_rng = np.random.RandomState(7)
_A = (_rng.randint(0, 1 << 31, PERMUTATIONS).astype(np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 31, PERMUTATIONS).astype(np.uint64) | np.uint64(1)
_B = (_rng.randint(0, 1 << 31, PERMUTATIONS).astype(np.uint64) << np.uint64(33)) | _rng.randint(0, 1 << 31, PERMUTATIONS).astype(np.uint64)


def minima(h: np.ndarray, starts: np.ndarray, i: int) -> np.ndarray:
    """The least value under permutation i of each run that begins at `starts`."""
    with np.errstate(over="ignore"):
        return np.minimum.reduceat(h * _A[i] + _B[i], starts)


def _by_row(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, words' hashes, their rows, rows)."""
    for low, data, offsets in T.slices(column):
        w = T.words(data, offsets, T.ALNUM_WORD)
        yield low, T.word_hashes(w), w.row, w.rows


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, h), sorted."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[fresh], h[fresh]


def size_class(n: np.ndarray) -> np.ndarray:
    """The c with 2**c > n >= 2**(c-1)."""
    return np.frexp(n.astype(float))[1]


def _items(items: DataFrame, k: int) -> DataFrame:
    """(item, item_id, length, class, n_item, shingles, minima) of every item with a word: distinct shingles of `length` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words, word_row, rows in _by_row(batch.column(2)):
                h, row = T.shingle_hashes(words, word_row, k, rows)
                row, h = _distinct(row, h)
                there, starts, n = np.unique(row, return_index=True, return_counts=True)
                if not len(there):
                    continue
                least = np.stack([minima(h, starts, i) for i in range(PERMUTATIONS)], 1)
                length = np.minimum(k, np.bincount(word_row, minlength=rows)[there])
                at = pa.array(there + low)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(T.signed(h))), pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * PERMUTATIONS), pa.array(T.signed(least.ravel())))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(length.astype(np.int32)), pa.array(size_class(n).astype(np.int32)), pa.array(n.astype(np.int64)), *lists], names=["item", "item_id", "length", "class", "n_item", "shingles", "minima"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item", "item_id", "text").mapInArrow(run, f"item long, item_id {kind}, length int, class int, n_item long, shingles array<long>, minima array<long>")


class Bitmap:
    """A bit for the top bits of each of `n` values, 512 to 1,024 bits a value while MOST_BITS suffice; at most 2**(bits-6) words come to the driver."""

    def __init__(self, values: DataFrame, n: int):
        bits = min(MOST_BITS, max(12, int(n).bit_length() + 9))
        self.down, self.words = np.uint64(64 - bits), np.zeros(1 << (bits - 6), np.uint64)
        top = values.select(F.shiftrightunsigned("value", 64 - bits).alias("top"))
        found = top.groupBy(F.expr("shiftright(top, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(top & 63 as int)))").alias("word")).toArrow()
        self.words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = (values >> self.down).view(np.int64)
        return (self.words[at >> 6] >> (at & 63).view(np.uint64)) & np.uint64(1) > 0


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair with containment `least` or more."""
    item_rows = saved(_items(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), k))
    partitions = sorted(tuple(r) for r in item_rows.select("length", "class").distinct().collect())
    n, shingles = item_rows.agg(F.count("*"), F.coalesce(F.sum("n_item"), F.lit(0))).first()
    wanted = item_rows.select("item", "length", "class", F.posexplode("minima").alias("perm", "value"))
    by_min, by_shingle = Bitmap(wanted, n * PERMUTATIONS), Bitmap(item_rows.select(F.explode("shingles").alias("value")), shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words, word_row, rows in _by_row(batch.column(2)):
                hits, bags = [], []
                for length in sorted({p[0] for p in partitions}):
                    h, row = T.shingle_hashes(words, word_row, length, rows, whole=False)
                    if not len(h):
                        continue
                    count = np.bincount(row, minlength=rows)
                    place = np.arange(len(h)) - (np.cumsum(count) - count)[row]
                    met = np.zeros(rows, bool)
                    # a window of one size is two of the size before: minima of the larger come from those of the smaller
                    sizes = [c for own, c in partitions if own == length]
                    starts = [np.flatnonzero(place % (2 << c) == 0) for c in sizes]
                    inner = [np.searchsorted(a, b) for a, b in zip(starts, starts[1:], strict=False)]
                    owners = [row[s] for s in starts]
                    for i in range(PERMUTATIONS):
                        value = minima(h, starts[0], i)
                        for j, c in enumerate(sizes):
                            if j:
                                value = np.minimum.reduceat(value, inner[j - 1])
                            hit = np.flatnonzero(by_min(value))
                            if len(hit):
                                at = owners[j][hit]
                                met[at] = True
                                hits.append((at, np.full(len(at), length), np.full(len(at), c), np.full(len(at), i), value[hit]))
                    kept = met[row] & by_shingle(h)
                    bags.append((row[kept], h[kept]))
                if not hits:
                    continue
                at, length, c, perm, value = (np.concatenate(x) for x in zip(*hits, strict=True))
                # a row of its own for each document's shingles, with perm -1
                row, h = _distinct(np.concatenate([r for r, _ in bags]), np.concatenate([x for _, x in bags]))
                owner, first = np.unique(row, return_index=True)
                none = len(at)
                own = pa.array(np.concatenate([at, owner]) + low)
                stop = np.concatenate([np.zeros(none, np.int32), first, [len(h)]]).astype(np.int32)
                more = lambda x, fill: np.concatenate([x, np.full(len(owner), fill)])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(more(length, 0).astype(np.int32)), pa.array(more(c, 0).astype(np.int32)), pa.array(more(perm, -1).astype(np.int32)), pa.array(np.concatenate([value, np.zeros(len(owner), np.uint64)]).view(np.int64)), pa.ListArray.from_arrays(pa.array(stop), pa.array(T.signed(h)))], names=["row", "doc_id", "length", "class", "perm", "value", "bag"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = saved(rows.mapInArrow(run, f"row long, doc_id {kind}, length int, class int, perm int, value long, bag array<long>"))
    by = ["length", "class", "perm", "value"]
    candidates = saved(found.where("perm >= 0").select("row", *by).join(F.broadcast(wanted) if n * PERMUTATIONS <= BROADCAST else wanted, by).select("row", "item").distinct())
    times = grouped(candidates, ["item"], [F.count("*").alias("n")], [F.sum("n").alias("n")])
    pairs = looked_up(candidates, times.join(item_rows.select("item", "item_id", "n_item", "shingles"), "item"), "item")
    shared = pairs.join(found.where("perm < 0").select("row", "doc_id", "bag"), "row").withColumn("n_shared", F.size(F.array_intersect("shingles", "bag")).cast("long"))
    return shared.where(F.col("n_shared") >= F.lit(least) * F.col("n_item")).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
