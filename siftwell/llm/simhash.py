"""SimHash near-duplicates through pigeonhole blocks.

A fingerprint's 64 bits are cut into four blocks of 16. Two fingerprints with at most two
different bits agree in at least two blocks, so they share one of the six pairs of blocks:
joining on (pair, 32 bits) misses no link, and the Hamming distance then verifies each
candidate. A bucket that holds very many distinct fingerprints isn't joined with itself:
its members emit themselves and their one-bit neighbours among the bits outside the key.
Two members at distance two or less share such a neighbour, and any two that share one are
at distance two or less, so stars around shared neighbours give the same components with a
bounded number of rows for each member.

Null text counts as empty; a text without words has fingerprint zero and links like any
other. Rows with equal fingerprints form one class before anything is joined, so copies
cost one partial aggregate. component_id is the smallest non-null doc_id reachable; it is
null only if no reachable row has a doc_id. Repeated rows each give a row.

`similar` finds near copies by Jaccard similarity of distinct shingles, five words by default.
Its fingerprints are longer: their bits differ at a rate that follows from the similarity, and
the share of differing bits verifies it with a standard error of about 0.02 at 0.8. Blocks are
as wide as the number of rows asks for, so buckets stay small, and as many as are needed for
two texts at the limit to miss all of them in 1 % of cases; closer texts miss far less. In a
bucket of very many members all are compared with one of them. Most of a large group of copies
is then known to be connected, and only those that aren't are compared with the whole bucket:
components are those of all verified pairs that share a block, without all pairs of a group.
Texts without words are equal to each other; a text of fewer words than k is one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import _text as T
from siftwell.llm._spark import components, grouped, looked_up, saved

#: Distinct fingerprints in a bucket up to which it is joined with itself.
BUCKET = 32


def fingerprint(data: np.ndarray, offsets: np.ndarray, k: int = 3, seed: int = 42) -> np.ndarray:
    """The unsigned fingerprint of every row."""
    w = T.words(data, offsets, T.SPACE_WORD)
    out = np.zeros(w.rows, np.uint64)
    if not len(w.start):
        return out
    count = np.bincount(w.row, minlength=w.rows)
    length = w.end - w.start
    # the words of a row, one space between: a shingle is a slice of it
    stop = np.cumsum(length + 1)
    begin = stop - length - 1
    flat = np.full(stop[-1], 0x20, np.uint8)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    flat[place + np.repeat(begin, length)] = w.data[place + np.repeat(w.start, length)]
    first = np.cumsum(count) - count
    n = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    of = np.repeat(np.arange(w.rows), n)
    lo = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of]
    hi = lo + np.minimum(k, count[of]) - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin[lo].tolist(), (begin[hi] + length[hi]).tolist(), strict=True)), np.uint64, len(lo))
    rows = np.flatnonzero(n)
    stops = np.cumsum(n[rows])
    at = 0
    for i, row in enumerate(rows):
        part = h[at : stops[i]]
        at = stops[i]
        ones = np.zeros(64)
        for low in range(0, len(part), 1 << 16):  # the bits of a long text are counted in pieces
            bits = np.unpackbits(part[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)
        out[row] = np.packbits(2 * ones > len(part), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprint(data, offsets, k, seed) for _, data, offsets in T.slices(batch.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _blocks(fps: DataFrame) -> DataFrame:
    """(pair, key, fp): a row for each pair of 16-bit blocks."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.struct(F.lit(16 * a + b).alias("pair"), F.shiftleft(block[a], 16).bitwiseOR(block[b]).alias("key")) for a, b in combinations(range(4), 2)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.pair", "k.key", "fp")


def links(fps: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within `bits` (at most 2)."""
    if bits > 2:
        raise ValueError("four blocks and pairs of them find links of two bits at most")
    blocks = _blocks(fps)
    sizes = blocks.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = saved(blocks.join(sizes, ["pair", "key"]))
    few = blocks.where(F.col("n") <= bucket)
    left, right = few.select("pair", "key", F.col("fp").alias("a")), few.select("pair", "key", F.col("fp").alias("b"))
    near = left.join(right, ["pair", "key"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")
    if bits < 1:
        return near
    many = blocks.where(F.col("n") > bucket)
    outside = F.array_except(F.sequence(F.lit(0), F.lit(3)), F.array(F.shiftright("pair", 4), F.col("pair").bitwiseAND(F.lit(15))))
    places = F.flatten(F.transform(outside, lambda o: F.sequence(o * 16, o * 16 + 15)))
    masks = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    flips = F.transform(places, lambda p: F.col("fp").bitwiseXOR(F.get(masks, p)))
    stars = many.select("fp", F.explode(F.concat(F.array("fp"), flips) if bits == 2 else F.array("fp")).alias("at")).distinct()
    if bits == 1:
        # a one-bit neighbour that is itself a member
        members = many.select(F.col("fp").alias("b")).distinct()
        return near.unionAll(many.select(F.col("fp").alias("a"), F.explode(flips).alias("b")).join(members, "b").select("a", "b"))
    heads = stars.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return near.unionAll(stars.join(heads, "at").where("fp <> a").select("a", F.col("fp").alias("b"))).distinct()


def _labelled(each: DataFrame, classes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(doc_id, key, component_id) for the rows of each; classes has each key once, with the least doc_id and the number n of rows."""
    found = saved(components(edges))
    least = classes.join(found, classes[key] == found.node).groupBy("component").agg(F.min("least").alias("linked"))
    linked = found.join(least, "component").select(F.col("node").alias(key), "linked")
    known = classes.join(linked, key, "left").select(key, "n", F.coalesce("linked", "least").alias("component_id"))
    return looked_up(each, known, key).select("doc_id", key, "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; see the module's text for nulls, empty texts and ties."""
    each = saved(fingerprints(docs, id_col, text_col, k, seed))
    classes = saved(grouped(each, ["fp"], [F.min("doc_id").alias("least"), F.count("*").alias("n")], [F.min("least").alias("least"), F.sum("n").alias("n")]))
    return _labelled(each, classes, links(classes.select("fp"), bits), "fp")


class Blocks(NamedTuple):
    """`count` blocks of `width` bits in a fingerprint of `longs` 64-bit numbers, and the share of bits that may differ."""

    width: int
    count: int
    longs: int
    differ: float

    def most(self, longs: int, errors: float) -> int:
        """Bits of `longs` numbers that may differ, by that many standard errors more than the share."""
        bits = 64 * longs
        return int(bits * self.differ + errors * math.sqrt(bits * self.differ * (1 - self.differ)))


def blocks_for(rows: int, similarity: float = 0.8, miss: float = 0.01) -> Blocks:
    """Blocks so wide that unrelated rows seldom share one, and so many that texts at `similarity` miss all with probability `miss`.

    Sets of Jaccard similarity s have a cosine of 2s / (1 + s) at least.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = max(16, math.ceil(math.log2(max(rows, 1))) - 2)
    count = math.ceil(math.log(miss) / math.log1p(-((1 - differ) ** width)))
    return Blocks(width, count, -(-width * count // 64), differ)


def signature(data: np.ndarray, offsets: np.ndarray, k: int, longs: int) -> np.ndarray:
    """Rows of `longs` unsigned numbers: a bit is that of most distinct shingles, a tie goes as the shingle of the least hash."""
    w = T.words(data, offsets, T.SPACE_WORD)
    out = np.zeros((w.rows, longs), np.uint64)
    h, row = T.shingle_hashes(T.word_hashes(w), w.row, k, w.rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    begin = np.searchsorted(row, np.arange(w.rows + 1))
    salts = T.mix(np.arange(1, longs + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(begin)):
        part = h[begin[i] : begin[i + 1]]
        ones, first = np.zeros(64 * longs, np.int64), None
        for low in range(0, len(part), 255):  # so many ones fit a byte
            bits = np.unpackbits(T.mix(part[low : low + 255, None] ^ salts).view(np.uint8), axis=1, bitorder="little")
            first = bits[0] if first is None else first
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
        out[i] = np.packbits(2 * ones + first > len(part), bitorder="little").view(np.uint64)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, longs: int) -> DataFrame:
    """(doc_id, sig) for every row; sig is the long fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [signature(data, offsets, k, longs) for _, data, offsets in T.slices(batch.column(1))]
            sig = np.concatenate(parts) if parts else np.zeros((0, longs), np.uint64)
            ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * longs, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(sig.ravel().view(np.int64)))], names=["doc_id", "sig"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, sig array<long>")


def _in_blocks(classes: DataFrame, shape: Blocks) -> DataFrame:
    """(key, node, probe): a row for each block; probe is the first number of the fingerprint."""
    place = np.int64(1) << np.arange(shape.width, dtype=np.int64)
    names = np.arange(shape.count, dtype=np.int64) << 48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 10):
                part = batch.slice(low, 1 << 10)
                node, sig = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, shape.longs)
                bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1, bitorder="little")[:, : shape.width * shape.count]
                keys = bits.reshape(-1, shape.count, shape.width) @ place + names
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node, shape.count)), pa.array(np.repeat(sig[:, 0], shape.count))], names=["key", "node", "probe"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long, probe long")


def similar_links(classes: DataFrame, shape: Blocks, bucket: int = BUCKET, salts: int = 16) -> DataFrame:
    """Edges (a, b) between the nodes of classes(node, sig) whose components are those of all pairs that share a block and differ in few enough bits."""
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("probe_b"))) <= shape.most(1, 4)
    blocks = saved(_in_blocks(classes, shape))
    # one member of each bucket: by a hash, so that one text doesn't lead all buckets of its group
    member = F.struct(F.xxhash64("key", "node").alias("by"), "node", "probe")
    sizes = blocks.groupBy("key").agg(F.count("*").alias("n"), F.min(member).alias("head")).where("n > 1")
    blocks = blocks.join(sizes, "key")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole fingerprints are near."""
        sig = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        differing = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return pairs.distinct().join(sig[0], "a").join(sig[1], "b").where(differing <= shape.most(shape.longs, 1)).select("a", "b")

    few = blocks.where(F.col("n") <= bucket).select("key", "node", "probe")
    other = few.select("key", F.col("node").alias("b"), F.col("probe").alias("probe_b"))
    pairs = few.join(other, "key").where((F.col("node") < F.col("b")) & near).select(F.col("node").alias("a"), "b")
    many = saved(blocks.where(F.col("n") > bucket).select("key", "node", "probe", "head"))
    led = many.withColumn("probe_b", F.col("head.probe")).where((F.col("head.node") != F.col("node")) & near)
    edges = saved(verified(pairs.unionAll(led.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")))))
    # of large buckets: what isn't connected with most of the bucket yet meets all of it
    found = components(edges).withColumnRenamed("component", "of")
    placed = saved(many.join(found, "node", "left").select("key", "node", "probe", F.coalesce("of", "node").alias("of")))
    main = placed.groupBy("key", "of").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("of", F.struct("n", "of")).alias("main"))
    apart = placed.join(main, "key").where("of <> main").select("key", F.col("node").alias("b"), F.col("probe").alias("probe_b"), F.col("of").alias("of_b"))
    apart = apart.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(apart, ["key", "salt"]).where((F.col("of") != F.col("of_b")) & near)
    return edges.unionAll(verified(met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, miss: float = 0.01) -> DataFrame:
    """(doc_id, node, component_id) for every row of docs: component_id is the smallest doc_id reachable over similar texts; see the module's text."""
    shape = blocks_for(docs.count(), similarity, miss)
    each = signatures(docs, id_col, text_col, k, shape.longs).withColumn("node", F.xxhash64("sig"))
    each = saved(each)
    classes = saved(grouped(each, ["node"], [F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("sig").alias("sig")], [F.min("least").alias("least"), F.sum("n").alias("n"), F.any_value("sig").alias("sig")]))
    return _labelled(each.select("doc_id", "node"), classes.drop("sig"), similar_links(classes, shape), "node")
