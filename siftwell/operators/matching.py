"""Documents against the terms of queries, in passes over documents.

`counted`, `tokenised` and `inside` keep for each document the numbers of the queries' terms that it holds, and how often. `best`
and `every` measure documents from these in the task that reads them, so no row for each query, document
and term is made or shuffled: a task gives its best k of each query, or the pairs that are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.plans.lineage import saved

#: Rows that a task looks at together, measures of a query and document that it holds at once, and rankings' rows of one load of queries.
ROWS, CELLS, HELD = 1024, 1 << 17, 1 << 21
HITS = "lengths array<bigint>, terms array<int>, counts array<int>"
Measures = Callable[["Chunk"], list[np.ndarray]]


class Terms:
    """Queries and their words, numbered, from terms(query_id, term); a pair counts as often as it has rows."""

    def __init__(self, terms: DataFrame):
        table = terms.select("query_id", "term").toArrow()
        self.kind = dict(terms.dtypes)["query_id"]
        queries, words = (table[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "term"))
        self.queries, self.words = queries.dictionary, words.dictionary
        query, word = queries.indices.to_numpy(), words.indices.to_numpy()
        order = np.lexsort((query, word))
        self.query, self.word = query[order], word[order]

    def load(self, first: int, last: int) -> Load:
        own = (self.query >= first) & (self.query < last)
        n = np.bincount(self.word[own], minlength=len(self.words))
        return Load(self.queries.slice(first, last - first), self.query[own] - first, n, np.cumsum(n) - n)

    def loads(self, rankings: int) -> Iterator[Load]:
        """The queries in loads whose rankings, of so many rows each, fit into HELD."""
        size = max(1, HELD // max(1, rankings))
        for first in range(0, len(self.queries), size):
            yield self.load(first, min(first + size, len(self.queries)))


class Load:
    """Some queries: those of term t are query[start[t] : start[t] + n[t]]."""

    def __init__(self, ids: pa.Array, query: np.ndarray, n: np.ndarray, start: np.ndarray):
        self.ids, self.query, self.n, self.start = ids, query, n, start


class Chunk:
    """A few documents and all queries of a load. term, count and length have a value for each document and term that it holds."""

    def __init__(self, docs: pa.Array, owner: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray, load: Load):
        self.docs, self.term, self.count, self.length, self.load = docs, term, count, length, load
        n = load.n[term]
        self.at = np.repeat(np.arange(len(term)), n)
        query = load.query[np.arange(len(self.at)) + np.repeat(load.start[term] - (np.cumsum(n) - n), n)]
        self.key = owner[self.at] * len(load.ids) + query

    def sum(self, weight: np.ndarray) -> np.ndarray:
        """[documents, queries]: the sums of a weight for each document and term over the terms shared."""
        return np.bincount(self.key, weight[self.at], len(self.docs) * len(self.load.ids)).reshape(len(self.docs), -1)

    def met(self) -> np.ndarray:
        return np.bincount(self.key, minlength=len(self.docs) * len(self.load.ids)).reshape(len(self.docs), -1) > 0


def _rows(docs: pa.Array, lengths: np.ndarray, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row for each document, of terms in the order of owner."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(docs)))]).astype(np.int32)
    listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
    one = pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1, dtype=np.int32)), pa.array(lengths.astype(np.int64)))
    return pa.RecordBatch.from_arrays([docs, one, listed(term), listed(count)], names=["doc_id", "lengths", "terms", "counts"])


def _kept(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, bool]:
    """found, computed once, and whether its ids differ; rows that share an id become one, with a length for each term."""
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        return saved(found), True
    each = found.select("doc_id", F.col("lengths")[0].alias("length"), F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("doc_id", "length", "x.terms").agg(F.sum("x.counts").cast("int").alias("counts"))
    rows = each.groupBy("doc_id").agg(F.collect_list(F.struct("length", "terms", "counts")).alias("x"))
    return saved(rows.select("doc_id", F.col("x.length").alias("lengths"), F.col("x.terms").alias("terms"), F.col("x.counts").alias("counts"))), False


def counted(docs: DataFrame, words: Column, terms: Terms) -> tuple[DataFrame, bool]:
    """(doc_id, lengths, terms, counts): how often each document's array of words holds each term, with a length of 0; and whether all ids differ."""
    known = terms.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(batch.column(1).flatten(), known), -1).to_numpy(zero_copy_only=False)
                there = term >= 0
                key, count = np.unique(np.repeat(np.arange(len(lengths)), lengths)[there] * len(known) + term[there], return_counts=True)
                yield _rows(batch.column(0), np.zeros(len(lengths)), key // max(1, len(known)), key % max(1, len(known)), count)

    return _kept(docs, docs.select("doc_id", words.alias("words")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {HITS}"))


#: Bytes of text that are looked at together.
BYTES = 1 << 18
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


class Text:
    """Bytes of some documents with a space after each, and hashes (64 bits) of any piece of them."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes]):
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        if len(Text.powers) <= len(self.data):
            n = max(2 * BYTES, len(self.data) + 1)
            Text.powers, Text.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (BASE, INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data + np.uint64(1)) * Text.powers[: len(self.data)], dtype=np.uint64)])

    def hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Text.inverses[start]

    def pieces(self, size: int) -> np.ndarray:
        """The hash of the `size` bytes from each place on."""
        n = max(0, len(self.data) - size + 1)
        return self.hashes(slice(0, n), slice(size, size + n))

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, hashes, sizes) of the runs of a-z and 0-9, in order."""
        fine = np.concatenate([[False], LETTERS[self.data], [False]])
        edges = np.flatnonzero(fine[1:] != fine[:-1])
        return np.searchsorted(self.ends, edges[::2], "right"), self.hashes(edges[::2], edges[1::2]), edges[1::2] - edges[::2]


class Words:
    """Numbered words of a-z and 0-9, found by hash and size."""

    BITS = np.uint64(44)

    def __init__(self, words: list[str]):
        text = Text([w.encode() for w in words])
        size = np.array([len(w) for w in words], np.int64)
        hashes = text.hashes(text.ends - 1 - size, text.ends - 1)
        self.own = np.argsort(hashes, kind="stable")
        self.hashes, self.size = hashes[self.own], size[self.own]
        self.fine = np.zeros(1 << 20, bool)
        self.fine[hashes >> self.BITS] = True

    def numbers(self, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word, and -1 for others."""
        out = np.full(len(hashes), -1)
        maybe = np.flatnonzero(self.fine[hashes >> self.BITS])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = (self.hashes[at] == hashes[maybe]) & (self.size[at] == size[maybe])
            out[maybe[same]] = self.own[at[same]]
        return out


class Finder:
    """Where words of a-z and 0-9 stand anywhere in text."""

    def __init__(self, words: list[str]):
        self.by = {}
        for size in sorted({len(w) for w in words}):
            own = [i for i, w in enumerate(words) if len(w) == size]
            known = Words([words[i] for i in own])
            # words whose end is their beginning can overlap themselves
            self.by[size] = known, np.array(own), np.array([any(words[i][:n] == words[i][-n:] for n in range(1, size)) for i in own])

    def places(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of words): every word's places from the left, none overlapping one of the same word before it."""
        wheres, whats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (known, own, folds) in self.by.items():
            hashes = text.pieces(size)
            where = np.flatnonzero(known.fine[hashes >> Words.BITS])
            number = known.numbers(hashes[where], np.full(len(where), size))
            where, number = where[number >= 0], number[number >= 0]
            if (touching := folds[number]).any():
                kept = ~touching
                last: dict[int, int] = {}
                for i in np.flatnonzero(touching):
                    if where[i] >= last.get(number[i], -1):
                        last[number[i]], kept[i] = where[i] + size, True
                where, number = where[kept], number[kept]
            wheres.append(where)
            whats.append(own[number])
        return np.concatenate(wheres), np.concatenate(whats)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Text]]:
    """(ids, Text) of rows(id, text), some BYTES at a time."""
    for batch in batches:
        rows, first = batch.column(1).cast(pa.binary()), 0
        sizes = np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False))
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BYTES, "right")))
            yield batch.column(0).slice(first, last - first), Text(rows.slice(first, last - first).to_pylist())
            first = last


def _of_texts(docs: DataFrame, text: Column, terms: Terms, look: Callable) -> tuple[DataFrame, bool]:
    """Rows of `counted` of what look(words) gives for a Text: documents, terms (-1: none of them) and documents' lengths."""
    words = terms.words.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = look(words)
        for ids, each in texts(batches):
            owner, term, lengths = found(each)
            key, count = np.unique((owner * len(words) + term)[term >= 0], return_counts=True)
            yield _rows(ids, lengths, key // max(1, len(words)), key % max(1, len(words)), count)

    return _kept(docs, docs.select("doc_id", text.alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {HITS}"))


def tokenised(docs: DataFrame, lower: Column, terms: Terms) -> tuple[DataFrame, bool]:
    """As `counted`, of the tokens of a-z and 0-9 of lower-case text, with their number as the length."""

    def look(words: list[str]) -> Callable:
        known = Words(words)

        def found(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            owner, hashes, size = text.tokens()
            return owner, known.numbers(hashes, size), np.bincount(owner, minlength=len(text.ends))

        return found

    return _of_texts(docs, lower, terms, look)


def inside(docs: DataFrame, text: Column, terms: Terms) -> tuple[DataFrame, bool]:
    """As `counted`, of the places of terms of a-z and 0-9 anywhere in folded text, without overlaps."""

    def look(words: list[str]) -> Callable:
        finder = Finder(words)

        def found(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            where, term = finder.places(text)
            return np.searchsorted(text.ends, where, "right"), term, np.zeros(len(text.ends))

        return found

    return _of_texts(docs, text, terms, look)


def runs_inside(docs: DataFrame, lower: Column, queries: DataFrame, head: int = 4) -> DataFrame:
    """(query_id, doc_id) of lower-case documents with the whole run of tokens of queries(query_id, q); sought by the first `head` tokens, then compared."""
    table = queries.select("query_id", "q").toArrow()
    ids, runs = table["query_id"].combine_chunks(), table["q"].to_pylist()
    numbers = {w: i for i, w in enumerate(dict.fromkeys(w for q in runs for w in q))}
    runs = [np.array([numbers[w] for w in q]) for q in runs]
    words = list(numbers)
    mix = lambda parts: [h := np.zeros(len(parts[0]), np.uint64), *(h := (h + (x + 2).astype(np.uint64)) * np.uint64(BASE) for x in parts)][-1]
    heads = {}
    for n in sorted({min(head, len(q)) for q in runs}):
        own = np.array([i for i, q in enumerate(runs) if min(head, len(q)) == n])
        keys = mix([np.array([runs[i][j] for i in own]) for j in range(n)])
        order = np.argsort(keys, kind="stable")
        heads[n] = keys[order], own[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(words)
        for docs_, text in texts(batches):
            owner, hashes, size = text.tokens()
            number = known.numbers(hashes, size)
            pairs = []
            for n, (keys, own) in heads.items():
                last = len(number) - n + 1
                at = np.flatnonzero(np.logical_and.reduce([number[j : last + j] >= 0 for j in range(n)])) if last > 0 else np.zeros(0, int)
                key = mix([number[at + j] for j in range(n)])
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                each = high - low
                query = own[np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
                at = np.repeat(at, each)
                for q in np.unique(query):
                    wanted, places = runs[q], at[query == q]
                    places = places[places + len(wanted) <= len(number)]
                    for j in range(len(wanted)):
                        places = places[(number[places + j] == wanted[j]) & (owner[places + j] == owner[places])]
                    found = np.unique(owner[places])
                    pairs.append((np.full(len(found), q), found))
            if pairs:
                query, doc = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), docs_.take(pa.array(doc))], names=["query_id", "doc_id"])

    schema = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}"
    return docs.select("doc_id", lower.alias("text")).mapInArrow(run, schema).distinct()


def _chunks(batches: Iterator[pa.RecordBatch], load: Load) -> Iterator[Chunk]:
    """Documents of (doc_id, lengths, terms, counts) that hold a term of the load."""
    size = max(1, CELLS // max(1, len(load.ids)))
    for batch in batches:
        for first in range(0, batch.num_rows, size):
            docs, lengths, terms, counts = batch.slice(first, size).columns
            n, many = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (terms, lengths))
            owner, start = np.repeat(np.arange(len(n)), n), np.cumsum(many) - many
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            length = lengths.flatten().to_numpy()[start[owner] + np.where(many[owner] == 1, 0, nth)]
            term, count = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            own = load.n[term] > 0
            if own.any():
                yield Chunk(docs, owner[own], term[own], count[own], length[own], load)


def _id_order(docs: pa.Array) -> np.ndarray | None:
    """Numbers in the order of the ids, where they are of a kind that sorts as in Spark."""
    if not (pa.types.is_integer(docs.type) or pa.types.is_string(docs.type) or pa.types.is_large_string(docs.type)):
        return None
    out = np.empty(len(docs), np.int64)
    out[pc.sort_indices(docs, null_placement="at_start").to_numpy()] = np.arange(len(docs))
    return out


class Best:
    """The best k documents of each group so far, by place (scores of nine places) and id."""

    def __init__(self, groups: int, k: int):
        self.k, self.edge, self.room = k, np.full(groups, -np.inf), 2 * groups * k + CELLS
        self.rows, self.held = [], 0

    def add(self, docs: pa.Array, group: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.rows.append((docs.take(pa.array(doc)), group, score))
        self.held += len(group)
        if self.held > self.room:
            self.cut()

    def cut(self) -> None:
        if not self.rows:
            return
        docs = pa.concat_arrays([r[0] for r in self.rows])
        group, score = (np.concatenate([r[i] for r in self.rows]) for i in (1, 2))
        place, ids = placed(score), _id_order(docs)
        order = np.lexsort((np.zeros(len(group)) if ids is None else ids, -place, group))
        starts = np.searchsorted(group[order], np.arange(len(self.edge)))
        nth = np.arange(len(order)) - starts[group[order]]
        full = np.bincount(group, minlength=len(self.edge)) >= self.k
        self.edge[full] = place[order[starts[full] + self.k - 1]]
        keep = order[nth < self.k] if ids is not None else order[place[order] >= self.edge[group[order]]]
        self.rows, self.held = [(docs.take(pa.array(keep)), group[keep], score[keep])], len(keep)
        if ids is None:
            self.room = max(self.room, 2 * self.held)


def placed(score: np.ndarray) -> np.ndarray:
    return score.round(9) if score.dtype.kind == "f" else score


def best(hits: DataFrame, terms: Terms, k: int, measures: Measures, n: int = 1, whole: bool = False) -> DataFrame:
    """(cell, query_id, doc_id, score): each task's best k of each query by each of the n measures; what a query doesn't meet has none."""
    kind = dict(hits.dtypes)["doc_id"]
    schema = f"cell int, query_id {terms.kind}, doc_id {kind}, score {'bigint' if whole else 'double'}"

    def ranked(load: Load) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = len(load.ids)
            top = Best(n * queries, k)
            for chunk in _chunks(batches, load):
                met = chunk.met()
                for cell, score in enumerate(measures(chunk)):
                    place = placed(score)
                    edge = top.edge[cell * queries : (cell + 1) * queries]
                    if len(place) > k and np.isinf(edge).any():
                        edge = np.maximum(edge, np.partition(np.where(met, place, -1), len(place) - k, axis=0)[len(place) - k])
                    doc, query = np.nonzero(met & (place >= edge) & (score > 0))
                    top.add(chunk.docs, cell * queries + query, doc, score[doc, query])
            top.cut()
            for docs, group, score in top.rows:
                yield pa.RecordBatch.from_arrays([pa.array((group // queries).astype(np.int32)), load.ids.take(pa.array(group % queries)), docs, pa.array(score)], names=["cell", "query_id", "doc_id", "score"])

        return hits.mapInArrow(run, schema)

    out = hits.sparkSession.createDataFrame([], schema)
    for load in terms.loads(n * k):
        out = out.unionAll(ranked(load))
    return out


def every(hits: DataFrame, terms: Terms, measures: Measures, names: list[str], kind: str = "double") -> DataFrame:
    """(query_id, doc_id, names..) of every query and document that share a term."""
    schema = f"query_id {terms.kind}, doc_id {dict(hits.dtypes)['doc_id']}, " + ", ".join(f"{x} {kind}" for x in names)

    def pairs(load: Load) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches, load):
                doc, query = np.nonzero(chunk.met())
                values = [pa.array(v[doc, query].astype(np.int64 if kind == "bigint" else float)) for v in measures(chunk)]
                yield pa.RecordBatch.from_arrays([load.ids.take(pa.array(query)), chunk.docs.take(pa.array(doc)), *values], names=["query_id", "doc_id", *names])

        return hits.mapInArrow(run, schema)

    out = hits.sparkSession.createDataFrame([], schema)
    for load in terms.loads(HELD >> 12):
        out = out.unionAll(pairs(load))
    return out
