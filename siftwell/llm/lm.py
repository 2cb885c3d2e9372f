"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, over a word-level tail.

The vocabulary of the neural part is the `vocabulary - 3` most frequent training words, a class
for all other words, the end of a text, and the start (in contexts only); unless given it grows as
twice the cube root of the training tokens, from LEAST to MOST_VOCABULARY, which bounds its tables. Counts of all
(two words before, word) triples of all training texts are gathered by a distributed
aggregate, and all of them train the model in numpy on the executors. Products of the trained
matrices give the scores of every word after every context, and so the normaliser of each of
the vocabulary's squared contexts; a token's log-probability is then exact and normalised. A word outside the vocabulary has the
probability of its class times (c + 1) / (sum of c + 1 over such words, and 1 for unseen ones).

Counts c of all words come from a distributed aggregate over 64-bit hashes of the words. The
`hot` most frequent words are known on every executor; the rest are joined by hash, so no
table that grows with the text is gathered or sent around.

Null text is empty: its one token is the end. A null id is never held out. Repeated rows each
count and each give a row. Without training rows N and V are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import _text as T
from siftwell.llm._spark import saved

LEAST, MOST_VOCABULARY, HOT = 512, 2048, 1 << 18
#: Distinct triples that one task learns from, about.
SHARD = 1 << 19
OTHER, END, START = 0, 1, 2
#: The end of a text among word hashes.
END_HASH = np.uint64(0x656E646F66746578)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _counting(each, name: str, most: int = 1 << 21):
    """A mapInArrow function that counts the keys which `each` gives for (bytes, offsets), with partial sums of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            keys, n = _counted(parts)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=[name, "n"])

        for batch in batches:
            for _, data, offsets in T.slices(batch.column(0)):
                parts.append(np.unique(each(data, offsets), return_counts=True))
                waiting += len(parts[-1][0])
                if waiting > most:
                    parts = [_counted(parts)]
                    waiting = len(parts[0][0])
                    if waiting > most // 2:
                        yield out()
                        parts, waiting = [], 0
        if parts:
            yield out()

    return run


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n) for each word hash and the end; texts has the one column text."""

    def each(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.concatenate([T.word_hashes(T.words(data, offsets, T.SPACE_WORD)), np.full(len(offsets) - 1, END_HASH)])

    return texts.mapInArrow(_counting(each, "h"), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The long columns of a result of bounded size, without an object for each row."""
    found = df.toArrow()
    return [np.asarray(found.column(i).to_numpy(), np.int64) for i in range(found.num_columns)]


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The end, and the words of the upper bands of n that hold `most` rows at most; of the band below, the share by hash that fills up. No rows are sorted."""
    band = F.floor(F.log2("n") * 8).cast("int")
    sizes, cut, held, share = dict(tuple(r) for r in counts.groupBy(band).count().collect()), 1 << 20, 0, 0.0
    for b in sorted(sizes, reverse=True):
        if held + sizes[b] > most:
            share = (most - held) / sizes[b]
            break
        held, cut = held + sizes[b], b
    filling = F.lit(False)
    if share:
        below = max((b for b in sizes if b < cut), default=0)
        filling = (band == below) & (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return counts.where((band >= cut) | filling | (F.col("h") == int(END_HASH)))


class Hot:
    """The most frequent words: sorted hashes, their counts, and their ids in the neural vocabulary."""

    def __init__(self, h: np.ndarray, n: np.ndarray, vocabulary: int):
        first = np.lexsort((h, -n))
        h, n = h[first].view(np.uint64), n[first]
        ids = np.full(len(h), OTHER, np.int16)
        plain = np.flatnonzero(h != END_HASH)[: vocabulary - 3]
        ids[plain] = np.arange(len(plain)) + 3
        ids[h == END_HASH] = END
        order = np.argsort(h)
        self.h, self.n, self.ids = h[order], n[order], ids[order]

    def sequence(self, data: np.ndarray, offsets: np.ndarray):
        """Of the words and the end of each row in order: hashes, rows, ids, the two ids before, places in the table, and which are there."""
        w = T.words(data, offsets, T.SPACE_WORD)
        count = np.bincount(w.row, minlength=w.rows)
        last = np.cumsum(count + 1) - 1
        h, row = np.full(len(w.row) + w.rows, END_HASH), np.repeat(np.arange(w.rows), count + 1)
        h[np.arange(len(w.row)) + w.row] = T.word_hashes(w)
        assert len(h) == 0 or last[-1] == len(h) - 1
        at, there = T.find(self.h, h)
        ids = np.where(there, self.ids[at], OTHER).astype(np.int64) if len(self.h) else np.zeros(len(h), np.int64)
        ids[last] = END
        one, two = np.full(len(h), START), np.full(len(h), START)
        if len(h) > 1:
            one[1:] = np.where(row[1:] == row[:-1], ids[:-1], START)
            two[2:] = np.where(row[2:] == row[:-2], ids[:-2], START)
        return h, row, ids, one, two, at, there


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] += rows, where places repeat."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    into[at[first]] += np.add.reduceat(rows[order], first)


def train(triples: DataFrame, vocabulary: int, dim: int = 32, noise: int = 64, epochs: int = 3, batch: int = 1024, seed: int = 3, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores after one before, scores after two before, bias, log normaliser of [two, one]) from all rows of triples(code, n), with codes (two * V + one) * V + word.

    Each epoch passes over every row, whose gradient counts n times. A row above the mean count is cut into pieces of
    that count at most, which at most doubles the rows. They are dealt by hash into shards of about `shard` rows, which
    start from one state and train apart; the mean of their states by counts is the next state.
    """
    v = vocabulary
    most = triples.agg(F.coalesce(F.ceil(F.avg("n")), F.lit(1))).first()[0]
    pieces = F.ceil(F.col("n") / most)
    rows = triples.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0]
    cut = triples.select("code", "n", pieces.alias("of"), F.explode(F.sequence(F.lit(1).cast("long"), pieces)).alias("piece"))
    own = F.floor(F.col("n") * F.col("piece") / F.col("of")) - F.floor(F.col("n") * (F.col("piece") - 1) / F.col("of"))
    dealt = saved(cut.select(F.pmod(F.xxhash64("code", "piece", F.lit(seed)), F.lit(max(1, -(-rows // shard)))).alias("shard"), "code", own.alias("n")))
    word, n = arrays(dealt.groupBy((F.col("code") % v).alias("word")).agg(F.sum("n").alias("n")))
    unigram = np.full(v, 1e-2)
    unigram[word] += n
    unigram[START] = 1e-9
    q = unigram / unigram.sum()
    log_kq, below = np.log(noise * q), np.cumsum(q)
    rng = np.random.RandomState(seed)
    # word vectors, and a matrix for each place of the context; the bias starts at the unigram model
    first = [rng.randn(v, dim) * 0.1, np.eye(dim) * 0.5, np.eye(dim) * 0.2, np.log(q)]
    shapes = [x.shape for x in first] * 2
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    state = np.concatenate([x.ravel() for x in first] + [np.full(x.size, 1e-3) for x in first])

    def parted(flat: np.ndarray) -> list[np.ndarray]:
        return [x.reshape(shape) for x, shape in zip(np.split(flat, ends[:-1]), shapes, strict=True)]

    def learning(state: np.ndarray, epoch: int):
        def learn(found: pa.Table) -> pa.Table:
            number = found.column("shard")[0].as_py()
            codes, weight = (found.column(c).to_numpy() for c in ("code", "n"))
            order = np.lexsort((weight, codes))
            codes, weight = codes[order], weight[order]
            rng = np.random.RandomState([seed, epoch, number])
            order = rng.permutation(len(codes))
            codes, weight = codes[order], weight[order]
            scale = batch * weight.mean()
            two, one, word, weight = codes // (v * v), codes // v % v, codes % v, weight.astype(np.float32)
            own = state.astype(np.float32)
            r, c1, c2, b, *sums = parted(own)
            share = log_kq.astype(np.float32)
            for start in range(0, len(codes), batch):
                t, o, w, n = (x[start : start + batch] for x in (two, one, word, weight))
                sampled = np.searchsorted(below, rng.random_sample(noise) * 0.999999)
                x1, x2, y, z = r[o], r[t], r[w], r[sampled]
                context = x1 @ c1 + x2 @ c2
                data = np.einsum("ij,ij->i", context, y) + b[w] - share[w]
                other = context @ z.T + (b[sampled] - share[sampled])
                # the gradient of log s(data) + sum of log s(-other)
                g_data = n / (1 + np.exp(np.clip(data, -40, 40)))
                g_other = -n[:, None] / (1 + np.exp(np.clip(-other, -40, 40)))
                g_context = g_data[:, None] * y + g_other @ z
                g_r = np.zeros_like(r)
                np.add.at(g_r, sampled, g_other.T @ context)
                _add_rows(g_r, w, g_data[:, None] * context)
                _add_rows(g_r, o, g_context @ c1.T)
                _add_rows(g_r, t, g_context @ c2.T)
                g_b = np.bincount(w, g_data, minlength=v) + np.bincount(sampled, g_other.sum(0), minlength=v)
                for value, total, g in zip((r, c1, c2, b), sums, (g_r, x1.T @ g_context, x2.T @ g_context, g_b.astype(np.float32)), strict=True):
                    g /= scale
                    total += g * g
                    value += 0.3 * g / np.sqrt(total)
            own = own.astype(float)
            weight = weight.astype(float)
            return pa.table({"shard": pa.array([number], pa.int64()), "weight": pa.array([int(weight.sum())], pa.int64()), "state": pa.array([own.tobytes()], pa.binary())})

        return learn

    for epoch in range(epochs if rows else 0):
        learnt = sorted(dealt.groupBy("shard").applyInArrow(learning(state, epoch), "shard long, weight long, state binary").collect())
        mass = sum(x.weight for x in learnt)
        state = sum(np.frombuffer(x.state) * (x.weight / mass) for x in learnt)
    r, c1, c2, b, *_ = parted(state)
    b[START] = -1e9  # never a word
    after_one, after_two = (r @ c1) @ r.T, (r @ c2) @ r.T
    normaliser = np.empty((v, v))
    for t in range(v):
        s = after_one + (after_two[t] + b)
        top = s.max(1)
        normaliser[t] = top + np.log(np.exp(s - top[:, None]).sum(1))
    return after_one, after_two, b, normaliser


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, hot: int = HOT, dim: int = 32, epochs: int = 3, seed: int = 3) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, learning from the rows where `training` holds."""
    texts = docs.where(training).select(F.col(text_col).alias("text"))
    counts = saved(word_counts(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    v = vocabulary or min(MOST_VOCABULARY, max(LEAST, round(2 * total ** (1 / 3))))
    table = Hot(*arrays(most_frequent(counts, hot).select("h", "n")), v)
    # words outside the neural vocabulary share the mass of their class by count + 1, and 1 for unseen ones
    inside = (table.ids != OTHER) | (table.h == END_HASH)
    tail = int(total + distinct - (table.n[inside] + 1).sum()) + 1

    def each(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, _, ids, one, two, _, _ = table.sequence(data, offsets)
        return (two * v + one) * v + ids

    triples = texts.mapInArrow(_counting(each, "code"), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).transform(saved)
    after_one, after_two, bias, normaliser = (x.astype(np.float32) for x in train(triples, v, dim, epochs=epochs, seed=seed))
    log_count = np.log10(table.n + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, data, offsets in T.slices(batch.column(2)):
                h, row, ids, one, two, at, there = table.sequence(data, offsets)
                rows_ = len(offsets) - 1
                log_p = (after_one[one, ids] + after_two[two, ids] + bias[ids] - normaliser[two, one]).astype(float) / np.log(10)
                other = (ids == OTHER) & (h != END_HASH)
                log_p[other] -= np.log10(tail)
                cold = ~there & (h != END_HASH)
                base = np.zeros(len(h))
                if len(table.h):
                    base[there] = log_count[at[there]]
                sums = lambda x: np.bincount(row, x, minlength=rows_)  # noqa: E731, B023
                far_row, far_h = row[cold], h[cold]
                order = np.lexsort((far_h, far_row))
                far_row, far_h = far_row[order], far_h[order]
                fresh = np.flatnonzero(np.concatenate([[True], (far_row[1:] != far_row[:-1]) | (far_h[1:] != far_h[:-1])])) if len(far_h) else np.zeros(0, np.int64)
                k = np.diff(np.append(fresh, len(far_h)))
                at_row = np.concatenate([np.arange(rows_), far_row[fresh]])
                take = pa.array(at_row + low)
                pad = np.zeros(len(k))
                own = batch.column(0).to_numpy()[low : low + rows_]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take),
                    pa.array(np.concatenate([T.mix(own.astype(np.uint64)), far_h[fresh]]).view(np.int64)), pa.array(np.arange(len(at_row)) >= rows_),
                    pa.array(np.concatenate([sums(np.ones(len(h))).astype(np.int64), k])), pa.array(np.concatenate([sums(there & (table.n[at] > 0) if len(table.h) else there).astype(np.int64), pad.astype(np.int64)])),
                    pa.array(np.concatenate([sums(base), pad])), pa.array(np.concatenate([sums(log_p + base * other), pad])),
                ], names=["row", "doc_id", "h", "cold", "n", "known", "base", "log_p"])

    rows_in = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()
    parts = rows_in.mapInArrow(run, f"row long, doc_id {kind}, h long, cold boolean, n long, known long, base double, log_p double")
    # rows of documents have keys of their own, spread, and join with nothing
    joined = parts.join(counts.select(F.col("h").alias("h_"), F.col("n").alias("c")), (F.col("h") == F.col("h_")) & F.col("cold"), "left")
    c = F.coalesce("c", F.lit(0))
    rare = F.when(F.col("cold"), F.col("n") * F.log10(c + 1.0)).otherwise(0.0)
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum(F.when(~F.col("cold"), F.col("n"))).alias("n_tokens"), F.sum(F.col("known") + F.when(F.col("cold") & (c > 0), F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("base") + rare).alias("base"), F.sum(F.col("log_p") + rare).alias("score"))
    log_total = float(np.log10(total + distinct + 1))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * log_total).alias("base_score"), "score")
