"""Edge cases of the other operators, and what they must find."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import _text as T
from siftwell.llm import decontamination, embeddings, lm, resampling, toxicity, warc
from siftwell.llm.queries import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, h long"


@pytest.fixture(scope="module")
def odd(spark):
    long = "stupid idiot " + "word " * 30000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one two"), (None, None), (5, long), (6, "one two three four five six seven")]
    return spark.createDataFrame([(i, t, "en", None, 0, 9, 9) for i, t in rows], SCHEMA)


def test_resampling(spark, odd):
    labels = spark.createDataFrame([(6, 1), (5, 0), (4, None), (None, 1)], "doc_id long, quality int")
    assert resampling.resample(odd, labels, rate=1.0).count() == odd.count()
    assert resampling.resample(odd, labels, rate=0.5).count() == round(odd.count() / 2)
    assert resampling.resample(odd, labels.limit(0)).count() == odd.count()
    assert resampling.resample(odd.limit(0), labels).count() == 0


def buckets_of(text):
    """Hashed unigrams and bigrams, by regular expression and one hash at a time."""
    h = [T.hash_word(w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text or "")]
    two = [int(T.mix(np.array([(a * 3 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
    return [x % resampling.BUCKETS for x in h + two]


@pytest.mark.parametrize("rate", [None, 0.3])
def test_resampling_equals_brute_force(spark, odd, rate):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.where("doc_id % 9 = 0")).unionAll(odd.where("doc_id < 5").select(-F.col("doc_id"), "text"))  # repeated rows tie
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", F.lit(1).alias("u"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(11)).alias("u")).collect()
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for r in rows:
        for b in buckets_of(r.text):
            raw[b] += 1
            target[b] += r.doc_id in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    keyed = []
    for r in rows:
        weight = sum(ratio[b] for b in buckets_of(r.text))
        keyed.append((weight - math.log(-math.log((r.u % (1 << 52) + 0.5) / (1 << 52))), r.doc_id, len(buckets_of(r.text)), weight))
    share = labels.where("quality is not null").agg(F.avg("quality")).first()[0] if rate is None else rate
    want = sorted(keyed, key=lambda x: (-x[0], x[1]))[: round(share * len(rows))]
    got = resampling.resample(docs, labels, rate).collect()
    assert Counter((r.doc_id, r.n_grams) for r in got) == Counter((i, n) for _, i, n, _ in want)
    assert np.allclose(sorted(r.log_weight for r in got), sorted(w for *_, w in want)) and np.allclose(sorted(r.gumbel_key for r in got), sorted(k for k, *_ in want))


def test_embeddings(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(1, a, 0), (2, a, 0), (2, a, 0), (3, [1.0, 0.01, 0.0], 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [0.0] * 3, 0), (8, [float("nan")] * 3, 0), (9, [1.0, None, 0.0], 0), (10, [], 0), (None, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, cls int")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()))
    assert got == [(-1, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1)] + [(i, 0, i) for i in range(4, 11)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (4, 0), (4, 0), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, labels), keep=odd.columns).columns == odd.columns


def hashes(s):
    return np.array([T.hash_word(w) for w in s.split()], np.uint64)


def test_swaps_are_those_of_the_sentence():
    def by_hand(s, kinds):
        # every version of the sentence, as the sets of words that it loses and gains
        words, out = s.split(), []
        for terms in kinds:
            for term in (t for t in terms if f" {t} " in f" {s} "):
                for other in (t for t in terms if t != term):
                    version = f" {s} ".replace(f" {term} ", f" {other} ").split()
                    out.append((frozenset(set(words) - set(version)), frozenset(set(version) - set(words))))
        return Counter(out)

    kinds = [["gay", "straight"], ["trans women", "women", "men"]]
    name = {int(hashes(w)[0]): w for w in "gay straight trans women men are kind".split()}
    for s in ("gay are kind", "kind trans women are kind", "trans are women", "women are men", "gay straight are", "are", ""):
        got = Counter((frozenset(name[int(x)] for x in gone), frozenset(name[int(x)] for x in come)) for gone, come in toxicity.swaps(hashes(s), [[hashes(t) for t in terms] for terms in kinds]))
        assert got == by_hand(s, kinds), s


def test_swaps_lower_the_weight_of_a_group(spark):
    texts = [("gay people are scum", 1), ("gay people are idiots", 1), ("the weather is fine", 0), ("people are fine here", 0), ("scum and idiots", 1), ("bread is here", 0)] * 10
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    gap = []
    for weight in (0.0, 50.0):
        m = toxicity.fit(docs, labels, swap_weight=weight)
        w = {int(h): x for h, x in zip(m.features, m.weights, strict=True)}
        gap.append(abs(w[int(hashes("gay")[0])] - w[int(hashes("straight")[0])]))
    assert gap[1] < gap[0] / 2


def test_toxicity_gradient_equals_differences():
    r = np.random.RandomState(1)
    changes = toxicity.Changes(r.randint(0, 7, 20), r.randint(0, 5, 20), r.choice([-1, 1], 20), r.rand(7))
    w, loss = r.randn(5), lambda w: float((changes.weight * changes.of(w) ** 2).sum())
    for i in range(5):
        e = np.eye(5)[i] * 1e-5
        assert np.isclose(changes.gradient(w)[i], (loss(w + e) - loss(w - e)) / 2e-5, rtol=1e-5)


def test_toxicity_of_held_out_rows_and_neutral_mentions(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out(5, 0)))
    held = docs.where(held_out(5, 0)).join(labels.where("toxic is not null"), "doc_id")
    rows = toxicity.score(held.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows) > 0
    weight = {int(h): w for h, w in zip(model.features, model.weights, strict=True)}
    for r, p in zip(sorted(held.select("doc_id", "text").collect())[:200], sorted((x.doc_id, x.score) for x in rows), strict=False):
        words = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in r.text or "")))
        assert r.doc_id == p[0] and math.isclose(p[1], 1 / (1 + math.exp(-model.bias - sum(weight.get(int(hashes(w)[0]), 0.0) for w in words))), abs_tol=1e-9)
    neutral = [f"{lead} {term} {tail}" for terms in toxicity.IDENTITY.values() for term in terms for lead, tail in [("the", "people of this town met on monday"), ("my", "neighbour baked bread"), ("a report on", "voters was read aloud")]]
    found = toxicity.score(spark.createDataFrame(list(enumerate(neutral)), "doc_id long, text string"), model)
    assert found.where("predicted = 1").count() <= 0.01 * len(neutral)


def test_toxicity_trains_on_labelled_ids_once(spark):
    docs = spark.createDataFrame([(1, "bad words")] * 500 + [(1, "other text")] * 500 + [(i, f"fine day {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    toxicity.train = lambda x, *a, **k: seen.append(x.shape) or train(x, *a, **k)
    try:
        toxicity.fit(docs, labels, most=10)
    finally:
        toxicity.train = train
    assert seen[0][0] == 11


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "x"), (3, None, "x"), (3, "u", "x"), (2, "u", "x"), (5, "u", None), (6, "u", ""), (None, "u", "x"), (7, "u", "é" * 50000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, row int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages_of(warc.read(warc.write(df))).collect())
    d = lambda s: warc.digest_of(s.encode())
    expect = [(1, 1, d("x"), "revisit", 3), (2, 1, d("x"), "revisit", 3), (3, 1, d("x"), "revisit", 3), (3, 1, d("x"), "response", None), (None, 1, d("x"), "revisit", 3), (5, 0, d(""), "revisit", 6), (6, 0, d(""), "response", None), (7, 100000, d("é" * 50000), "response", None)]
    assert got == Counter(expect)
    assert warc.read(warc.write(df.limit(0))).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    import gzip

    parts = [warc.record_bytes(str(i), "u", bytes([65 + i]) * 300, None, False) for i in range(5)]
    parts = [gzip.compress(p) for p in parts] if zipped else parts
    data = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    data[at : at + 4] = b"\xff\xfe\xfd\xfc"
    got = list(warc.salvage(bytes(data) + b"junk"))
    assert [r.record_id for r in got if r.kind == "response"] == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)]
    gaps = [(r.offset, r.length) for r in got if r.kind == "quarantined"]
    assert gaps == [(len(parts[0]), len(parts[1])), (len(data), 4)]


def test_salvage_of_long_headers_and_members_of_several_records():
    import gzip

    raw = [warc.record_bytes(str(i), "http://h/" + "x" * 70_000 * (i == 1), b"p%d" % i, None, False) for i in range(4)]
    old = raw[3].replace(b"WARC/1.1", b"WARC/0.18")
    ids = lambda data: [(r.record_id, r.kind) for r in warc.salvage(data)]
    want = [(f"<urn:page:{i}>", "response") for i in range(4)]
    assert ids(b"".join([*raw[:3], old])) == want
    assert ids(gzip.compress(b"".join(raw[:3])) + gzip.compress(old)) == want
    bad = raw[1][:-6] + b"zz" + raw[1][-4:]
    got = list(warc.salvage(gzip.compress(raw[0] + bad + raw[2]) + gzip.compress(old)))
    assert [(r.record_id, r.kind) for r in got] == [want[0], ("", "quarantined"), want[2], want[3]]
    assert got[1].note.endswith(f"bytes {len(raw[0])} to {len(raw[0] + bad)} of the member's content")
    # damage that spans records
    data = b"".join(raw)
    hit = len(raw[0]) + 10
    data = data[:hit] + b"\0" * (len(raw[1]) + 20) + data[hit + len(raw[1]) + 20 :]
    assert ids(data) == [want[0], ("", "quarantined"), want[3]]


def test_lm(spark, odd):
    got = lm.score(odd, F.coalesce(F.col("doc_id") != 6, F.lit(True)), vocabulary=8, hot=2, epochs=1).collect()
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "") + [""]) for r in odd.collect()]
    c = Counter(w for i, ws in rows if i != 6 for w in ws)
    n, v = sum(c.values()), len(c)
    expect = Counter((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expect
    assert all(r.score < 0 for r in got)
    assert lm.score(odd, F.lit(False), vocabulary=8).count() == odd.count()
    assert lm.score(odd.limit(0), F.lit(True), vocabulary=8).count() == 0


@pytest.mark.parametrize("hot", [0, 1, 2, 3, 100])
def test_lm_base_columns_with_any_hot_table(spark, hot):
    docs = spark.createDataFrame([(1, "a b c d"), (6, "a b")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in lm.score(docs, F.col("doc_id") == 1, vocabulary=8, hot=hot, epochs=1).collect()}
    assert got == {i: (n, n, 5, round(n * math.log10(2 / 11), 9)) for i, n in ((1, 5), (6, 3))}


def test_lm_probabilities_sum_to_one(spark):
    """Each context's probabilities add up to one, and a text's score is the sum of its tokens' logarithms, by hand."""
    train = ["a b c a b", "b a c", "c c a b d e"] * 5
    words = "a b c d e".split()
    context = ["a", "b"]
    texts = train + [" ".join(context)] + [" ".join([*context, w, x]) for w in [*words, "unseen"] for x in [*words, "unseen"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # vocabulary 6: a, b and c have vectors, d, e and unseen words share a class
    got = {r.doc_id: 10**r.score for r in lm.score(docs, F.col("doc_id") < len(train), vocabulary=6, epochs=2).collect()}
    assert len(got) == len(texts) and all(0 < p < 1 for p in got.values())
    tables = {}
    real = lm.train
    lm.train = lambda *a, **k: tables.setdefault("t", real(*a, **k))
    try:
        rows = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < len(train), vocabulary=6, epochs=2).collect()}
    finally:
        lm.train = real
    one, two, bias, norm = tables["t"]
    p = lambda t, o: np.exp(one[o] + two[t] + bias - norm[t, o])
    assert all(np.isclose(p(t, o).sum(), 1) for t in range(6) for o in range(6))
    c = Counter(w for t in train for w in t.split())
    order = sorted(c, key=lambda w: (-c[w], T.hash_word(w) - (1 << 64) * (T.hash_word(w) >> 63)))
    ids = {w: 3 + i for i, w in enumerate(order[:3])}
    tail = sum(c[w] + 1 for w in c if w not in ids) + 1
    for i, text in enumerate(texts):
        seq, total, t, o = text.split(), 0.0, lm.START, lm.START
        for w in [*seq, None]:
            x = lm.END if w is None else ids.get(w, lm.OTHER)
            total += math.log10(p(t, o)[x]) + (math.log10((c[w] + 1) / tail) if x == lm.OTHER else 0)
            t, o = o, x
        assert math.isclose(rows[i], total, abs_tol=1e-4), text


def test_lm_learns_from_all_triples(spark):
    v = 8
    heavy = [(3 * v + 4) * v + 5, (4 * v + 5) * v + 3]
    rows = [(c, 3_000_000) for c in heavy] + [((a * v + b) * v + 6, 1) for a in range(3, 7) for b in range(3, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "code long, n long")
    after_one, after_two, bias, normaliser = found = lm.train(frame(rows), v, dim=4, epochs=8, shard=5)
    s = after_one[4] + after_two[3] + bias
    assert np.isclose(normaliser[3, 4], np.log(np.exp(s).sum()))
    again, less = lm.train(frame(rows[::-1]).repartition(3), v, dim=4, epochs=8, shard=5), lm.train(frame(rows[:-1]), v, dim=4, epochs=8, shard=5)
    assert all(np.allclose(a, b) for a, b in zip(found, again, strict=True))
    assert not np.allclose(found[0], less[0])  # one count of six million tells


def contained_by_brute_force(docs, items):
    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = []
    for i, t in items:
        own = grams(w, n) if (n := min(5, len(w := words(t)))) else set()
        for d, text in docs:
            if own and len(both := own & grams(words(text), n)) >= 0.8 * len(own):
                out.append((d, i, len(both), len(own)))
    return Counter(out)


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "one two three four five six seven", 9), (1, "ONE, two three four five", 9), (2, None, 9), (3, "one", 9), (4, "Two three", 9), (4, "Two three", 9), (None, "zz yy xx ww vv", 9), (5, "what is seven times", 9)], "item_id long, text string, item int")
    more = spark.createDataFrame([(7, "so what is seven times eight, one asks"), (8, "what is times seven")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionAll(more)
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontamination.contained(docs, items).collect())
    assert got == contained_by_brute_force([tuple(r) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got[7, 5, 1, 1] == 1 and got[6, 4, 1, 1] == 2 and got[6, 3, 1, 1] == 1
    assert decontamination.contained(odd, items.limit(0)).count() == 0 and decontamination.contained(odd.limit(0), items).count() == 0


def test_decontamination_of_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontamination.contained(docs, items).collect())
    assert got == contained_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) and got


def test_decontamination_joins_by_shuffle_too(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    test_decontamination(spark, odd)


def embeddings_by_brute_force(rows, least=0.98):
    """(vec_id, n_links, component_id) of rows (vec_id, vector, label)."""
    fine = [i for i, (_, v, y) in enumerate(rows) if v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / max(map(abs, rows[i][1])) for i in fine}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = [set() for _ in rows]
    by = {}
    for i in fine:
        by.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for group in by.values():
        x = np.array([unit[i] for i in group])
        for k, i in enumerate(group):
            linked[i] = {group[j] for j in np.flatnonzero((x @ x[k] >= least) | (np.abs(x - x[k]).max(1) < 1e-15))} - {i}
    least_id = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(linked):
            best = min([least_id[j] for j in near if least_id[j] is not None] + [least_id[i]] * (least_id[i] is not None), default=None)
            if best != least_id[i]:
                least_id[i], changed = best, True
    return Counter((r[0], len(n), m) for r, n, m in zip(rows, linked, least_id, strict=True))


def near_groups(seed=3, n=40, dim=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n, dim))
    x = np.repeat(centres, 10, axis=0) + r.normal(size=(10 * n, dim)) * r.choice([0.01, 0.05, 0.1, 0.5], size=(10 * n, 1))
    x[100:200] = x[100] + r.normal(size=(100, dim)) * 0.02  # one large group
    walk = np.cumsum(r.normal(size=(60, dim)) * 0.04, axis=0) + r.normal(size=dim)  # a chain of links
    return np.concatenate([x, walk, x[:20]])


def test_embeddings_of_odd_vectors(spark):
    huge = [[1e200, 1e199], [2e200, 2e199], [1e-200, 1e-201], [1e308, -1e308], [5e-324, 0.0], [1.0, 0.1], [1.0, 0.1, 0.0], [1.0] * 3000, [1.0] * 2999 + [1.001]]
    rows = [(i, v, "x") for i, v in enumerate(huge)] + [(90, huge[0], "y"), (None, huge[0], "x"), (90, huge[0], "y")]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label string, shard int")).collect())
    assert got == embeddings_by_brute_force(rows)
    assert got[0, 5, 0] == 1 and got[90, 1, 90] == 2 and got[7, 1, 7] == 1


@pytest.mark.parametrize("shard, most_pivots", [(40, 4096), (30, 4)])
def test_embeddings_across_shards_equal_brute_force(spark, shard, most_pivots):
    """Shards of one level, and of several levels with four pivots each."""
    x = near_groups()
    rows = [(int(i), [float(v) for v in x[i]], int(i % 7 == 0)) for i in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = df.select(F.col("vec_id").alias("cls"), "label", F.size("embedding").alias("dim"), F.col("embedding").alias("unit"), F.lit(1).cast("long").alias("size"))
    cells = embeddings.shards(classes, 3, shard, 1, most_pivots)
    assert cells.select("cls").distinct().count() == len(x) and cells.select("label", "shard").distinct().count() > 10
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, shard=shard, most_pivots=most_pivots, recall=0.999).collect())
    want = embeddings_by_brute_force(rows)
    assert got == want


def test_embeddings_raise_below_the_recall(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "audit", lambda *a: (1, 100))
    with pytest.raises(RuntimeError, match="1 of 100"):
        embeddings.near_duplicates(spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<double>, label int"))


def test_graph_search_equals_brute_force():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    x = np.repeat(centres, 10, axis=0) + r.normal(size=(400, 16)) * r.choice([0.01, 0.1, 0.5], size=(400, 1))
    x[100:200] = x[100] + r.normal(size=(100, 16)) * 0.01  # one large group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, _ = embeddings.build(x.astype(np.float32))
    rows = pa.table({"cls": np.arange(400) * 7, "unit": list(x), "links": [a[a >= 0].astype(np.int64) * 7 for a in graph], "shard": np.full(400, 2), "member": np.full(400, True), "shards": [[2]] * 200 + [[2, 0]] * 200, "guests": [None] * 100 + [[0]] * 100 + [[]] * 200, "size": r.integers(1, 4, 400)})
    true = x @ x.T >= 0.98
    np.fill_diagonal(true, False)
    # pairs that can meet in shard 0 count there
    counted = true.copy()
    counted[200:, 100:] = counted[100:, 200:] = False
    got = embeddings._shard(rows.take(pa.array(r.permutation(400))), 0.98)
    got = got.sort_by("cls")
    assert got["cls"].to_pylist() == (np.arange(400) * 7).tolist()
    assert got["n"].to_pylist() == (counted @ rows["size"].to_numpy()).tolist() and got["m"].to_pylist() == counted.sum(1).tolist()
    least = np.arange(400)
    for _ in range(400):
        least = np.minimum(least, np.where(true, least[None, :], 400).min(1))
    assert got["head"].to_pylist() == (least * 7).tolist()
    one = embeddings._shard(rows.slice(0, 1), 0.98)
    assert one["n"].to_pylist() == [0] and one["head"].to_pylist() == [0]
