"""Functions, sources, controls, statistics and arms against literal values and plain Python."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell import catalog
from siftwell.functions import text as T
from siftwell.operators import evaluation as E
from siftwell.operators import extraction as X
from siftwell.operators import graph as G
from siftwell.operators import pool as P
from siftwell.operators import matching as M
from siftwell.operators import retrieval as R
from siftwell.operators import stats as B
from siftwell.plans import lineage, runner
from siftwell.sources import files


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """(docs, queries, qrels): d4 is empty, q3 has no terms, q4 matches nothing."""
    docs = [("d1", "the cat sat on the mat"), ("d2", "cat cat dog"), ("d3", "a dog and a bird"), ("d4", ""), ("d5", None)]
    queries = [("q1", "the cat"), ("q2", "dog bird"), ("q3", "!!"), ("q4", "zebra")]
    qrels = [("q1", "d1", 1), ("q1", "d2", 2), ("q2", "d3", 1), ("q4", "d1", 1)]
    return spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(qrels, "query_id string, doc_id string, rel int")


# text


def test_stop_words_are_the_frozen_list():
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 37 and {"how", "why", "its", "i", "from"} < set(T.STOPWORDS) and not {"but", "if", "not", "into"} & set(T.STOPWORDS)


@pytest.mark.parametrize("text, expected", [("How is the cat in a hat?", ["cat", "hat"]), ("but if not they", ["but", "if", "not", "they"]), ("Cat cat DOG cat", ["cat", "dog"]), ("who what why", []), (None, [])])
def test_query_terms(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(T.query_terms(F.col("t"))).first()[0] == expected


def test_whole_words_equal_bounded_matches(spark):
    texts = ["foo foo_bar fooé foo-foo", "istanbul Istanbul", "Kelvin kelvin KELVIN", "ſun sun Sun", "née nee", "a1 a1b 1a1", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for term in ("foo", "istanbul", "sun", "kelvin", "nee", "a1", "1a1", "e", "k"):
        got = rows.select("i", F.size(F.filter(T.unicode_words(F.col("t")), lambda w: w == term)).cast("int"), F.coalesce(T.bounded_count(F.col("t"), term), F.lit(0))).collect()
        assert all(a == b for _, a, b in got), (term, got)
    dotted = spark.createDataFrame([("İstanbul istanbul",)], "t string").select(T.unicode_words(F.col("t"))).first()[0]
    assert dotted.count("istanbul") == 1


@pytest.mark.parametrize("column, value, expected", [(T.squeeze, " a \t b\n", "a b"), (T.strip, "  a b\n", "a b"), (T.node, "The  U.S. (Army)", "the u s army"), (T.without_disambiguator, "Mercury (planet) ", "Mercury"), (T.comma_list, " a, b,,a ,C", ["a", "b", "C"]), (T.minted_id, 7, "doc-000007"), (lambda c: T.prefixed(c, "query: "), "x", "query: x"), (lambda c: T.prefixed(c, None), "x", "x"), (lambda c: T.digest(c.cast("binary")), "a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb")])
def test_text_functions(spark, column, value, expected):
    assert spark.createDataFrame([(value,)], "v long" if isinstance(value, int) else "v string").select(column(F.col("v"))).first()[0] == expected


# sources


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(r) for r in [{"_id": "1", "title": "T ", "text": " x y"}, {"_id": "2", "title": "", "text": "z"}, {"_id": "3", "text": "cats only here"}]))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps(r) for r in [{"_id": "a", "text": "x y"}, {"_id": "b", "text": "cats"}, {"_id": "c", "text": "unjudged"}]))
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t1\na\t2\t0\nb\t3\t2\n")
    return tmp_path


def test_load(spark, folder):
    docs, queries, qrels = files.load(spark, str(folder))
    assert values(docs) == [("1", "T x y", "T"), ("2", "z", ""), ("3", "cats only here", "")] or values(docs, "doc_id", "text") == [("1", "T x y"), ("2", "z"), ("3", "cats only here")]
    assert values(queries) == [("a", "x y"), ("b", "cats")] and values(qrels) == [("a", "1", 1), ("b", "3", 2)]


def test_nested_sources(spark, tmp_path):
    spark.createDataFrame([("q", {"title": ["A", "B"], "sentences": [["s"], []]})], "id string, context struct<title: array<string>, sentences: array<array<string>>>").write.parquet(f"{tmp_path}/n")
    assert values(files.context(spark, f"{tmp_path}/n")) == [("q", 0, "A"), ("q", 1, "B")]
    rows = [("q", "w?", "t", '[["A", 0], ["B", 1], ["A", 2]]', '[["A", ["s1", "s2"]], ["C", []]]'), ("r", "w?", "t", '[["A", 0]]', "[]")]
    spark.createDataFrame(rows, "id string, question string, type string, supporting_facts string, context string").write.parquet(f"{tmp_path}/j")
    got = files.json_rows(spark, f"{tmp_path}/j").collect()
    assert [r.id for r in got] == ["q"] and got[0].gold == ["A", "B"] and got[0].context[0].title == "A" and got[0].context[0].sentences == ["s1", "s2"]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_bytes(b"one")
    before = spark.createDataFrame(files.fingerprints(spark, f"{tmp_path}/f").collect())
    files.check_manifest(files.fingerprints(spark, f"{tmp_path}/f"), before)
    (tmp_path / "f" / "x").write_bytes(b"two")
    with pytest.raises(ValueError, match="x has changed"):
        files.check_manifest(files.fingerprints(spark, f"{tmp_path}/f"), before)


def test_run_round_trip_and_rescore(spark, corpus, tmp_path):
    docs, queries, qrels = corpus
    qrels = qrels.withColumn("rel", F.lit(1))  # the artifact holds no grades
    scores, summary = runner.run_arm(R.lexical_arm(), docs, queries, qrels, 10, f"{tmp_path}/out", about={"arm": "bm25"})
    assert summary["queries"] == 3 and summary["arm"] == "bm25" and summary["retrieved_nothing"] == 1
    run = files.read_run(spark, f"{tmp_path}/out/per_query")
    direct = R.lexical(R.Index(docs), queries, 10)
    assert values(run, "query_id", "doc_id", "rank") == values(direct, "query_id", "doc_id", "rank")
    again = runner.rescore(spark, f"{tmp_path}/out/per_query")
    assert all(math.isclose(again[m]["mean"], summary[m], abs_tol=1e-6) and again[m]["low"] <= again[m]["mean"] <= again[m]["high"] for m in again)
    stored = json.loads(next(iter((tmp_path / "out" / "summary").glob("part*"))).read_text())
    assert stored == json.loads(json.dumps(summary))
    # a control that fails leaves nothing behind
    with pytest.raises(E.ControlFailed):
        runner.run_arm(R.lexical_arm(), docs, queries, qrels, 10, f"{tmp_path}/not", after=lambda s: E.within("recall", 0.1, 0.5, 1))
    assert not (tmp_path / "not").exists()
    with pytest.raises(ValueError):
        runner.run_arm(R.lexical_arm(), docs, queries, qrels, 9)


def test_command_line(spark, folder, tmp_path, capsys):
    for arm in ("bm25", "coordination", "hybrid", "lexical-none", "anchor"):
        summary = runner.main(["--folder", str(folder), "--arm", arm, "--top-k", "10", "--out", f"{tmp_path}/{arm}"])
        assert summary["ndcg_10"] == 1.0 and summary["arm"] == arm
    assert runner.main(["--folder", str(folder), "--queries", "1"])["queries"] == 1


def test_cache_and_rewrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i long, t string")
    assert values(files.cached(df, str(tmp_path), "k")) == [(1, "a")]
    assert values(files.cached(df.where("i > 5"), str(tmp_path), "k")) == [(1, "a")]
    with pytest.raises(ValueError, match="not"):
        files.cached(df.select("i"), str(tmp_path), "k")
    key = files.corpus_fingerprint(df.select(F.col("i").alias("doc_id"), F.col("t").alias("text")))
    assert key != files.corpus_fingerprint(df.select(F.col("i").alias("doc_id"), F.lit("b").alias("text")))
    for n in (1, 2):
        files.write_rows(spark.range(n), f"{tmp_path}/rows")
        assert spark.read.json(f"{tmp_path}/rows").count() == n


def test_environment(spark, tmp_path):
    about = runner.environment(spark, str(tmp_path))
    assert about["spark"] == spark.version and about["commit"] is None


# lineage


def test_positions_and_running(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("v"), "id").repartition(7)
    rows = sorted((r.v, r.id) for r in df.collect())
    got = {(r.v, r.id): (r.place, r.total, r.running) for r in lineage.running(lineage.positions(df, "v", "id", total="total"), "v", "id", value="v").collect()}
    total = 0
    for i, (v, n) in enumerate(rows):
        total += v
        assert got[v, n] == (i, 1000, total)
    top = {r.id: r.running for r in lineage.running(df, "id", value="v", how="max").collect()}
    assert all(top[i] == max(n * 37 % 101 for n in range(i + 1)) for i in range(0, 1000, 97))
    assert lineage.positions(df.limit(0), "v", total="t").count() == 0 and lineage.running(df.limit(0), "v", value="v").count() == 0


# retrieval


def bm25(docs, query, k1=1.2, b=0.75):
    words = {i: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for i, t in docs}
    average = sum(map(len, words.values())) / len(words)
    out = {}
    for i, ws in words.items():
        for t in sorted(set(re.split("[^a-z0-9]+", query.lower())) - {""}):
            df = sum(t in x for x in words.values())
            if tf := ws.count(t):
                out[i] = out.get(i, 0) + math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / average))
    return out


def test_bm25_equals_a_full_scan_stored_or_not(spark, corpus, tmp_path):
    docs, queries, _ = corpus
    rows = [tuple(r) for r in docs.collect()]
    want = {(q.query_id, d): s for q in queries.collect() for d, s in bm25(rows, q.text).items()}
    for index in (R.Index(docs), R.Index(docs).store(f"{tmp_path}/index"), R.Index.load(spark, f"{tmp_path}/index")):
        got = {(r.query_id, r.doc_id): r.score for r in R.lexical(index, queries, 10).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_substring_counts(spark):
    texts = ["banana bandana", "an a n", "ANANAS é an", "", None, "x1y1x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([("q", "an ana banana b 1x zzz xyz n"), ("r", "q")], "query_id string, text string")
    terms = [t for t in "an ana banana b 1x zzz xyz n".split() if t not in T.STOPWORDS]
    want = []
    for i, t in enumerate(texts):
        counts = [c for c in ((t or "").lower().count(w) for w in terms) if c]
        if counts:
            want.append((i, len(counts), sum(counts)))
    assert values(R.coordination_hits(docs, queries, bounded=False), "doc_id", "matched", "total") == want


def test_contained_runs(spark):
    docs = spark.createDataFrame([(1, "One two three, four five six"), (2, "two three"), (3, "three four one two"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("a", "two three four five"), ("b", "two THREE"), ("c", "one two"), ("d", "six"), ("e", ""), ("f", "one two three four five six seven"), ("g", "two three four five six")], "query_id string, text string")
    assert values(R.contained_runs(docs, queries)) == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 3), ("d", 1), ("g", 1)]
    assert R.contained_runs(docs, queries.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3, 50])
def test_dense_equals_brute_force(spark, k):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 8)).round(1)
    x[5] = x[6] = x[7]
    rows = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(90, None), (91, [1.0]), (92, [float("nan")] * 8), (93, [None] * 8), (94, [0.0] * 8), (95, [])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    queries = df.where("doc_id < 12 or doc_id >= 90").withColumnRenamed("doc_id", "query_id")
    got = {(g.query_id, g.rank): g.doc_id for g in R.dense(df, queries, k, most_bytes=200).collect()}
    fine = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if i < 40 or i in (91, 94)}
    for q in [*range(12), 91, 94]:
        near = sorted((round(-float(fine[q] @ v), 9), i) for i, v in fine.items() if len(v) == len(fine[q]))[:k]
        assert [got.get((q, n + 1)) for n in range(len(near))] == [i for _, i in near]
    assert {q for q, _ in got} == {*range(12), 91, 94}


def test_encoded_arms(spark, corpus, tmp_path):
    docs, queries, _ = corpus
    encoder = R.HashedWords(32, prefix=None)
    arm = R.dense_arm(encoder, cache=str(tmp_path))
    first = values(arm(docs, queries, 3))
    assert first == values(arm(docs, queries, 3)) and len(list(tmp_path.iterdir())) == 1
    own = R.dense_arm(encoder)(docs, docs.select(F.col("doc_id").alias("query_id"), "text").where("text <> ''"), 1)
    assert E.self_retrieval(own) == 1.0
    with pytest.raises(ValueError, match="8 dimensions"):
        R.checked(encoder.documents(docs), 8)
    mixed = R.dense_arm(encoder, shuffle=3)(docs, queries, 5)
    assert values(mixed) != values(R.dense_arm(encoder)(docs, queries, 5))
    # the prefix changes queries only
    prefixed = R.HashedWords(32, prefix="query ")
    assert values(prefixed.documents(docs)) == values(encoder.documents(docs)) and values(prefixed.queries(queries)) != values(encoder.queries(queries))


def test_hybrid_asks_for_candidates_and_fuses(spark):
    asked = []

    def arm(order):
        def run(docs, queries, k):
            asked.append(k)
            return spark.createDataFrame([("q", d, 1.0, i + 1) for i, d in enumerate(order[:k])], "query_id string, doc_id string, score double, rank int")

        return run

    got = R.hybrid_arm(arm("abc"), arm("cbx"))(None, None, 2).orderBy("rank").collect()
    assert asked == [100, 100] and [r.doc_id for r in got] == ["c", "b"]
    assert math.isclose(got[0].score, 1 / 63 + 1 / 61) and math.isclose(got[1].score, 2 / 62)
    assert [R.cell_name(m) for m in R.LADDER] == ["none", "idf", "idf+tf_saturation", "idf+tf_saturation+length_norm"]


def test_anchor_ignores_stop_words(spark, corpus):
    docs, queries, _ = corpus
    kept = lambda t: " ".join(w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w and w not in T.STOPWORDS)
    want = {(q.query_id, d): s for q in queries.collect() for d, s in bm25([(r.doc_id, kept(r.text)) for r in docs.collect()], kept(q.text)).items()}
    got = {(r.query_id, r.doc_id): r.score for r in R.anchor(docs, queries, 10).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


# graph


def solved(edges, seeds, damping):
    """Masses by a dense linear solve."""
    docs, nodes = (sorted({e[i] for e in edges}) for i in (0, 1))
    inc = np.zeros((len(docs), len(nodes)))
    for d, n in edges:
        inc[docs.index(d), nodes.index(n)] = 1
    a = inc.T @ inc
    np.fill_diagonal(a, 0)
    restart = np.array([seeds.get(n, 0.0) for n in nodes])
    degree = a.sum(1)
    step = np.array([row / s if s else restart for row, s in zip(a, degree, strict=True)])
    return dict(zip(nodes, np.linalg.solve(np.eye(len(nodes)) - (1 - damping) * step.T, damping * restart), strict=True))


@pytest.mark.parametrize("damping", [0.15, 0.5])
@pytest.mark.parametrize("most_edges", [1000, 0])
def test_pagerank_equals_a_linear_solve(spark, damping, most_edges):
    edges = [("d1", "a"), ("d1", "b"), ("d2", "b"), ("d2", "c"), ("d2", "hub"), ("d3", "hub"), ("d3", "e"), ("d4", "alone"), ("d5", "hub"), ("d5", "a")]
    inc = spark.createDataFrame(edges, "doc_id string, node string")
    masses = {"q1": {"a": 0.75, "alone": 0.25}, "q2": {"hub": 1.0}, "q3": {"alone": 1.0}}
    seed = spark.createDataFrame([(q, n, m) for q, s in masses.items() for n, m in s.items()], "query_id string, node string, mass double")
    rounds = 200 if damping < 0.5 else 50
    tolerance = 1e-10 if most_edges else 1e-5  # the joined walk takes a job a step
    got = {(r.query_id, r.node): r.mass for r in G.pagerank(inc, G.nodes(inc), seed, damping, rounds, tolerance, most_edges).collect()}
    for q, s in masses.items():
        want = solved(edges, s, damping)
        assert all(math.isclose(got.get((q, n), 0.0), m, abs_tol=1e-8 if most_edges else 1e-4) for n, m in want.items())
    for mean in (False, True):
        ranked = G.retrieve(inc, seed, 3, mean, damping, rounds, tolerance, most_edges).where("query_id = 'q1'").orderBy("rank").collect()
        want = solved(edges, masses["q1"], damping)
        by = {d: [n for x, n in edges if x == d] for d in {d for d, _ in edges}}
        score = {d: sum(want[n] for n in ns) / (len(ns) if mean else 1) for d, ns in by.items()}
        assert [r.doc_id for r in ranked] == sorted(score, key=lambda d: (-round(score[d], 9), d))[:3]


def test_seeds_and_labels(spark):
    kept = G.incidence(spark.createDataFrame([("d", "The U.S.", "GPE"), ("d", "the u s", "ORG"), ("d", "1999", "DATE"), ("d", "--", "ORG")], "doc_id string, surface string, label string"))
    assert values(kept) == [("d", "the u s")]
    inc = spark.createDataFrame([("d1", "x"), ("d2", "x"), ("d2", "y")], "doc_id string, node string")
    named = spark.createDataFrame([("q", "x"), ("q", "x"), ("q", "y"), ("q", "no")], "query_id string, node string")
    assert values(G.seeds(named, G.nodes(inc))) == [("q", "x", 1 / 3), ("q", "y", 2 / 3)] and values(G.seeds(named, G.nodes(inc), False)) == [("q", "x", 0.5), ("q", "y", 0.5)]


def test_graph_arm_refuses_another_corpus(spark, corpus):
    docs, queries, _ = corpus
    long = docs.withColumn("text", F.regexp_replace("text", "cat", "category"))
    ask = spark.createDataFrame([("q1", "the category")], "query_id string, text string")
    assert values(runner.graph_arm(indexed=long)(long, ask, 5), "doc_id") == [("d1",), ("d2",)]
    with pytest.raises(E.ControlFailed):
        runner.graph_arm(indexed=long.limit(2))(long, ask, 5)


def test_reachability_equals_plain_draws(spark):
    r = random.Random(2)
    ents = {f"d{i:02}": {f"n{r.randrange(12)}" for _ in range(3)} for i in range(30)}
    gold = [(f"d{i:02}", f"d{i + 1:02}") for i in range(0, 20, 2)] + [("d00", "none")]
    inc = spark.createDataFrame([(d, n) for d, ns in ents.items() for n in ns], "doc_id string, node string")
    got = G.reachability(inc, spark.createDataFrame(gold, "a string, b string"), rounds=100).first()
    rng, docs = random.Random(20260820), sorted(ents)
    pairs = [p for p in gold if p[1] in ents]
    draws = []
    for _ in range(100):
        draws.append(sum(bool(ents[a] & ents[b]) for a, b in (rng.sample(docs, 2) for _ in pairs)) / len(pairs))
    draws.sort()
    observed = sum(bool(ents[a] & ents[b]) for a, b in pairs) / len(pairs)
    want = (10, observed, draws[99 - 5], float(np.median(draws)), observed > draws[94])
    assert got[0] == 10 and np.allclose(got[1:4], want[1:4]) and got[4] == want[4]


# extraction and pools


def test_extraction_and_annotation(spark, corpus, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"alphabet number{i} tiny") for i in range(9)], "doc_id string, text string")
    found = X.mentions(docs, X.LongTokens(), str(tmp_path))
    assert found.count() == 18 and values(X.mentions(docs, X.LongTokens(), str(tmp_path))) == values(found)
    sample = X.template(docs, 4)
    order = random.Random(20260820).sample([f"d{i}" for i in range(9)], 4)
    assert [r.doc_id for r in sample.orderBy("index").collect()] == order and values(X.progress(sample)) == [(4, 0)]
    with pytest.raises(E.ControlFailed, match="4 passages"):
        E.all_annotated(sample)
    files.write_rows(X.annotated(sample, order[0], " Ann, Bob,,Ann"), f"{tmp_path}/sample")
    again = spark.read.json(f"{tmp_path}/sample")
    assert X.next_passage(again).first().doc_id == order[1] and again.where(F.col("doc_id") == order[0]).first().entities == ["Ann", "Bob"]
    E.all_annotated(again.where("annotated"))


def test_pools(spark):
    titles = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "B"), ("4", "")], "doc_id string, title string")
    slots = spark.createDataFrame([("q", 0, "A"), ("q", 1, "Z"), ("r", 0, "A")], "question_id string, slot int, title string")
    assert values(P.resolve(slots, titles), "doc_id", "title") == [("1", "A")]
    with pytest.raises(ValueError, match="names 2"):
        P.resolve(slots.unionAll(spark.createDataFrame([("r", 1, "B")], slots.schema)), titles)
    counts = P.counts(slots, titles)
    with pytest.raises(E.ControlFailed):
        E.pool_controls(counts, titles.where("title = 'A'"), {"n_slots": 3})
    fine = slots.where("title = 'A'")
    E.pool_controls(P.counts(fine, titles), titles.where("title = 'A'"), {"n_slots": 2, "n_titles": 1})
    with pytest.raises(E.ControlFailed, match="two documents"):
        E.pool_controls(P.counts(fine, titles), titles, {"n_slots": 2})


# controls


def test_controls_raise(spark, corpus):
    docs, queries, qrels = corpus
    run = spark.createDataFrame([("q1", "d1", 2.0, 1), ("q1", "d2", 2.0, 2)], "query_id string, doc_id string, score double, rank int")
    E.gold_present(qrels, docs), E.one_row_each(docs), E.strict_order(R.strictly_decreasing(run)), E.no_terms_no_rows(run, queries)
    E.same_corpus(docs, docs), E.shuffled(0.15), E.closure(0.6, 0.5), E.set_recall_covers(0.5, 0.5 + 1e-10), E.partition_of_labels({"a", "b"}, {"a"}, {"b"})
    E.frozen_counts({"a": 1, "b": 9}, {"a": 1})
    classes = spark.createDataFrame([("q1", 0), ("q2", 2)], "query_id string, cls int")
    E.coverage_controls(classes, classes.withColumn("cls", F.lit(2)), {0: 1, 1: 0, 2: 1}, 1)
    ranked = spark.createDataFrame([("d1", "d1", 1), ("d2", "d1", 1)], "query_id string, doc_id string, rank int")
    bad = [
        lambda: E.gold_present(qrels, docs.where("doc_id <> 'd3'")),
        lambda: E.one_row_each(docs.unionAll(docs.limit(1))),
        lambda: E.strict_order(run),
        lambda: E.no_terms_no_rows(run.withColumn("query_id", F.lit("q3")), queries),
        lambda: E.same_corpus(docs, docs.where("doc_id <> 'd1'")),
        lambda: E.shuffled(0.16),
        lambda: E.closure(0.61, 0.5),
        lambda: E.set_recall_covers(0.4, 0.5),
        lambda: E.partition_of_labels({"a", "b"}, {"a"}),
        lambda: E.partition_of_labels({"a", "b"}, {"a", "b"}, {"b"}),
        lambda: E.frozen_counts({"a": 2}, {"a": 1}),
        lambda: E.coverage_controls(classes, classes, {0: 1, 1: 0, 2: 1}, 1),
        lambda: E.coverage_controls(classes, classes, {0: 2, 1: 0, 2: 0}, 0),
        lambda: E.self_retrieval(ranked),
        lambda: E.subset_closure(spark.createDataFrame([(0.5, 0.722)], "recall_2 double, recall_5 double")),
        lambda: E.clean_tree(" M file"),
    ]
    for control in bad:
        with pytest.raises(E.ControlFailed):
            control()
    assert E.clean_tree(" M file", allow=True) == {"clean": False, "allowed": True} and E.clean_tree("") == {"clean": True, "allowed": False}
    assert E.subset_closure(spark.createDataFrame([(0.55, 0.75)], "recall_2 double, recall_5 double"))["recall_2"] == 0.55


# evaluation


def test_metrics_by_hand(spark, corpus):
    _, queries, qrels = corpus
    run = spark.createDataFrame([("q1", "d1", 1), ("q1", "x", 2), ("q1", "d2", 3), ("q2", "x", 1)], "query_id string, doc_id string, rank int")
    got = {r.query_id: (r.ndcg_10, r.recall_2) for r in E.metrics(queries, run, qrels, (10,), (2,)).collect()}
    ideal = 2 + 1 / math.log2(3)
    assert math.isclose(got["q1"][0], (1 + 2 / 2) / ideal) and got["q1"][1] == 0.5 and got["q2"] == (0.0, 0.0) and got["q4"] == (0.0, 0.0) and "q3" not in got


def test_arms_side_by_side(spark):
    rows = [("c", "x", "q1", 0.5), ("c", "x", "q2", 1.0), ("c", "y", "q1", 0.25), ("d", "y", "q1", 1.0)]
    scores = spark.createDataFrame(rows, "corpus string, arm string, query_id string, ndcg_10 double")
    assert {r.corpus: (r.x_ndcg_10, r.y_ndcg_10) for r in E.across_arms(scores, ["ndcg_10"]).collect()} == {"c": (0.75, 0.25), "d": (None, 1.0)}
    assert E.better(scores.where("corpus = 'c'"), "ndcg_10") == "x"
    arm = lambda a: scores.where((F.col("arm") == a) & (F.col("corpus") == "c")).select("query_id", F.col("ndcg_10").alias("value"))
    with pytest.raises(ValueError, match="same queries"):
        E.paired(arm("x"), arm("y"))
    assert values(E.paired(arm("x"), arm("x"))) == [("q1", 0.5, 0.5), ("q2", 1.0, 1.0)]
    bins = values(E.quantile_bins(spark.range(10).select(F.col("id").alias("query_id"), (-F.col("id")).alias("v")), "v"), "v", "bin")
    assert Counter(b for _, b in bins) == {0: 2, 1: 3, 2: 2, 3: 3} and bins[0] == (-9, 0)
    assert {c: E.class_label for c in ()} == {} and spark.createDataFrame([(0,), (2,), (None,)], "c int").select(E.class_label(F.col("c"))).collect() == [("unnamed",), ("named",), (None,)]


def test_sizes_and_passages(spark):
    assert values(E.size_summary(spark.createDataFrame([(0,), (3,), (1,), (7,)], "n long"))) == [(2.75, 3, 1)]
    gold = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "c")], "doc_id string, node string")
    seen = spark.createDataFrame([("d1", "a"), ("d1", "x"), ("d3", "y"), ("d1", "a")], "doc_id string, node string")
    assert values(E.passage_counts(gold, seen)) == [("d1", 1, 1, 1), ("d2", 0, 0, 1), ("d3", 0, 1, 0)]
    assert values(E.prf(gold, seen)) == [(1, 2, 2, 1 / 3, 1 / 3, 1 / 3)]


# statistics, against Python's own generator


def contrast(diffs, classes, rounds, seed=20260820):
    absent = [diffs[q] for q in sorted(diffs) if classes.get(q) in (0, 1)]
    named = [diffs[q] for q in sorted(diffs) if classes.get(q) == 2]
    rng, mean, draws = random.Random(seed), lambda xs: sum(xs) / len(xs), []
    for _ in range(rounds):
        a = [absent[rng.randrange(len(absent))] for _ in absent]
        draws.append(mean(a) - mean([named[rng.randrange(len(named))] for _ in named]))
    draws.sort()
    k = int(0.025 * rounds)
    p = min(1.0, 2 * min(sum(d <= 0 for d in draws) + 1, sum(d >= 0 for d in draws) + 1) / (rounds + 1))
    return mean(absent) - mean(named), draws[k], draws[rounds - 1 - k], p


@pytest.fixture(scope="module")
def two(spark):
    r = random.Random(4)
    rows = [("m", f"q{i:03}", r.choice([0, 1, 2, 2, None]), round(r.random(), 3), round(r.random(), 3)) for i in range(70)]
    return rows, spark.createDataFrame(rows, "key string, query_id string, cls int, graph double, bm25 double")


def test_class_statistics_equal_plain_draws(spark, two):
    rows, df = two
    classes = {q: c for _, q, c, _, _ in rows}
    diffs = df.withColumn("value", F.col("graph") - F.col("bm25"))
    got = B.class_contrast(diffs, 300).first()
    want = contrast({q: g - b for _, q, _, g, b in rows}, classes, 300)
    assert np.allclose((got.difference, got.low, got.high, got.p_value), want) and got.supported == (want[1] > 0 and want[0] >= 0.02)
    own = B.class_contrast(df.withColumn("value", F.col("graph")), 300).first()
    assert np.allclose((own.difference, own.low, own.high, own.p_value), contrast({q: g for _, q, _, g, _ in rows}, classes, 300))
    empty = B.class_contrast(diffs.where("cls = 2"), 10).first()
    assert empty.error == "a class is empty" and empty.low is None
    named = [g - b for _, q, c, g, b in rows if c == 2]
    rng = random.Random(20260820)
    draws = sorted(sum(named[rng.randrange(len(named))] for _ in named) / len(named) for _ in range(300))
    control = B.advantage(diffs, 300).first()
    assert np.allclose((control.n, control.mean_advantage, control.low, control.high), (len(named), sum(named) / len(named), draws[7], draws[292]))
    parts = {r.term: r for r in B.decompose(df, 300).collect()}
    assert math.isclose(parts["differential"].point, want[0]) and math.isclose(parts["graph"].point + parts["bm25"].point, want[0])
    assert np.allclose((parts["graph"].low, parts["graph"].high), contrast({q: g for _, q, _, g, _ in rows}, classes, 300)[1:3])
    family = {r.name: r for r in B.registered_family(diffs, 300).collect()}
    assert set(family) == {"A|m", "B|m"}
    ps = [family["A|m"].p_value, family["B|m"].p_value]
    assert np.allclose([family["A|m"].p_holm, family["B|m"].p_holm], B.holm_adjusted(ps))


def test_headroom_by_class(spark):
    rows = [("q1", 0, 0.2, 0.5), ("q2", 1, 0.4, 0.5), ("q3", 2, 0.9, 1.0), ("q4", None, 0.0, 0.0)]
    got = {r["class"]: r for r in B.headroom_by_class(spark.createDataFrame(rows, "query_id string, cls int, graph double, bm25 double")).collect()}
    assert math.isclose(got["bridge_absent"].normalised_deficit, -0.4) and got["comparison"].normalised_deficit is None and got["comparison"].headroom == 0
    assert B.crossover(0.4, 0.5, 0.2, 0.5)["supported"] and not B.crossover(0.3, 0.55, 0.2, 0.5)["supported"]


def test_bootstraps_equal_plain_draws(spark):
    r = random.Random(9)
    a, b = [r.random() for _ in range(26)], [r.random() for _ in range(26)]
    rng = random.Random(20260818)
    d = [x - y for x, y in zip(a, b, strict=True)]
    means = sorted(sum(rng.choices(d, k=26)) / 26 for _ in range(2000))
    pairs = spark.createDataFrame([("c", f"q{i:02}", x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "comparison string, query_id string, a double, b double")
    got = B.paired_mersenne(pairs).first()
    p = min(1.0, 2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / 2000)
    assert np.allclose((got.mean_diff, got.low, got.high, got.p_value), (sum(d) / 26, means[50], means[1949], p))
    assert np.allclose(B.bootstrap_mean(np.array(d)), (sum(d) / 26, means[50], means[1949]))


def plain_rho(x, y):
    def ranked(v):
        return [sum(o < e for o in v) + (sum(o == e for o in v) + 1) / 2 for e in v]

    a, b = ranked(x), ranked(y)
    m = (len(x) + 1) / 2
    spread = sum((i - m) ** 2 for i in a) * sum((i - m) ** 2 for i in b)
    return sum((i - m) * (j - m) for i, j in zip(a, b, strict=True)) / math.sqrt(spread) if spread else 0.0


def test_rank_correlation(spark):
    r = random.Random(8)
    x, y = [r.randrange(6) for _ in range(20)], [r.randrange(9) for _ in range(20)]
    frame = spark.createDataFrame([("c", f"q{i:02}", float(u), float(v)) for i, (u, v) in enumerate(zip(x, y, strict=True))], "comparison string, query_id string, x double, y double")
    assert math.isclose(B.spearman(frame.select("x", "y")).first().rho, plain_rho(x, y))
    assert B.spearman(frame.select("x", F.lit(1.0).alias("y"))).first().rho == 0.0
    rng, draws = random.Random(20260818), []
    for _ in range(200):
        i = rng.choices(range(20), k=20)
        draws.append(plain_rho([x[j] for j in i], [y[j] for j in i]))
    draws.sort()
    got = B.spearman_bootstrap(frame, 200).first()
    assert np.allclose((got.rho, got.low, got.high), (plain_rho(x, y), draws[5], draws[194]))


def test_shapley_bootstrap(spark):
    r = random.Random(7)
    cells = {m: [r.random() + 0.3 * (m & 1) for _ in range(12)] for m in range(8)}
    for m in range(8):
        cells[m][0] = 0.5
    frame = spark.createDataFrame([(f"q{i:02}", m, v) for m, vs in cells.items() for i, v in enumerate(vs)], "query_id string, mask int, value double")
    got = {g.name: g for g in B.shapley_bootstrap(frame, ["a", "b", "c"], 100).collect()}
    rng, draws = random.Random(20260818), []

    def phi(v, player):
        total = 0.0
        for m in range(8):
            if not m >> player & 1:
                total += {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}[bin(m).count("1")] * (v[m | 1 << player] - v[m])
        return total

    for _ in range(100):
        i = rng.choices(range(12), k=12)
        means = {m: sum(vs[j] for j in i) / 12 for m, vs in cells.items()}
        draws.append([phi(means, k) for k in range(3)])
    for k, name in enumerate("abc"):
        column = sorted(d[k] for d in draws)
        assert np.allclose((got[name].low, got[name].high), (column[2], column[96]))
    assert got["a>b"].wins == sum(d[0] > d[1] for d in draws) / 100 and got["a>b"].ties == 0
    with pytest.raises(Exception, match="same queries"):
        B.shapley_bootstrap(frame.where("mask <> 3"), ["a", "b", "c"], 10).collect()


def test_clustered_interval():
    r = random.Random(3)
    counts = [(r.randrange(5), r.randrange(3), r.randrange(3)) for _ in range(15)]
    rng, draws = random.Random(20260820), []
    for _ in range(400):
        s = [counts[rng.randrange(15)] for _ in range(15)]
        tp, fp = sum(c[0] for c in s), sum(c[1] for c in s)
        draws.append(round(tp / (tp + fp), 4) if tp + fp else 0.0)
    draws.sort()
    assert B.clustered_prf(pd.DataFrame(counts, columns=["tp", "fp", "fn"]), "precision", 400) == (draws[10], draws[389])


def test_holm_and_percentiles(spark):
    p = [0.04, 0.01, 0.03, 0.005, 0.04]
    want = [0.09, 0.04, 0.09, 0.025, 0.09]
    assert np.allclose(B.holm_adjusted(p), want)
    got = {r.idx: (r.adjusted, r.rejected) for r in B.holm(spark.createDataFrame(list(enumerate(p)), "idx int, p double")).collect()}
    assert all(math.isclose(got[i][0], w) and got[i][1] == (w <= 0.05) for i, w in enumerate(want))
    assert B.percentile_interval(np.arange(100.0)) == (2.0, 97.0) and B.upper_percentile(np.arange(1000.0)) == 949.0
    with pytest.raises(ValueError):
        B.tail_index(10, 0.5)


def test_samples(spark):
    ids = [f"q{i}" for i in range(700)]
    queries = spark.createDataFrame([(i,) for i in ids], "query_id string")
    assert values(B.select_queries(queries)) == sorted((i,) for i in random.Random(20260818).sample(sorted(ids), 500))
    assert B.sample_ids(ids[:3], 5, 1) == sorted(ids[:3])


def test_every_query_is_named_once():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) >= 70


# scores in the tasks that read the documents


def test_best_of_a_task_is_bounded_and_exact(spark):
    """One partition gives k rows a query and cell, not a row for each document; ties fall by id, also those of many copies."""
    texts = ["alpha beta", "alpha", "beta beta alpha gamma", "delta", "alpha beta"] * 700
    rows = [((i * 7919) % 3500, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([("q", "alpha beta"), ("r", "delta"), ("none", "zzz")], "query_id string, text string")
    terms = R.query_words(queries)
    hits, idf, average = R.Index(docs).held(terms)
    found = M.best(hits, terms, 3, R.cell_scores(R.CELLS, idf, average), 8)
    assert found.count() == 8 * 2 * 3
    runs = R.factorial_runs(R.Index(docs), queries, 3).where("mask = 7").collect()
    for q, text in (("q", "alpha beta"), ("r", "delta")):
        want = sorted(((-round(s, 9), d) for d, s in bm25(rows, text).items()))[:3]
        assert [r.doc_id for r in sorted((r for r in runs if r.query_id == q), key=lambda r: r.rank)] == [d for _, d in want]
    by_place = {(r.query_id, r.rank): (r.doc_id, r.matched, r.total) for r in R.coordination(docs, queries, 3).collect()}
    both = sorted((d for d, t in rows if t == "beta beta alpha gamma"))[:3]
    assert [by_place["q", n] for n in (1, 2, 3)] == [(d, 2, 3) for d in both]


def test_rows_that_share_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha"), (None, "alpha"), (None, "alpha"), (2, "beta")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([("q", "alpha beta")], "query_id string, text string")
    assert sorted((str(r.doc_id), r.matched, r.total) for r in R.coordination_hits(docs, queries).collect()) == [("1", 2, 3), ("2", 1, 1), ("None", 1, 2)]
    assert sorted(str(r.doc_id) for r in R.lexical(R.Index(docs), queries, 10).collect()) == ["1", "2", "None"]


def test_runs_sent_or_joined_are_the_same(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(30)) + " É") for i in range(60)] + [(99, None), (98, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(3, 3 + n))) for i in range(11) for n in (1, 2, 3, 5, 9)], "query_id long, text string")
    sent, joined = (values(R.contained_runs(docs, queries, most=most)) for most in (1 << 17, 0))
    assert sent == joined and sent


def test_long_documents_cross_pieces_of_text(spark):
    """Texts longer than a task looks at together, and many in one piece."""
    rows = [(i, "banana " * (M.BYTES // 7 + 10 if i == 1 else i) + "x1") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([("q", "ana banana x1 1")], "query_id string, text string")
    got = {r.doc_id: (r.matched, r.total) for r in R.coordination_hits(docs, queries, bounded=False).collect()}
    assert got == {i: (sum(t.count(w) > 0 for w in ("ana", "banana", "x1", "1")), sum(t.count(w) for w in ("ana", "banana", "x1", "1"))) for i, t in rows}


def test_walker_sums_edges_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    start = np.concatenate([[0], np.cumsum(r.integers(1, 9, 50))])
    of, x = r.integers(0, 20, start[-1] + 4), r.random(20)
    for edges in (1, 3, 7, 1000):
        monkeypatch.setattr(G.Walker, "EDGES", edges)
        assert np.allclose(G.Walker.sums(x, of, start), np.add.reduceat(x[of], start))


def test_passages_without_an_id_are_not_joined(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "doc_id long, node string")
    predicted = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c"), (None, "a")], "doc_id long, node string")
    found = E.passage_counts(gold, predicted)
    assert {r.doc_id: (r.tp, r.fp, r.fn) for r in found.collect()} == {1: (1, 0, 1), 2: (0, 1, 0), None: (0, 1, 1)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_draws_dealt_to_tasks_are_those_of_one_stream(spark):
    """Rounds go over the ends of the parts of the stream; every draw is the one that one task makes."""
    counts = pd.DataFrame({"doc_id": range(37), "tp": [i % 4 for i in range(37)], "fp": [i % 3 for i in range(37)], "fn": [i % 5 for i in range(37)]})
    got = {r.metric: (r.low, r.high) for r in B.clustered_intervals(spark.createDataFrame(counts), 50, 7, words=300).collect()}
    assert got == {m: B.clustered_prf(counts, m, 50, 7) for m in ("precision", "recall")}
    values = counts[["tp", "fp"]].to_numpy().astype(np.int32)
    stream = B.Stream(7)
    assert np.array_equal(B.round_sums(spark, values, 50, 7, words=300), [values[stream.randrange(37, 37)].sum(0) for _ in range(50)])


def test_properties_weigh_only_the_queries_words(spark, monkeypatch):
    def refused(self):
        raise AssertionError("idf of every term of the corpus")

    monkeypatch.setattr(R.Index, "idf", refused)
    rows = {r.query_id: r for r in catalog._properties(spark, "/root/testdata/sf0.001").collect()}
    assert rows
    assert all(r.max_idf >= r.mean_idf > 0 for r in rows.values() if r.query_length)


def test_dense_takes_few_queries_at_once(spark, monkeypatch):
    monkeypatch.setattr(R, "ABREAST", 2)
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(23)], "doc_id long, embedding array<double>")
    queries = df.withColumnRenamed("doc_id", "query_id")
    few = values(R.dense(df, queries, 3))
    monkeypatch.setattr(R, "ABREAST", 512)
    assert few == values(R.dense(df, queries, 3))
