"""Mixing, licenses, secrets and SimHash against brute force over edge cases and a small table."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from siftwell.llm import _text as T
from siftwell.llm import licenses, mixing, queries, secrets, simhash
from siftwell.llm._spark import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, and columns with names that operators use."""
    long = "All rights reserved. " + "word " * 30000 + "cc by token = 'abcdef123456'"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one two"), (None, None), (5, long), (6, long), (7, "CC-BY cc; by ALL RIGHTS RESERVED all rights"), (8, "General Public License, é " * 3)]
    return spark.createDataFrame([(i, t, "en", None if n % 3 == 0 else f"s{n % 3}", 0, 9, 9) for n, (i, t) in enumerate(rows)], SCHEMA)


def low(t):
    return (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))


def both(spark, odd):
    yield odd
    yield spark.read.parquet(f"{SF}/documents.parquet")
    yield odd.limit(0)


def bits_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: g for g in groups.values() for n in g}


def test_simhash(spark, odd):
    for df in both(spark, odd):
        rows = df.select("doc_id", "text").collect()
        fps = [bits_of(r.text) for r in rows]
        distinct = sorted(set(fps))
        group = reach(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 2])
        expect = []
        for r, f in zip(rows, fps, strict=True):
            ids = [x.doc_id for x, g in zip(rows, fps, strict=True) if g in group[f] and x.doc_id is not None]
            expect.append((r.doc_id, f, min(ids, default=None)))
        got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()]
        assert Counter(got) == Counter(expect)


@pytest.mark.parametrize("bucket", [0, 3, 1000])
def test_links_keep_components(spark, bucket):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centres for _ in range(25)})
    group = reach(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r.node: r.component for r in components(simhash.links(df, 2, bucket)).collect()}
    assert {f: found.get(signed(f), signed(f)) for f in fps} == {f: min(map(signed, g)) for f, g in group.items()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def signature_of(text, longs, k=5):
    """The long fingerprint as one number, over shingles of the text's own hashes."""
    raw = (text or "").encode()
    w = T.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), T.SPACE_WORD)
    hs = sorted(set(T.shingle_hashes(T.word_hashes(w), w.row, k, 1)[0].tolist()))
    salts = T.mix(np.arange(1, longs + 1, dtype=np.uint64)).tolist()
    out = 0
    for i, salt in enumerate(salts):
        mixed = [int(T.mix(np.array([h ^ salt], np.uint64))[0]) for h in hs]
        for b in range(64):
            ones = sum(m >> b & 1 for m in mixed)
            if 2 * ones > len(hs) or (hs and 2 * ones == len(hs) and mixed[0] >> b & 1):
                out |= 1 << 64 * i + b
    return out


def signature_numbers(texts, longs):
    raw = [(t or "").encode() for t in texts]
    sig = simhash.signature(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5, longs)
    return [sum(int(x) << 64 * i for i, x in enumerate(row)) for row in sig]


def similar_groups(texts, rows):
    """For each text the least fingerprint that it reaches, by comparing all pairs."""
    shape = simhash.blocks_for(rows)
    fps = signature_numbers(texts, shape.longs)
    most = shape.most(shape.longs, 1)
    distinct = sorted(set(fps))
    group = reach(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= most])
    return [min(group[f]) for f in fps]


def test_signature():
    texts = [None, "", "one", "one two three four", "A b c d e f", "the same words and the same words and the same words", "many " * 700 + " ".join(f"w{i}" for i in range(900))]
    assert signature_numbers(texts, 2) == [signature_of(t, 2) for t in texts]


def test_signatures_follow_jaccard():
    """Texts of known similarity: the share of differing bits is on its side of the limit."""
    shape = simhash.blocks_for(1000)
    words = [f"w{i}" for i in range(404)]
    for changed, near in [(4, True), (8, True), (16, False), (30, False)]:
        # a new word in the middle of each run changes five shingles of 400
        other = [f"x{i}" if i % (404 // changed) == 5 and i // (404 // changed) < changed else w for i, w in enumerate(words)]
        sets = [{tuple(t[i : i + 5]) for i in range(400)} for t in (words, other)]
        j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert (j >= 0.8) == near
        a, b = signature_numbers([" ".join(words), " ".join(other)], shape.longs)
        assert ((a ^ b).bit_count() <= shape.most(shape.longs, 1)) == near


def test_similar(spark, odd):
    for df in both(spark, odd):
        rows = df.select("doc_id", "text").collect()
        groups = similar_groups([r.text for r in rows], len(rows))
        expect = [(r.doc_id, min((x.doc_id for x, h in zip(rows, groups, strict=True) if h == g and x.doc_id is not None), default=None)) for r, g in zip(rows, groups, strict=True)]
        assert Counter((r.doc_id, r.component_id) for r in simhash.similar(df).collect()) == Counter(expect)


@pytest.mark.parametrize("bucket", [1, 5, 1000])
def test_similar_links_keep_components(spark, bucket):
    """Groups of copies that differ from a centre, some linked by chains only: the same components however large a bucket may be."""
    r = random.Random(5)
    shape = simhash.Blocks(16, 16, 4, 0.15)
    most, probe = shape.most(4, 1), shape.most(1, 4)
    centres = [r.getrandbits(256) for _ in range(5)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(256), r.randint(0, 26))) for c in centres for _ in range(30)})
    blocks = lambda f: {(i, f >> 16 * i & 0xFFFF) for i in range(16)}
    near = lambda a, b: (a ^ b).bit_count() <= most and ((a ^ b) % (1 << 64)).bit_count() <= probe and blocks(a) & blocks(b)
    group = reach(range(len(fps)), [(i, j) for i, a in enumerate(fps) for j in range(i) if near(a, fps[j])])
    df = spark.createDataFrame([(i, [signed(f >> 64 * n & (1 << 64) - 1) for n in range(4)]) for i, f in enumerate(fps)], "node long, sig array<long>")
    found = {x.node: x.component for x in components(simhash.similar_links(df, shape, bucket, 2)).collect()}
    assert {i: found.get(i, i) for i in range(len(fps))} == {i: min(g) for i, g in group.items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_mixing(spark, odd):
    for df in both(spark, odd):
        rows = df.select("doc_id", "text", "source").collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        total = Counter()
        for r in rows:
            total[r.source] += size(r.text)
        order = sorted((s for s in total if s is not None)) + [None] * (None in total)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        want, over = {}, set()
        while True:
            free = [s for s in order if s not in over]
            rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in over)
            want = {s: 2 * total[s] for s in over} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            if not (more := {s for s in free if want[s] > 2 * total[s] + 1e-9}):
                break
            over |= more
        got = mixing.mix(df).collect()
        assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, size(r.text)) for r in rows)
        taken, copies = Counter(), defaultdict(list)
        for r in got:
            assert r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert r.taken == r.copies * r.size <= 2 * r.size
            taken[r.source] += r.taken
            if r.size:
                copies[r.source].append(r.copies)
        for s, c in copies.items():
            assert abs(sum(c) - len(c) * want[s] / total[s]) < 1 + 1e-6
            assert abs(taken[s] - want[s]) <= max(r.size for r in got if r.source == s)
        again = mixing.mix(df.repartition(3)).collect()
        assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_mixing_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    rows = [(None, "w " * 3, "a")] * 1001 + [(7, "w w", "a")] * 3 + [(i, "w " * (i % 5), "b") for i in range(500)]
    df = spark.createDataFrame([(i, t, "en", s, 0, 9, 9) for i, t, s in rows], SCHEMA)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(t.split())) for i, t, s in rows)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5
        assert max(r.copies for r in own) - min(r.copies for r in own if r.size) <= 1
    # of equal rows all but one item's residual are certain
    equal = [r.copies for r in got if r.doc_id is None]
    each = got[0].target / got[0].source_size if got[0].source == "a" else next(r.target / r.source_size for r in got if r.source == "a")
    assert abs(sum(equal) - 1001 * each) < 1


def test_licenses(spark, odd):
    for df in both(spark, odd):
        got = licenses.scan(df).collect()
        expect = []
        for r in df.select("doc_id", "text").collect():
            w = re.findall(licenses.WORD, low(r.text))
            at = [(i, v) for p, v in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            expect.append((r.doc_id, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({v for _, v in at}))))
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(expect)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def spans_by_brute_force(text, templates, gap=3, cover=0.8):
    """(label, start, end, share) of merged diagonals, from all pairs of places."""
    w, out = re.findall(licenses.WORD, low(text)), []
    for template, label in templates.items():
        t = template.split()
        diagonals = defaultdict(list)
        for i in range(len(w) - 1):
            for j in range(len(t) - 1):
                if w[i : i + 2] == t[j : j + 2]:
                    diagonals[i - j].append(i)
        last, groups = None, []
        for d, at in sorted(diagonals.items(), key=lambda x: (min(x[1]), x[0])):
            if last and abs(d - last[0]) <= gap and min(at) - max(last[1]) <= gap + 1 and min(at) - d > max(last[1]) - last[0]:
                groups[-1] += at
            else:
                groups.append(list(at))
            last = (d, at)
        out += [(label, min(g), max(g) + 2, len(g) / (len(t) - 1)) for g in groups if len(g) / (len(t) - 1) >= cover]
    return sorted(out)


def test_license_spans_equal_brute_force(spark, odd):
    r = random.Random(5)
    texts = []
    for t in licenses.TEMPLATES:  # copies with words left out, put in and repeated
        for _ in range(6):
            w = [x for x in t.split() if r.random() > 0.05]
            for _ in range(r.randint(0, 3)):
                w.insert(r.randint(0, len(w)), r.choice(["kindly", "or", "license", "the"]))
            texts.append(" ".join(["lead", *w, *r.choice([[], w, ["far"] * 5 + w])]))
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionAll(odd.select("doc_id", "text"))
    short = {"foo bar baz": "foo", "foo bar": "two"}
    for templates, cover, df in [(licenses.TEMPLATES, 0.8, docs), (short, 0.5, spark.createDataFrame([(1, "foo bar"), (2, "foo bar " * 6), (3, "foo x bar baz foo bar")], "doc_id long, text string"))]:
        got = licenses.scan(df, templates=templates, cover=cover).collect()
        want = Counter()
        for x in df.select("doc_id", "text").collect():
            base = {v for p, v in licenses.PHRASES.items() if f" {p} " in f" {' '.join(re.findall(licenses.WORD, low(x.text)))} "}
            own = spans_by_brute_force(x.text, templates, cover=cover)
            want[x.doc_id, ",".join(sorted(base | {s[0] for s in own})), 1.0 if base else max((s[3] for s in own), default=0.0)] += 1
        assert Counter((x.doc_id, x.labels, x.score) for x in got) == want
    assert {x.doc_id: x.labels for x in got} == {1: "foo,two", 2: "foo,two", 3: "foo,two"}


def test_license_spans_survive_edits(spark):
    notice = [t for t, v in licenses.TEMPLATES.items() if v == "bsd"][0].split()
    edited = " ".join(["x y", *notice[:8], "kindly", *notice[8:], "z"])
    half = " ".join(notice[:9])
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, edited), (2, half)], "doc_id long, text string")).collect()}
    assert got[1].labels == "bsd" and got[2].labels == ""
    assert [(s.start, s.end) for s in got[1].spans] == [(2, 3 + len(notice))]


def brute_secrets(text):
    kinds = [(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(found)


def test_secrets(spark, odd):
    more = spark.createDataFrame([(70, "é𝒳 PassWord: 'hunter2' ſecret=abcdefg token=short api-key=abcdefgh API_KEY=\"abcdefgh"), (71, "AKIA" + "A" * 16 + " AKIAAKIA " + "f" * 24 + "g" + "0" * 23), (72, "key Zk9xQ2v7Lp0RtY4mWq8s done")], "doc_id long, text string")
    for df in [*both(spark, odd), more]:
        expect = []
        for r in df.select("doc_id", "text").collect():
            f = brute_secrets(r.text or "")
            k = [x[1] for x in f]
            expect.append((r.doc_id, k.count(0), k.count(1), k.count(2), hashlib.sha256(secrets._joined(f).encode()).hexdigest()))
        got = secrets.scan(df).collect()
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == Counter(expect)
    assert "markov:4:24" in {r.doc_id: r.spans for r in got}[72]


def test_markov_model_parts_held_out_samples():
    ratio, threshold = secrets.fit()
    held = secrets.labelled(500, seed=99)
    right = sum((secrets.score(s, ratio) > threshold) == bool(y) for s, y in held)
    assert right / len(held) > 0.97


def test_keys_of_letters_only_are_scored(spark):
    r = random.Random(11)
    keys = ["".join(r.choices(string.ascii_letters, k=20)) for _ in range(200)]
    plain = "internationalization counterrevolutionary Geschwindigkeitsbegrenzung Verantwortungsbewusstsein anticonstitutionnellement desafortunadamente responsabilidades getElementsByTagName straightforwardness".split()
    docs = spark.createDataFrame(list(enumerate(keys + plain)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.scan(docs).collect()}
    assert sum(got[i] == "markov:0:20" for i in range(200)) >= 190
    assert not any(got[i] for i in range(200, len(got)))
    assert secrets.redact(docs.where("doc_id < 200")).where("text = '[REDACTED]'").count() >= 190


def test_redact(spark, odd):
    got = {r.doc_id: r.text for r in secrets.redact(odd).collect()}
    assert got[1] is None and got[5].endswith("cc by [REDACTED]'") and odd.columns == secrets.redact(odd).columns


def test_queries_run_over_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_mixing", "op3_licenses", "op5_secrets", "op9_simhash"):
        assert queries.queries()[name](spark, SF).count() == n
