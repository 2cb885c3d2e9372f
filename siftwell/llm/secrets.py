"""Secret scans: three fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two second-order chains over a small alphabet are fitted with add-one counts, one on strings
labelled random and one on strings labelled ordinary. A candidate token is a secret if its
log-likelihood ratio for each character is above the threshold that best parts held-out
labelled samples. The labelled samples are made here: random ones come from a seeded
generator over usual key alphabets, ordinary ones are names joined from a list of common
programming words in usual styles, and plain words: those words, and long ones joined from
common words and affixes of four languages. Candidates of letters only are scored as all others.

Null text is empty. Each input row gives one row, repeated rows and null ids too; offsets
are code points, end exclusive. Overlaps between kinds are kept: kinds are scanned apart.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, their kinds in order, and the least length of what counts.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
#: Runs of 24 or more hex digits; a maximal run is found as HEX finds it, as it can't extend either way.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Common words of identifiers.
COMMON = """account action address array async base batch block buffer button bytes cache call channel char check class client close cluster code
column command config connection content context controller count create current cursor data database date default delete depth device dict
directory display document domain driver element email enable encode end engine entity entry error event exception execute factory field file
filter find first flag folder font format frame function get global graph group handle handler hash header height hidden host html image index
info init input insert instance interface invalid item iterator job join json key label language last layout left length level library limit line
link list load local lock log login manager map match max memory menu message meta method middle min mode model module mouse name network next
node null number object offset open option order output owner package page panel param parent parse password path pattern payload pixel player
plugin point pointer policy pool port position prefix previous print process product profile project property protocol provider proxy public query
queue random range rate read record reference register remote remove render repeat report request reset resource response result return right role
root route rule sample schema scope script search section select sender sequence server service session setting shadow shape shared signal size
socket sort source stack start state static status storage store stream string style subject submit success suffix sum switch symbol sync system
table target task template test text theme thread time title toggle token tool total trace track transaction transform tree type update upload
url user util valid value vector version view visible wait warning watch weight widget width window worker wrapper write zone""".split()

#: Common words and affixes of English, German, French and Spanish, of which long plain words are joined.
PARTS = """able ac ach age al ally an and ant ar arch are as at ate ation auf aus aux be bei ber berg bio ch che chen chkeit chung com con counter cu de del
der des di die dis down ed ein eit electro elle en ence end ent er erei ers ery es est et eur eux ever ex fahrt fer for ful ge gegen gen graph ha had haft
heit her hood ic ich ie ient ier iert ification ig igkeit il ily im in ing inter ion ir is ish isch ism ist ity ive ization ize je keit kon la le
les less lich los ly mal man mente ment mis mit nach ness nicht no non not of ologie ology on or oso ou ouse our out over pa para pf pour pre pro que qui ra
re rement res sam sch schaft se sein ship sion son st stand straight sub sup super sur tele ten ter th that the thing ti tig tion to tor tra trans tz
ul um un und under une ung up ur ver vor was weg with wissen y zer zu zug zung""".split()

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/=-"
_CODE = np.full(256, 0, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1
SYMBOLS = len(ALPHABET) + 1


def labelled(n: int = 4000, seed: int = 5) -> list[tuple[str, int]]:
    """n random strings (1) and n ordinary identifiers (0)."""
    r = random.Random(seed)
    keys = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62] + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62] + "_-"]
    out = []
    for i in range(n):
        out.append(("".join(r.choices(keys[i % len(keys)], k=r.randint(16, 48))), 1))
        words = r.choices(COMMON, k=r.randint(3, 6))
        prose = ""
        while len(prose) < 16:
            prose += r.choice(PARTS)
        style = i % 12
        name = ["_".join(words), words[0] + "".join(w.title() for w in words[1:]), "-".join(words), "_".join(words).upper(), "/".join(words), "".join(words), *[prose] * 3, *[prose.title()] * 2, prose.upper()][style]
        out.append((name + (str(r.randint(0, 2030)) if r.random() < 0.2 else ""), 0))
    return out


def fit(samples: list[tuple[str, int]] | None = None, order: int = 2) -> tuple[np.ndarray, float]:
    """The table of log-ratio of random to ordinary for each (context, character), and the threshold a character.

    Even samples train, odd ones place the threshold where most are right, in the middle between neighbours.
    """
    samples = samples or labelled()
    tables = []
    for label in (1, 0):
        counts = np.full((SYMBOLS**order, SYMBOLS), 0.5)
        for s, y in samples[::2] if len(samples) < 4 else [x for i, x in enumerate(samples) if i // 2 % 2 == 0]:
            if y == label:
                context, code = _contexts(s, order)
                np.add.at(counts, (context, code), 1)
        # a context seen rarely leans on the characters as such
        overall = counts.sum(0) / counts.sum()
        smooth = counts - 0.5 + 8 * overall
        tables.append(np.log(smooth / smooth.sum(1, keepdims=True)))
    ratio = tables[0] - tables[1]
    held = [(score(s, ratio, order), y) for i, (s, y) in enumerate(samples) if i // 2 % 2 == 1] or [(score(s, ratio, order), y) for s, y in samples]
    cuts = sorted({v for v, _ in held})
    middle = [(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)] or cuts
    right = lambda t: sum((v > t) == bool(y) for v, y in held)
    best = max(right(t) for t in middle[:: max(1, len(middle) // 400)])
    good = [t for t in middle[:: max(1, len(middle) // 400)] if right(t) == best]
    return ratio, good[len(good) // 2]


def _contexts(s: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    s = s.lower() if s.isupper() else s  # names in capitals are spelt as others
    code = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    padded = np.concatenate([np.zeros(order, np.int64), code])
    context = np.zeros(len(code), np.int64)
    for i in range(order):
        context = context * SYMBOLS + padded[i : i + len(code)]
    return context, code


def score(s: str, ratio: np.ndarray, order: int = 2) -> float:
    """Mean log-likelihood ratio of a character."""
    context, code = _contexts(s, order)
    return float(ratio[context, code].mean()) if len(code) else -math.inf


def spans(text: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if score(s, ratio) > threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for every row of docs. `samples` are labelled strings, held in memory."""
    ratio, threshold = fit(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = spans(text.as_py() or "", ratio, threshold)
                kinds = [k for _, k, _ in found]
                base = _joined([x for x in found if x[1] < 3])
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), kinds.count(3), hashlib.sha256(base.encode()).hexdigest(), _joined(found)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """docs with every span replaced by `mark`; other columns, null texts and rows without spans stay as they are."""
    ratio, threshold = fit(samples)
    docs_columns = docs.columns

    def clean(text: str) -> str:
        out, at = [], 0
        for a, _, b in spans(text, ratio, threshold):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = docs_columns.index(text_col)
            texts = pa.array([None if x is None else clean(x) for x in (t.as_py() for t in batch.column(i))], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([texts if j == i else c for j, c in enumerate(batch.columns)], schema=batch.schema)

    # by number, as names may hold dots
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs_columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs_columns)
