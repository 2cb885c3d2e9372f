"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target is a share of the wanted total by weight; a target stops at `most` times
the source's size and the excess goes to the others by weight. Every document of a source
then has the same expected number of copies p = target / size of the source. The whole part
is taken at once; the fraction is rounded: documents of like size meet in leaves of about
`ARITY`, each pair passes mass at random until one of the two is 0 or 1, and the one
residual of a leaf goes up a tree of that arity to the root of its source. So the copies of
a source hit n * p but for less than one, in every size class of it too, and a source of any
size is spread over its leaves. Draws are hashes of the rows, so reruns agree.

Rows equal in id, source and size are one item: of n such rows the whole part of n * p takes
one copy more at once, and only the rest goes through the tree, so repeated rows never meet in
one leaf. Null text has size 0; null source is a source of its own, the last; null ids are
allowed. Documents of size 0 are never taken; no rows give none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._spark import saved
from siftwell.plans.lineage import positions

ARITY = 32
WEIGHTS = (5, 2, 1)
TINY = 1e-9
#: Equal rows that one task expands at once.
CHUNK = 1 << 16
#: Of an item: `n` equal rows, of which `more` have one copy more than the whole part at any rate.
ITEM = ["size", "u", "doc_id", "n", "more"]


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds target to (source, source_size): weights repeat by code point order, null last. One row for each source.

    The level is the words a unit of weight gets. While it lifts more sources above their cap, it rises by what they leave.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = saved(positions(sources, F.col("source").asc_nulls_last()).withColumn("w", w).withColumn("cap", F.col("source_size") * most).drop("place"))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, -1.0
    while level > before:
        before = level
        full = F.col("cap") <= F.col("w") * level
        caps, rest = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        level = max(level, (total - caps) / rest) if rest else level
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _uniform(*parts: Column | str) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _pivot(items: Column, seed: int) -> Column:
    """Folds an array of struct(size, u, doc_id, n, more, p) into struct(done: their structs with the rounded p, left: at most one residual)."""
    pair = lambda done, left: F.struct(done.alias("done"), left.alias("left"))
    to = lambda x, p: F.struct(*[x[c].alias(c) for c in ITEM], p.alias("p"))
    start = pair(F.slice(items, 1, 0), F.filter(items, lambda x: F.lit(False)))

    def step(acc: Column, x: Column) -> Column:
        a = F.get(acc["left"], F.lit(0))
        r, total = _uniform(a["u"], x["u"], F.lit(seed)), a["p"] + x["p"]
        under, over = total < 1 - TINY, total > 1 + TINY
        # both below one: the winner has all; above: one becomes whole, the other keeps the rest; else one of each
        first = F.when(under, r * total < a["p"]).when(over, r * (2 - total) < 1 - x["p"]).otherwise(r < a["p"])
        won, lost = F.when(first, a).otherwise(x), F.when(first, x).otherwise(a)
        done = F.when(under, F.array(to(lost, F.lit(0.0)))).when(over, F.array(to(won, F.lit(1.0)))).otherwise(F.array(to(won, F.lit(1.0)), to(lost, F.lit(0.0))))
        left = F.when(under, F.array(to(won, total))).when(over, F.array(to(lost, total - 1))).otherwise(F.slice(acc["left"], 1, 0))
        return F.when(F.size(acc["left"]) == 0, pair(acc["done"], F.array(x))).otherwise(pair(F.concat(acc["done"], done), left))

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    sized = saved(sized.withColumn("u", F.xxhash64("doc_id", "source", "size", F.lit(seed))).withColumn("band", F.when(F.col("size") > 0, F.floor(F.log2("size") * 8)).otherwise(-1).cast("int")))
    bands = saved(sized.groupBy("source", "band").agg(F.count("*").alias("items"), F.sum(F.col("size") * F.col("n")).alias("words"), F.max("n").alias("most")))
    goals = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    p = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(p + TINY)
    goals = saved(goals.select(F.col("source").alias("s"), "source_size", "target", whole.alias("base"), F.greatest(p - whole, F.lit(0.0)).alias("each")))
    leaves = F.ceil(F.col("items") / ARITY)
    up = Window.partitionBy("source").orderBy("band")
    plan = bands.where("band >= 0").select(F.col("source").alias("b"), F.col("band").alias("band_"), leaves.alias("leaves"), (F.sum(leaves).over(up) - leaves).alias("offset"))
    plan = saved(plan.join(goals, F.col("b").eqNullSafe(F.col("s"))).drop("s"))
    deepest = plan.where(f"each > {TINY}").agg(F.max(F.col("offset") + F.col("leaves"))).first()[0] or 0
    rows = sized.where("band >= 0").join(plan, F.col("source").eqNullSafe(F.col("b")) & (F.col("band") == F.col("band_")))
    mass = F.col("n") * F.col("each")
    rows = rows.withColumn("more", F.least(F.floor(mass + TINY), F.col("n"))).withColumn("p", F.greatest(mass - F.col("more"), F.lit(0.0)))
    key = ["source", "source_size", "target", "base"]
    certain = F.struct(*ITEM, F.lit(0.0).alias("p")).alias("x")
    zero = sized.where("band < 0").join(goals, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("more", F.lit(0).cast("long"))
    out = rows.where(f"p <= {TINY}").select(*key, certain).unionAll(zero.select(*key, certain))
    level = rows.where(f"p > {TINY}").select(*key, (F.col("offset") + F.pmod("u", F.col("leaves"))).alias("node"), F.struct(*ITEM, "p").alias("x"), F.lit(0).cast("long").alias("at"))
    depth = 1 + (math.ceil(math.log(deepest, ARITY) + 1e-9) if deepest > 1 else 0)
    for i in range(depth if deepest else 0):
        folded = level.groupBy(*key, "node").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
        folded = saved(folded.select(*key, "node", _pivot(F.col("xs.x"), seed + i).alias("f")))
        out = out.unionAll(folded.select(*key, F.explode("f.done").alias("x")))
        left = folded.select(*key, F.col("node").alias("at"), F.explode("f.left").alias("x"))
        level = left.select(*key, F.floor(F.col("at") / ARITY).alias("node"), "x", "at")
    if deepest:
        last = (_uniform("x.u", F.lit(seed)) < F.col("x.p")).cast("double")
        out = out.unionAll(level.select(*key, F.struct(*[F.col(f"x.{c}") for c in ITEM], last.alias("p")).alias("x")))
    # an item is its equal rows again; very many of them go in chunks, dealt anew
    flat = out.select("source", "source_size", "target", "base", *[F.col(f"x.{c}").alias(c) for c in (*ITEM, "p")])
    one = flat.where("n = 1").withColumn("i", F.lit(0).cast("long"))
    pieces = flat.where("n > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    if (bands.agg(F.max("most")).first()[0] or 0) > CHUNK:
        pieces = pieces.repartition("piece", "u")
    one = one.unionAll(pieces.withColumn("i", F.explode(F.sequence(F.col("piece") * CHUNK, F.least(F.col("n"), (F.col("piece") + 1) * CHUNK) - 1))).drop("piece"))
    copies = (F.coalesce("base", F.lit(0)) + (F.col("i") < F.col("more") + F.col("p")).cast("int")).cast("long")
    return one.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
