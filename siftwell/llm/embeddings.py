"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors of a label form one class. Classes of a label are one cell at first. A cell of more than
2 * `shard` classes is split: pivots drawn from it by hash, 4,096 at most, define clusters, and each class goes to those of its
`overlap` nearest pivots; cells that are still too large are split again. The last cells are the
overlapping shards. Within a shard a flat graph is built: exact nearest neighbours,
robust-pruned to `degree` edges. Adjacency lists of a class are united over its shards. A shard
then takes in the neighbours that its members have in other shards, where they are near enough to lie between two
linked vectors, and searches the united graph for every member: greedy from the shard's medoid,
then expanding through every neighbour within range. Found pairs are verified by the cosine in double precision.
Pairs that can meet in several shards count only in the first of these. Recall is audited on
bounded samples of classes, drawn from all and from those with links, against all rows by brute force; below `recall` the index is built
again with more overlap, and after three tries that fall short an error is raised.

A shard returns counts and a spanning forest of its links, never its pairs. A task holds one
shard and the links found in it.

Rows whose label is null, and vectors that are null, zero, or hold null or non-finite
components link with nothing, and are their own component (null if the id is null). Equal
rows link with each other. Vectors of different lengths never link. Vectors are scaled by their largest
component first, so very large and very small ones are compared as others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._spark import components, grouped, looked_up, saved

SHARD, DEGREE, BEAM = 1000, 24, 4
#: Pivots of a cell at most, rows of a cell that one task splits, and audited classes of either sample at most.
MOST_PIVOTS, PIECE, AUDITED = 4096, 128, 512


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = 1.2, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency [n, degree] (-1: none) of a robust-pruned graph over unit vectors, from exact neighbours, and the cosine of each edge."""
    n = len(x)
    k = min(n - 1, 2 * degree)
    out, cosine = np.full((n, degree), -1, np.int32), np.full((n, degree), -2, np.float32)
    if k < 1:
        return out, cosine
    for low in range(0, n, block):
        sims = x[low : low + block] @ x.T
        m = len(sims)
        sims[np.arange(m), np.arange(low, low + m)] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sims, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        distance = np.maximum(0, 2 - 2 * s)
        alive, filled = np.ones((m, k), bool), np.zeros(m, np.int64)
        between = np.maximum(0, 2 - 2 * np.einsum("mkd,mjd->mkj", x[near], x[near], optimize=True))
        for j in range(k):
            chosen = np.flatnonzero(alive[:, j] & (filled < degree))
            out[low + chosen, filled[chosen]], cosine[low + chosen, filled[chosen]] = near[chosen, j], s[chosen, j]
            filled[chosen] += 1
            # a candidate nearer to the chosen one than to the centre, by alpha, is reached through it
            alive[chosen] &= ~(alpha * between[chosen, j] <= distance[chosen])
    return out, cosine


def _expand(at: np.ndarray, flat: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `nodes`, neighbour) for every edge of every node."""
    counts = at[nodes + 1] - at[nodes]
    owner = np.repeat(np.arange(len(nodes)), counts)
    return owner, flat[np.arange(len(owner)) + np.repeat(at[nodes] - np.cumsum(counts) + counts, counts)]


def search(x: np.ndarray, graph: list[np.ndarray], least: float, members: int, beam: int = BEAM, block: int = 1024) -> np.ndarray:
    """Codes (low * n + high) of the pairs at `least` or above that greedy search from the medoid and range expansion find for the first `members` vectors.

    Queries go in blocks; work and memory follow the nodes seen, but for one bit of `seen` a pair of a block.
    """
    n = len(x)
    at = np.concatenate([[0], np.cumsum([len(g) for g in graph])]).astype(np.int64)
    flat = np.concatenate([*graph, np.zeros(0, np.int64)]).astype(np.int64)
    medoid = int(np.argmax(x[:members] @ x[:members].mean(0)))
    near = least - 1e-4
    out = []
    for low in range(0, members, block):
        m = min(block, members - low)
        own = np.arange(m)
        seen = np.zeros((m, n), bool)
        seen[own, low + own] = seen[:, medoid] = True
        ids, sims, done = np.full((m, beam), medoid), np.full((m, beam), -2, np.float32), np.ones((m, beam), bool)
        sims[:, 0], done[:, 0] = x[low : low + m] @ x[medoid], False
        # range expansion starts at each member itself, whose place the graph holds, and at what the search meets in range
        met = [own * n + low + own, own[sims[:, 0] >= near] * n + medoid]
        active = own
        while len(active):
            best = np.where(done[active], -3, sims[active]).argmax(1)
            go = ~done[active, best]
            active, best = active[go], best[go]
            done[active, best] = True
            owner, node = _expand(at, flat, ids[active, best])
            q = active[owner]
            fresh = ~seen[q, node]
            q, node = q[fresh], node[fresh]
            seen[q, node] = True
            s = np.einsum("ij,ij->i", x[low + q], x[node])
            met.append(q[s >= near] * n + node[s >= near])
            order = np.lexsort((-s, q))
            q, node, s = q[order], node[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, node, s, rank = (v[rank < beam] for v in (q, node, s, rank))
            place = np.searchsorted(active, q)
            wide = [np.concatenate([v[active], np.full((len(active), beam), fill, v.dtype)], 1) for v, fill in ((ids, medoid), (sims, -2), (done, True))]
            for v, values in zip(wide, (node, s, False), strict=True):
                v[place, beam + rank] = values
            top = np.argsort(-wide[1], axis=1, kind="stable")[:, :beam]
            ids[active], sims[active], done[active] = (np.take_along_axis(v, top, 1) for v in wide)
        frontier = np.unique(np.concatenate(met))
        found = [frontier]
        while len(frontier):
            nodes = frontier % n
            pieces = np.cumsum(at[nodes + 1] - at[nodes]) >> 20
            reached = []
            for piece in np.split(frontier, np.flatnonzero(np.diff(pieces)) + 1):
                owner, node = _expand(at, flat, piece % n)
                q = (piece // n)[owner]
                fresh = ~seen[q, node]
                codes = np.unique(q[fresh] * n + node[fresh])
                q, node = codes // n, codes % n
                seen[q, node] = True
                for i in range(0, len(codes), 65536):
                    some = slice(i, i + 65536)
                    reached.append(codes[some][np.einsum("ij,ij->i", x[low + q[some]], x[node[some]]) >= near])
            frontier = np.concatenate([*reached, np.zeros(0, np.int64)])
            found.append(frontier)
        q, node = np.divmod(np.concatenate(found), n)
        q += low
        out.append((np.minimum(q, node) * n + np.maximum(q, node))[q != node])
    return np.unique(np.concatenate([*out, np.zeros(0, np.int64)]))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, unit) of (vec_id, label, v): vectors over their norm, after division by their largest component; null for those that link with nothing."""
    for batch in batches:
        label, v = batch.column(1), batch.column(2)
        flat, sizes = v.flatten(), pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        x = flat.to_numpy(zero_copy_only=False).astype(float)  # null is NaN
        fine = np.flatnonzero(sizes > 0)
        starts = (np.cumsum(sizes) - sizes)[fine]
        unit, usable = np.zeros(0), np.zeros(len(sizes), bool)
        if len(fine):
            with np.errstate(all="ignore"):
                largest = np.maximum.reduceat(np.abs(x), starts)
                usable[fine] = np.isfinite(largest) & (largest > 0)
                scaled = x / np.repeat(largest, sizes[fine])
                norm = np.sqrt(np.add.reduceat(scaled * scaled, starts))
                unit = scaled / np.repeat(norm, sizes[fine]) + 0.0  # no negative zeros
        usable &= ~np.asarray(label.is_null())
        kept = np.repeat(usable, sizes)
        ends = np.concatenate([[0], np.cumsum(np.where(usable, sizes, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(unit[kept[: len(unit)]]), mask=pa.array(~usable))
        yield pa.RecordBatch.from_arrays([batch.column(0), label, lists], names=["vec_id", "label", "unit"])


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows, filled up with -1."""
    lists = [v or [] for v in column.to_pylist()]
    out = np.full((len(lists), max(1, *map(len, lists))), -1, np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def _first(a: np.ndarray, b: np.ndarray, members: np.ndarray, guests: np.ndarray) -> np.ndarray:
    """The first shard that can find each pair: one of the two is a member, and the other a member or guest."""
    out = np.empty(len(a), np.int64)
    every = np.concatenate([members, guests], 1)
    step = max(1, (1 << 22) // (members.shape[1] * every.shape[1]))
    for i in range(0, len(a), step):
        firsts = []
        for p, q in ((a[i : i + step], b[i : i + step]), (b[i : i + step], a[i : i + step])):
            own = members[p]
            there = (own[:, :, None] == every[q][:, None, :]).any(2) & (own >= 0)
            firsts.append(np.where(there, own, np.iinfo(np.int64).max).min(1))
        out[i : i + step] = np.minimum(*firsts)
    return out


def _shard(rows: pa.Table, least: float) -> pa.Table:
    """Links in one shard: a row for each member and guest with its numbers of linked rows and classes, and the least linked class."""
    rows = rows.sort_by([("member", "descending"), ("cls", "ascending")])
    x, n, members = _vectors(rows["unit"]), len(rows), int(np.sum(rows["member"].to_numpy(zero_copy_only=False)))
    ids, size, shard = rows["cls"].to_numpy(), rows["size"].to_numpy(), rows["shard"][0].as_py()
    # edges within the shard and its guests; they count both ways: among equally near vectors some are nobody's nearest
    links = rows["links"].combine_chunks()
    tail, edge = np.repeat(np.arange(n), np.diff(links.offsets.to_numpy())), links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(ids)
    head = order[np.minimum(np.searchsorted(ids, edge, sorter=order), n - 1)]
    there = ids[head] == edge
    tail, head = tail[there], head[there]
    tail, head = np.divmod(np.unique(np.concatenate([tail * n + head, head * n + tail])), n)
    a, b = np.divmod(search(x.astype(np.float32), np.split(head, np.searchsorted(tail, np.arange(1, n))), least, members), n)
    exact = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) >= least for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
    a, b = a[exact], b[exact]
    first = _first(a, b, _padded(rows["shards"]), _padded(rows["guests"])) == shard
    top = ids.copy()
    # a spanning forest: least reachable class by repeated minima
    place = {int(c): i for i, c in enumerate(ids)}
    while True:
        before = top.copy()
        np.minimum.at(top, a, top[b])
        np.minimum.at(top, b, top[a])
        top = np.minimum(top, top[[place[int(c)] for c in top]])
        if (top == before).all():
            break
    a, b = a[first], b[first]
    linked = np.bincount(a, size[b], minlength=n) + np.bincount(b, size[a], minlength=n)
    distinct = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    return pa.table({"cls": ids, "n": linked.astype(np.int64), "m": distinct.astype(np.int64), "head": top})


KEYS = ["label", "dim", "shard"]


def shards(classes: DataFrame, overlap: int = 3, shard: int = SHARD, salt: int = 1, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(label, dim, shard, cls, unit, size), a row for each shard of each class; a shard's number tells the pivots on its way."""
    cells = saved(classes.select("label", "dim", F.lit(0).cast("long").alias("shard"), "cls", "unit", "size"))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    for level in range(5):
        big = cells.groupBy(*KEYS).agg(F.count("*").alias("cell")).where(F.col("cell") > 2 * shard)
        # a piece has four times as many rows as the cell has pivots, PIECE at least
        drawn = F.least(F.col("cell") * F.lit(4.0 / shard), F.lit(float(most_pivots)))
        big = saved(big.select(*KEYS, "cell", F.ceil(F.col("cell") / F.greatest(F.lit(float(PIECE)), 4 * drawn)).alias("pieces")))
        if big.isEmpty():
            break
        crowd = cells.join(big, KEYS)
        draw = F.pmod(F.xxhash64("cls", "shard", F.lit(salt), F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        pivots = crowd.where(draw < F.least(F.lit(4.0 / shard), most_pivots / F.col("cell"))).select(*[F.col(c).alias(c) for c in KEYS], F.col("unit").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        dealt = crowd.select(*[F.col(c).alias(c) for c in cells.columns], F.pmod(F.xxhash64("cls", F.lit(salt)), F.col("pieces")).alias("piece"))

        def split(key: tuple, rows: pa.Table, near: pa.Table) -> pa.Table:
            rows = rows.drop(["piece"])
            if len(near) < 2 or not len(rows):
                return rows
            p = _vectors(near["pivot"])
            p = p[np.lexsort(p.T)]  # in one order for all pieces of a cell
            x, k = _vectors(rows["unit"]), min(overlap, len(p))  # noqa: B023
            best = np.argpartition(-(x @ p.T), k - 1, axis=1)[:, :k]
            out = rows.take(pa.array(np.repeat(np.arange(len(x)), k)))
            own = out["shard"].to_numpy() * (2 * most_pivots) + 1 + best.ravel()
            return out.set_column(out.column_names.index("shard"), "shard", pa.array(own, pa.int64()))

        parted = dealt.groupBy(*KEYS, "piece").cogroup(pivots.groupBy(*KEYS, "piece")).applyInArrow(split, columns)
        cells = saved(cells.join(big.select(*KEYS), KEYS, "left_anti").select(*cells.columns).unionAll(parted))
    return cells


def links(classes: DataFrame, least: float = 0.98, overlap: int = 3, shard: int = SHARD, salt: int = 1, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(cls, n, m, head) from every shard of every class; classes(cls, label, dim, unit, size) has distinct vectors."""
    each = shards(classes, overlap, shard, salt, most_pivots)
    # a vector between two linked ones is at most twice their angle from either
    close = 2 * least * least - 1 - 1e-4

    def graph(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cls")
        adjacency, cosine = build(_vectors(rows["unit"]).astype(np.float32))
        ids = rows["cls"].to_numpy()
        lists = [pa.array([ids[a[kept]] for a, kept in zip(adjacency, k, strict=True)], pa.list_(pa.int64())) for k in (adjacency >= 0, (adjacency >= 0) & (cosine >= close))]
        return pa.table({"cls": rows["cls"], "shard": rows["shard"], "links": lists[0], "close": lists[1]})

    edges = each.groupBy(*KEYS).applyInArrow(graph, "cls long, shard long, links array<long>, close array<long>")
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    united = saved(edges.groupBy("cls").agg(union("links"), union("close"), F.collect_list("shard").alias("shards")))
    # (a label's classes have cells of their own, and edges stay within a label)
    called = each.select(*KEYS, "cls").join(united.where(F.size("close") > 0).select("cls", "close"), "cls").select(*KEYS, F.explode("close").alias("cls")).distinct()
    guests = saved(called.join(each.select(*KEYS, "cls"), [*KEYS, "cls"], "left_anti"))
    homes = guests.groupBy("cls").agg(F.collect_set("shard").alias("guests"))
    about = united.select("cls", "links", "shards").join(homes, "cls", "left")
    members = each.withColumn("member", F.lit(True))
    more = guests.join(classes.select("cls", "unit", "size"), "cls").select(*each.columns, F.lit(False).alias("member"))
    return members.unionAll(more).join(about, "cls").groupBy(*KEYS).applyInArrow(lambda rows: _shard(rows, least), "cls long, n long, m long, head long")


def audit(classes: DataFrame, counts: DataFrame, least: float = 0.98, most: int = AUDITED) -> tuple[int, int]:
    """(links found, links there) of hash-drawn samples of at most `most` classes each, of all and of those with links, against all classes by brute force in blocks."""
    by_hash = lambda df: df.orderBy(F.xxhash64("cls", F.lit(9)), "cls").limit(most).select("cls")
    chosen = by_hash(classes).unionAll(by_hash(counts.where("m > 0"))).distinct()
    sample = classes.join(F.broadcast(chosen), "cls").select("cls", "label", "dim", "unit").collect()
    by = {}
    for r in sample:
        by.setdefault((r.label, r.dim), []).append(r)
    queries = {k: (np.array([r.cls for r in v]), np.array([r.unit for r in v])) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in batch.to_pandas().groupby(["label", "dim"]):
                if key in queries:
                    ids, q = queries[key]
                    hit = (np.array(own.unit.tolist()) @ q.T >= least) & (own.cls.to_numpy()[:, None] != ids[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.sum(0))], names=["cls", "there"])

    there = classes.mapInArrow(run, "cls long, there long").groupBy("cls").agg(F.sum("there").alias("there"))
    return tuple(there.join(counts, "cls", "left").agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("there"), F.lit(0))).first())


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, overlap: int = 2, recall: float = 0.9, shard: int = SHARD, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    rows = rows.mapInArrow(_units, f"vec_id {ids}, label {labels}, unit array<double>")
    for seed in range(9):
        keyed = saved(rows.withColumn("cls", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit", F.lit(seed)))))
        one = [F.min("vec_id").alias("least"), F.count("*").alias("size"), *[f(c).alias(f"{n}_{c}") for c in ("label", "unit") for f, n in ((F.min, "low"), (F.max, "high"))]]
        then = [F.min("least").alias("least"), F.sum("size").alias("size"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("label", "unit") for f, n in ((F.min, "low"), (F.max, "high"))]]
        classes = saved(grouped(keyed.where("cls is not null"), ["cls"], one, then))
        if classes.where("low_label <> high_label or low_unit <> high_unit").isEmpty():
            break  # no hash stands for two vectors
    classes = saved(classes.select("cls", F.col("low_label").alias("label"), F.size("low_unit").alias("dim"), F.col("low_unit").alias("unit"), "size", "least"))
    own = classes.drop("least")
    for salt in range(1, 4):
        found = saved(links(own, least, overlap, shard, salt, most_pivots))
        counts = saved(found.groupBy("cls").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
        got, there = audit(own, counts, least)
        if got >= recall * there:
            break
        overlap *= 2
    else:
        raise RuntimeError(f"the index found {got} of {there} audited links; raise overlap or shard")
    ends = saved(components(found.where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))))
    heads = grouped(classes.join(ends, classes.cls == ends.node), ["component"], [F.min("least").alias("linked")], [F.min("linked").alias("linked")])
    linked = looked_up(ends, heads.withColumn("n", F.lit(1)), "component").select(F.col("node").alias("cls"), "linked")
    known = classes.join(counts, "cls", "left").join(linked, "cls", "left").select("cls", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("linked", "least").alias("component_id"))
    out = looked_up(keyed, known, "cls", "size").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
