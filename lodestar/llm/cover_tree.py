"""Embedding near-dedup by cover trees and their dual traversal.

Vectors are compared within a label by cosine; on the unit sphere cosine >= c means a distance of at most
r = sqrt(2 - 2 c). Equal vectors of a label are one, with a weight, from the start; their ids are joined to it at the end.
The top of each label's cover tree comes from a bounded sample of vectors (`sample`, a parameter); the
nodes of one of its levels, the one that costs least, cut space into cells (a single one, where vectors lie so far apart
from each other that cells would only repeat them).
Every vector goes to the cell of its nearest node; the farthest one in it gives the node's covering radius. Two cells whose
covering balls are farther apart than r have nothing to do with each other. In the others, a vector is a guest if one within
r of it may have its home there. A pair is counted for each of the two in its own home cell.

A cell with more than `block` vectors is dealt in blocks and each pair of blocks is a task, so no task has more than two
blocks. Within a task, cover trees (nested levels, radii halved from level to level, every vector within the level's
radius of its node) are built for both sides, and pairs of nodes are traversed together: a pair whose covering balls are
farther apart than r falls, a pair whose balls lie within r of each other altogether is linked without going on, others
are refined; at the leaves vectors are compared by the cosine itself in double precision.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite numbers, or has no label, links with
nothing; vectors of different lengths don't link; a row with a null id takes no part and has null results; rows that repeat
an id are vectors of their own, and the id has all their links together; an empty table gives an empty result; vectors may
be of any length (a task holds two blocks of them); other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import components, cut, map_arrow, stars, table
from lodestar.llm.native import small

TINY = 1e-6  # rows closer than this are not told apart by distance


class Tree:
    """Levels of nodes over the rows of x. Level 0 is one node; each level's nodes are rows at least its radius apart,
    among them all nodes of the level before."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.x, self.leaf = x, leaf
        rows = np.arange(len(x))
        far = float(np.sqrt(np.maximum(0, 2 - 2 * x @ x[0])).max()) if len(x) else 0.0
        #: center, rows below, covering radius, children
        self.nodes: list[tuple[int, np.ndarray, float, list[int]]] = []
        if len(x):
            self._build(rows, 0, far, far / 2)

    def _build(self, rows: np.ndarray, center: int, radius: float, step: float) -> int:
        me = len(self.nodes)
        children: list[int] = []
        self.nodes.append((center, rows, radius, children))
        if len(rows) <= self.leaf or radius <= TINY:
            return me
        while step > radius:
            step /= 2
        # Centers of the next level: rows farther than step from all centers so far; the node's own center is the first.
        owner = np.zeros(len(rows), np.int64)
        near = _distance(self.x[rows], self.x[center])
        centers = [center]
        while near.max() > step:
            i = int(near.argmax())
            d = _distance(self.x[rows], self.x[rows[i]])
            owner[d < near] = len(centers)
            near = np.minimum(near, d)
            centers.append(int(rows[i]))
            if len(centers) * self.leaf > 2 * len(rows):
                break  # rows lie apart from each other: they are leaves of their own
        if len(centers) == 1:
            if step <= TINY:
                return me
            return self._again(me, rows, center, float(near.max()), step / 2)
        for k, c in enumerate(centers):
            part = owner == k
            if part.any():
                children.append(self._build(rows[part], c, float(near[part].max()), step / 2))
        return me

    def _again(self, me: int, rows: np.ndarray, center: int, radius: float, step: float) -> int:
        child = self._build(rows, center, radius, step)
        self.nodes[me][3].append(child)
        return me


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y)))


def dual(left: Tree, right: Tree, radius: float, cosine: float, links: np.ndarray, sides: np.ndarray, join, weigh: np.ndarray, other: np.ndarray) -> None:
    """Traverse both trees. links, sides: summed weights of partners by row of left and right (one array for one tree);
    join(i, j) tells that row i of left and row j of right are connected; weigh, other: weights of left's and right's rows."""
    if not left.nodes or not right.nodes:
        return
    same = left is right
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        pc, prows, pr, pch = left.nodes[p]
        qc, qrows, qr, qch = right.nodes[q]
        if same and p == q:
            if 2 * pr < radius - 1e-7:
                links[prows] += weigh[prows].sum() - weigh[prows]
                join(prows, np.full(len(prows), pc))
            elif not pch:
                _leaf(left, right, prows, prows, cosine, links, links, join, weigh, other, True)
            else:
                stack += [(a, b) for i, a in enumerate(pch) for b in pch[i:]]
            continue
        gap = float(_distance(left.x[pc][None], right.x[qc])[0])
        if gap - pr - qr > radius + 1e-7:
            continue
        if gap + pr + qr < radius - 1e-7:
            links[prows] += other[qrows].sum()
            (links if same else sides)[qrows] += weigh[prows].sum()
            join(prows, np.full(len(prows), qc))
            join(np.full(len(qrows), pc), qrows)
            continue
        if not pch and not qch:
            _leaf(left, right, prows, qrows, cosine, links, links if same else sides, join, weigh, other, False)
        elif not qch or (pch and pr >= qr):
            stack += [(a, q) for a in pch]
        else:
            stack += [(p, b) for b in qch]


def _leaf(left, right, prows, qrows, cosine, links, sides, join, weigh, other, one: bool) -> None:
    hit = left.x[prows] @ right.x[qrows].T >= cosine
    if one:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    if not len(i):
        return
    np.add.at(links, prows[i], other[qrows[j]])
    if not one:
        np.add.at(sides, qrows[j], weigh[prows[i]])
    join(prows[i], qrows[j])


def _units(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, x array<double>, same) of the rows that can link; x of length 1, label with the number of components, same
    a digest of x."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.column("id").to_numpy(zero_copy_only=False), np.array(batch.column("label").to_pylist(), object), batch.column("x")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)  # a null component becomes NaN
            size = np.diff(offsets)
            for dim in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == dim)
                x = values[offsets[at][:, None] + np.arange(dim)]
                top = np.abs(x).max(axis=1)
                good = np.isfinite(x).all(axis=1) & (top > 0)
                # Scaled by the largest component first, so that squares neither overflow nor vanish.
                x = x[good] / top[good][:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][good]), pa.array([f"{t}/{dim}" for t in labels[at][good]], pa.string()), _lists(x), pa.array([hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x], pa.binary())], ["id", "label", "x", "same"])

    return map_arrow(rows, clean, "id long, label string, x array<double>, same binary")


def _lists(x: np.ndarray) -> pa.Array:
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.ravel()))


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(rows, -1)


def _reach(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, rows x cells: whether a vector within radius of the row may have its home there)."""
    d = 2.0 - 2.0 * (x @ p.T)
    home = d.argmin(axis=1)
    near = d[np.arange(len(x)), home]
    # A partner has its home at p only if p is nearer to it than this home is: by distance from the plane between them.
    between = np.sqrt(np.maximum(1e-300, 2.0 - 2.0 * np.minimum(1.0, p @ p.T)))[home]
    reach = (d - near[:, None]) / (2 * between) <= radius + 1e-7
    reach[np.arange(len(x)), home] = True
    return home, reach


def _pivots(units: DataFrame, sample: int, most: int, radius: float) -> dict[str, np.ndarray]:
    """For each label, the nodes of that level of its tree's top whose cells cost least.

    The tree is one of a sample of about `sample` vectors: farthest points first, so that each level's nodes, with radii
    halved from level to level, begin the next one's. With p cells in which a vector is g times, the work is as g * g / p.
    """
    total = units.count()
    if not total:
        return {}
    mod = 1 << 30
    chosen = units.where(F.pmod(F.xxhash64("id"), F.lit(mod)) < int(min(1.0, sample / total) * mod)).select("id", "label", "x").orderBy("id").limit(2 * sample).toPandas()
    out = {}
    for label, rows in chosen.groupby("label"):
        x = np.stack(rows["x"].to_numpy())
        centers, apart, near = [0], [2.0], _distance(x, x[0])
        while near.max() > radius and len(centers) < most:
            centers.append(int(near.argmax()))
            apart.append(float(near.max()))
            near = np.minimum(near, _distance(x, x[centers[-1]]))
        best, level = 1.0, 1
        for n in sorted({sum(a > 2.0 / 2**k for a in apart) for k in range(1, 12)} | {len(centers)}):
            if n > 1:
                g = _reach(x, x[centers[:n]], radius)[1].sum() / len(x)
                if g * g / n < 0.9 * best:
                    best, level = g * g / n, n
        out[label] = x[centers[:level]]
    return out


def _apart(units: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> dict[str, np.ndarray]:
    """For each label that has several cells, which pairs of them the covering radii of all rows keep apart."""
    some = {k: p for k, p in pivots.items() if len(p) > 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = {k: np.zeros(len(p)) for k, p in some.items()}
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            for k in set(labels) & set(some):
                x = _matrix(batch.column("x").filter(pa.array(labels == k)), int((labels == k).sum()))
                d = 2.0 - 2.0 * (x @ some[k].T)
                # Rounding may choose another of two nodes that are equally near: the row counts for both.
                i, c = np.nonzero(d <= d.min(axis=1)[:, None] + 1e-9)
                np.maximum.at(far[k], c, np.sqrt(np.maximum(0.0, d[i, c])))
        rows = [{"label": k, "cell": c, "far": float(v)} for k, f in far.items() for c, v in enumerate(f)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.string()), ("cell", pa.int32()), ("far", pa.float64())]))

    out = {}
    if some:
        far = {k: np.zeros(len(p)) for k, p in some.items()}
        # As many rows as the sample has nodes, at most.
        for label, cell, value in map_arrow(units.select("label", "x"), run, "label string, cell int, far double").groupBy("label", "cell").agg(F.max("far")).collect():
            far[label][cell] = value
        for k, p in some.items():
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T)))
            out[k] = gap - far[k][:, None] - far[k][None, :] > radius + 1e-7
    return out


def links(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, sample: int = 4096, most: int = 64, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """((id, n) partners of each id, (a, b) connections) of all vectors."""
    radius = float(np.sqrt(2 - 2 * cosine))
    rows = cut(_units(df, id_col, vec_col, label_col))
    # Equal vectors are one: `id` is a number of its own from here on, `lead` the least id.
    units = rows.groupBy("label", "same").agg(F.first("x").alias("x"), F.min("id").alias("lead"), F.count(F.lit(1)).alias("w"))
    units = cut(units.withColumn("id", F.monotonically_increasing_id()))
    pivots = _pivots(units, sample, most, radius)
    apart = _apart(units, pivots, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            for label in sorted(set(labels)):
                part = batch.filter(pa.array(labels == label))
                x = _matrix(part.column("x"), part.num_rows)
                home, reach = _reach(x, pivots.get(label, x[:1]), radius)
                if label in apart:
                    reach &= ~apart[label][home]
                i, c = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(i), pa.string()), pa.array(c, pa.int32()), pa.array(home[i] == c), part.column("id").take(pa.array(i)), part.column("w").take(pa.array(i)), _lists(x[i])], schema=dealt)

    dealt = pa.schema([("label", pa.string()), ("cell", pa.int32()), ("home", pa.bool_()), ("id", pa.int64()), ("w", pa.int64()), ("x", pa.list_(pa.float64()))])
    cells = cut(map_arrow(units.select("label", "id", "w", "x"), deal, "label string, cell int, home boolean, id long, w long, x array<double>"))
    sizes = small(cut(cells.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))))
    cells = cells.join(sizes, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each vector is told to every pair of blocks that its own is in.
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    cells = cells.select("label", "cell", "home", "id", "w", "x", "own", F.explode(pair).alias("at")).select("label", "cell", "home", "id", "w", "x", "own", "at.i", "at.j")

    def meet(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, home, own, w = (t.column(c).to_numpy() for c in ("id", "home", "own", "w"))
        x = _matrix(pa.concat_arrays(t.column("x").chunks), len(ids))
        count = np.zeros(len(ids), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []

        def run(a: np.ndarray, b: np.ndarray | None) -> None:
            left = Tree(x[a])
            counts = np.zeros(len(a), np.int64)
            if b is None:
                dual(left, left, radius, cosine, counts, counts, lambda s, e: ends.append((ids[a[s]], ids[a[e]])), w[a], w[a])
            else:
                other = np.zeros(len(b), np.int64)
                dual(left, Tree(x[b]), radius, cosine, counts, other, lambda s, e: ends.append((ids[a[s]], ids[b[e]])), w[a], w[b])
                count[b] += other
            count[a] += counts

        # Vectors at home with each other, and with guests: guests with each other meet at the home of one of them.
        h, g = np.flatnonzero(home), np.flatnonzero(~home)
        if i == j:
            run(h, None)
            run(h, g)
        else:
            run(h[own[h] == i], h[own[h] == j])
            run(h[own[h] == i], g[own[g] == j])
            run(h[own[h] == j], g[own[g] == i])
        # A pair of homes in two cells is seen from both: only the home's own count is taken.
        count[g] = 0
        s = np.concatenate([e[0] for e in ends]) if ends else np.zeros(0, np.int64)
        e = np.concatenate([e[1] for e in ends]) if ends else np.zeros(0, np.int64)
        edge = np.unique(np.stack([np.minimum(s, e), np.maximum(s, e)], axis=1)[s != e], axis=0)
        edge = stars(edge)[:, ::-1]
        some = np.flatnonzero(count)
        return pa.table({"a": np.concatenate([ids[some], edge[:, 0]]), "b": np.concatenate([np.full(len(some), -1), edge[:, 1]]), "n": np.concatenate([count[some], np.zeros(len(edge), np.int64)]), "edge": np.concatenate([np.zeros(len(some), bool), np.ones(len(edge), bool)])})

    found = cut(cells.groupBy("label", "cell", "i", "j").applyInArrow(meet, "a long, b long, n long, edge boolean"))
    # From numbers back to ids: a vector has the weights of its partners and of its equals.
    lead = units.select("id", "lead")
    counts = units.select("id", "label", "same", "lead", "w").join(found.where("not edge").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), "id", "left")
    counts = cut(counts.select("label", "same", "lead", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n")))
    each = rows.select("id", "label", "same").join(small(counts), ["label", "same"])
    edges = found.where("edge").select("a", "b").join(lead.select(F.col("id").alias("a"), F.col("lead").alias("la")), "a").join(lead.select(F.col("id").alias("b"), F.col("lead").alias("lb")), "b")
    edges = edges.select(F.col("la").alias("a"), F.col("lb").alias("b")).unionByName(each.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")))
    return each.groupBy("id").agg(F.sum("n").alias("n")), edges


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", **how) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of df."""
    counts, edges = links(df, id_col=id_col, **how)
    rows = df.select(F.col(id_col).cast("long").alias("id"))
    rows = rows.join(counts, "id", "left").join(components(edges).withColumnRenamed("node", "id"), "id", "left")
    rows = rows.select("id", F.when(F.col("id").isNotNull(), F.coalesce("n", F.lit(0)).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return rows.withColumn("kept", F.col("id") == F.col("component_id"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE_SQL = r"""
with recursive v as (select vec_id, label, len(embedding) dim, cast(embedding as double[]) x from embeddings where vec_id is not null and label is not null and embedding is not null),
u as (select vec_id, label, dim, x from v where dim > 0 and list_sum(list_transform(x, lambda y: y * y)) > 0),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.dim = b.dim and a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id, vec_id root from embeddings union select l.b, r.root from r join l on r.vec_id = l.a)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept
from (select vec_id, min(root) component_id from r group by vec_id) left join (select a vec_id, count(*) n from l group by a) using (vec_id)
"""
