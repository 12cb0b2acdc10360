"""Exact top-k search by inner product with two cover trees walked together.

Vectors are quantised to floor(scale * x). Rows are dealt into cells by the nearest of a bounded number of pivots, and cells
of more than `block_rows` rows into blocks by a hash of the identifier. Each query first searches the block it lies in; its
kth score there bounds what is looked for, and it goes only to blocks whose pivot and covering radius allow such a score. A
task indexes its block in a cover tree and each stretch of queries in another, and walks them together: the data nodes that a
query node leaves pass to its children, opened where they are wider than it. A pair is pruned when the centres' product and
both covering radii bound all products below the group's worst kth score, or below what data nodes of enough rows are bound
to give every query of the group; in a leaf of queries, single ones are pruned likewise. The k best of all blocks are the
result.

Where nothing but single points lie near each other, as in random vectors of many dimensions, the levels of a tree are a
root and its single points, which are compared at once: then all products are computed. What can be pruned are groups of
vectors that lie close together.

Ties go to the smaller identifier. A row is never its own candidate: rows with the query's identifier are left out, and a
query row repeated entirely is one query; an identifier with several vectors is a query, and has a ranking, for each.
Vectors that are null or hold null or non-finite components (scaled ones too) take no part; shorter vectors count as padded
with zeros. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm._common import discard, materialise, one_thread, table, trimmed


class Node(NamedTuple):
    """A centre, the radius that covers all points below, all these points, and children (none: a leaf)."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[int]


class CoverTree:
    """Each node's children cover its points within a share of its radius; points that nothing else lies near are one leaf
    beside the others, and a node of few points has no children."""

    def __init__(self, points: np.ndarray, leaf: int = 64, shrink: float = 0.6):
        self.points, self.leaf, self.shrink = points, leaf, shrink
        self.sizes = np.sqrt((points**2).sum(1))
        self.nodes: list[Node] = []
        self.root = self._build(np.arange(len(points)), points[0])

    def _build(self, rows: np.ndarray, middle: np.ndarray, split: bool = True) -> int:
        radius = float(np.sqrt(((self.points[rows] - middle) ** 2).sum(1)).max())
        children = []
        if split and len(rows) > self.leaf and radius > 0:
            groups = self._cover(rows, radius * self.shrink)
            children = [self._build(g, self.points[g[0]]) for g in groups if len(g) > 1]
            single = [g[0] for g in groups if len(g) == 1]
            if single and children:
                children.append(self._build(np.array(single), middle, False))
        self.nodes.append(Node(middle, radius, rows, children))
        return len(self.nodes) - 1

    def _cover(self, rows: np.ndarray, reach: float, at_once: int = 64) -> list[np.ndarray]:
        """Groups of rows within reach of their first; the firsts are further from each other."""
        groups, free = [], rows
        while len(free):
            points, firsts = self.points[free], self.points[free[:at_once]]
            gaps = self.sizes[free[:at_once], None] ** 2 + self.sizes[free][None, :] ** 2 - 2 * (firsts @ points.T)
            near, left = gaps <= reach * reach, np.ones(len(free), bool)
            for i in range(len(firsts)):
                if left[i]:
                    members = near[i] & left
                    members[i] = False
                    left &= ~members
                    left[i] = False
                    groups.append(np.concatenate([free[i : i + 1], free[members]]))
            free = free[left]
        return groups


class Search:
    """The k best of the data tree's points for each query. computed and whole: products that were and that there are;
    pairs: pairs of nodes, or of a leaf's queries and a node, that were bounded."""

    def __init__(self, data: CoverTree, ids: np.ndarray, k: int):
        self.data, self.ids, self.k = data, ids, k
        self.centres, self.radii = np.array([n.centre for n in data.nodes]), np.array([n.radius for n in data.nodes])
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.counts = np.array([len(n.rows) for n in data.nodes])
        self.inner = np.array([bool(n.children) for n in data.nodes])
        self.enough = k + int(np.unique(ids, return_counts=True)[1].max())  # so many rows hold k of other identifiers
        self.computed = self.whole = self.pairs = 0

    def run(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and identifiers, best first; identifier -1 where there are too few. least: smaller scores are no use."""
        self.tree, self.query_ids = CoverTree(queries), query_ids
        self.best = np.full((len(queries), self.k), -np.inf)
        self.who = np.full((len(queries), self.k), -1, np.int64)
        self.floor = np.full(len(queries), -np.inf) if least is None else least.copy()
        self.whole += len(queries) * len(self.ids)
        self._walk(self.tree.root, np.array([self.data.root]))
        return self.best, self.who

    def _worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[rows, -1], self.floor[rows])

    def _bounds(self, node: Node, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No product of a point below the query node and one below a data node is larger, or smaller, than these."""
        self.pairs += len(front)
        middle = self.centres[front] @ node.centre
        slack = node.radius * self.norms[front] + self.radii[front] * (float(np.linalg.norm(node.centre)) + node.radius) + 0.5  # products are whole numbers
        return middle + slack, middle - slack

    def _kth(self, lower: np.ndarray, front: np.ndarray) -> float:
        """A score that k rows reach for every query of the group: data nodes in front hold different rows."""
        order = np.argsort(-lower)
        at = int(np.searchsorted(np.cumsum(self.counts[front][order]), self.enough))
        return float(lower[order[at]]) if at < len(order) else -np.inf

    def _walk(self, q: int, front: np.ndarray) -> None:
        """A query node against the data nodes that its parent left. Data nodes wider than it are opened, those pass to its
        children whose bound reaches the group's worst kth score."""
        node = self.tree.nodes[q]
        upper, lower = self._bounds(node, front)
        while True:
            least = max(float(self._worst(node.rows).min()), self._kth(lower, front))
            kept = upper >= least
            front, upper, lower = front[kept], upper[kept], lower[kept]
            wide = self.inner[front] & (self.radii[front] > node.radius)
            if not wide.any():
                break
            inside = np.concatenate([self.data.nodes[d].children for d in front[wide].tolist()])
            bounds = self._bounds(node, inside)
            front = np.concatenate([front[~wide], inside])
            upper, lower = (np.concatenate([x[~wide], y]) for x, y in zip((upper, lower), bounds, strict=True))
        if not len(front):
            return
        if node.children:
            for c in node.children:
                self._walk(c, front)
            return
        self.floor[node.rows] = np.maximum(self.floor[node.rows], least)
        for at in np.argsort(-upper, kind="stable").tolist():
            self._rows(node, node.rows, int(front[at]), float(upper[at]))

    def _rows(self, node: Node, rows: np.ndarray, d: int, upper: float) -> None:
        """Queries of a leaf against a data node, of whose products with the leaf none is above upper."""
        worst, data = self._worst(rows), self.data.nodes[d]
        if upper < worst.min():
            return
        rows = rows[self.tree.points[rows] @ data.centre + self.tree.sizes[rows] * data.radius + 0.5 >= worst]
        if not len(rows):
            return
        if not data.children:
            self._compare(rows, data.rows)
            return
        inside = np.array(data.children)
        upper_of = self._bounds(node, inside)[0]
        for at in np.argsort(-upper_of, kind="stable").tolist():
            self._rows(node, rows, int(inside[at]), float(upper_of[at]))

    def _compare(self, rows_q: np.ndarray, rows_d: np.ndarray) -> None:
        self.computed += len(rows_q) * len(rows_d)
        for lo in range(0, len(rows_d), 2048):
            some = rows_d[lo : lo + 2048]
            scores = self.tree.points[rows_q] @ self.data.points[some].T
            ids = self.ids[some]
            scores[self.query_ids[rows_q][:, None] == ids[None, :]] = -np.inf
            worst = self._worst(rows_q)
            for r in np.flatnonzero((scores >= worst[:, None]).any(1)).tolist():
                q = rows_q[r]
                ok = np.flatnonzero((scores[r] >= worst[r]) & (scores[r] > -np.inf))
                s, i = np.concatenate([self.best[q], scores[r][ok]]), np.concatenate([self.who[q], ids[ok]])
                top = np.lexsort((np.where(s == -np.inf, np.iinfo(np.int64).max, i), -s))[: self.k]
                self.best[q], self.who[q] = s[top], i[top]


def _stack(vectors: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for r, v in enumerate(vectors):
        x = np.frombuffer(v)
        out[r, : len(x)] = x
    return out


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v is None or i is None or None in v:
                    continue
                x = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    return df.select(id_col, vector_col).mapInArrow(run, "id bigint, v binary")


def celled(own: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """own (id, v) with the nearest pivot and the distance to it."""
    shared, sizes = own.sparkSession.sparkContext.broadcast(pivots), (pivots**2).sum(1)  # at most most_pivots vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            points = _stack(batch.column(1).to_pylist(), dims)
            gaps = np.maximum((points**2).sum(1)[:, None] + sizes[None, :] - 2 * (points @ shared.value.T), 0)
            cell = gaps.argmin(1)
            far = np.sqrt(((points - shared.value[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    return own.select("id", "v").mapInArrow(trimmed(run), "id bigint, v binary, cell int, far double")


def searched(data: DataFrame, queries: DataFrame, k: int, dims: int, parts: int, query_rows: int) -> DataFrame:
    """data: cell, sub, id, v. queries: cell, sub, id, v, least. The k best of each block for each of its queries, with the
    query's vector's hash (mark)."""
    both = data.select("cell", "sub", F.lit(0).alias("side"), "id", "v", F.lit(None).cast("double").alias("least"), F.lit(0).cast("bigint").alias("mark"))
    both = both.unionByName(queries.select("cell", "sub", F.lit(1).alias("side"), "id", "v", "least", F.xxhash64("v").alias("mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        block, search, points, asking = None, None, [], []

        def answer() -> pa.RecordBatch:
            nonlocal search
            if search is None and points and asking:
                search = Search(CoverTree(_stack([r[1] for r in points], dims)), np.array([r[0] for r in points]), k)
                points.clear()
            out: list[tuple[int, int, int, int]] = []
            if search is not None and asking:
                least = np.array([-np.inf if r[2] is None else r[2] for r in asking])
                best, who = search.run(_stack([r[1] for r in asking], dims), np.array([r[0] for r in asking]), least)
                for r, b, w in zip(asking, best.tolist(), who.tolist(), strict=True):
                    out += [(r[0], r[3], one, int(score)) for score, one in zip(b, w, strict=True) if score > -np.inf]
            asking.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["query_id", "mark", "vec_id", "score"])

        for batch in batches:
            for cell, sub, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, sub) != block:
                    yield answer()
                    block, search, points = (cell, sub), None, []
                (asking if side else points).append(row)
                if len(asking) >= query_rows:
                    yield answer()
        yield answer()

    dealt = both.repartition(parts, "cell", "sub").sortWithinPartitions("cell", "sub", "side", "id")
    return dealt.mapInArrow(trimmed(run), "query_id bigint, mark bigint, vec_id bigint, score bigint")


def reached(queries: DataFrame, pivots: np.ndarray, cells: dict[int, tuple[int, float]], dims: int) -> DataFrame:
    """queries: id, v, cell, sub (where they lie), least. A row for each other block that may hold a score of least or more.
    cells: blocks and covering radius of each cell."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, cells))  # at most most_pivots vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        pivots, cells = shared.value
        names = np.array(sorted(cells))
        counts, radii = np.array([cells[c][0] for c in names.tolist()]), np.array([cells[c][1] for c in names.tolist()])
        for batch in batches:
            home, sub = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            points = _stack(batch.column(1).to_pylist(), dims)
            least = np.array([-np.inf if x is None else x for x in batch.column(4).to_pylist()])
            bounds = points @ pivots[names].T + np.sqrt((points**2).sum(1))[:, None] * radii[None, :] + 0.5
            for lo in range(0, len(points), 256):
                row, col = np.nonzero(bounds[lo : lo + 256] >= least[lo : lo + 256, None])
                n = counts[col]
                row, cell = np.repeat(row + lo, n), np.repeat(names[col], n)
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ok = (cell != home[row]) | (part != sub[row])
                row, cell, part = row[ok], cell[ok], part[ok]
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(4), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["id", "v", "least", "cell", "sub"])

    return queries.select("id", "v", "cell", "sub", "least").mapInArrow(trimmed(run), "id bigint, v binary, least double, cell int, sub int")


def top_k(df: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int = 8192, query_rows: int = 1024, most_pivots: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose identifier `every` divides, against all rows. Scores are exact
    while the sum of the products' sizes is below 2**53."""
    spark = df.sparkSession
    own = materialise(quantised(df, id_col, vector_col, scale), "vectors")
    row = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v")).alias("d")).first()
    if not row.n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dims = max(1, (row.d or 0) // 8)
    wanted = min(most_pivots, max(4, 4 * -(-row.n // block_rows)))
    picked = own.orderBy(F.xxhash64("id", F.lit("pivot")), "id", "v").limit(wanted).collect()
    pivots = np.unique(_stack([bytes(r.v) for r in picked], dims), axis=0)
    placed = materialise(celled(own, pivots, dims), "placed")
    found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row for each pivot
    cells = {r.cell: (-(-r.n // block_rows), r.far * (1 + 1e-9) + 1e-6) for r in found}
    subs = F.create_map(*[F.lit(x) for c, (n, _) in sorted(cells.items()) for x in (c, n)])
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("id"), F.element_at(subs, F.col("cell"))).cast("int"))
    data = placed.select("cell", "sub", "id", "v")
    asked = placed.where(F.col("id") % every == 0).select("id", "v", "cell", "sub").dropDuplicates(["id", "v"])
    parts = max(sum(n for n, _ in cells.values()), spark.sparkContext.defaultParallelism)
    near = materialise(searched(data, asked.withColumn("least", F.lit(None).cast("double")), k, dims, parts, query_rows), "near")
    kth = near.groupBy(F.col("query_id").alias("id"), "mark").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
    asked = asked.withColumn("mark", F.xxhash64("v")).join(kth, ["id", "mark"], "left")
    far = materialise(searched(data, reached(asked, pivots, cells, dims), k, dims, parts, query_rows), "far")
    discard(own)
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    rows = near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), 5, 50)


SQL = {
    "op4_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from p qualify rank <= 5"""
}
