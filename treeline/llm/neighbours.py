"""Nearest neighbours by cosine as a block matrix join over int8 tiles.

Equal vectors are one class, which carries its k + 1 smallest identifiers: no other member can be among the k nearest of any
query. Classes are dealt into groups by hash and packed into blocks, each a matrix of unit vectors rounded to 8 bits, with
each row's step, size and rounding error, and the vectors themselves. Blocks of queries meet blocks of candidates in tiles,
one task a pair of groups: a group of queries is held, and blocks of candidates stream by.

With u = s p + e for a query and v = t q + f for a candidate, u v lies within |s p| |f| + |e| (|t q| + |f|) of s t (p q). The
products p q of a tile are one matrix product of whole numbers, which is exact; that bound makes them upper and lower
bounds. Pairs whose upper bound is below the query's kth score so far, or below the kth lower bound of the tile, are out; what
survives is computed anew from the vectors in double precision, and each query's heap keeps the best. The heaps of all tiles
are merged in order. So the search is exact: nothing is missed at any setting.

A vector takes part if it has no null or non-finite component and its sum of squares is finite and above zero; shorter
vectors count as padded with zeros. Rows without an identifier take no part. An identifier counts once, with the first of
its vectors in order of their bytes, and is never its own neighbour. Ties go to the smaller identifier. An empty table gives
an empty result. Columns besides the id and the vector are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from treeline.llm._common import discard, lookup, materialise, one_thread, table, trimmed


def packed(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, type]:
    """id and v, the bytes of each vector that takes part, and what they are."""
    kind = df.schema[vector_col].dataType
    dtype = np.float32 if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)  # no -0.0, so equal vectors have equal bytes
                with np.errstate(over="ignore", invalid="ignore"):
                    size = float((x.astype(np.float64) ** 2).sum())
                if np.isfinite(size) and size > 0:
                    ids.append(i)
                    out.append(x[: np.flatnonzero(x)[-1] + 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    return df.select(id_col, vector_col).mapInArrow(run, "id bigint, v binary"), dtype


class Block:
    """Some classes as matrices: rows (their smallest identifiers, names), ids (k + 1, -1 beyond), whole (vectors), tile
    (rounded unit vectors), and each row's step, size |s p| and error |e|."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        self.ids, self.whole = ids, whole
        self.squares = (self.whole.astype(np.float64) ** 2).cumsum(1)[:, -1]
        unit = whole / np.sqrt(self.squares)[:, None]
        self.step = np.abs(unit).max(1) / 127
        self.tile = np.rint(unit / self.step[:, None]).astype(np.int8)
        rounded = self.tile * self.step[:, None]
        self.size, self.error = np.sqrt((rounded**2).sum(1)), np.sqrt(((unit - rounded) ** 2).sum(1))

    @staticmethod
    def pack(ids: list[list[int]], vectors: list[bytes], width: int, dims: int, dtype: type) -> bytes:
        """The identifiers and vectors of a block, as bytes."""
        own = np.full((len(ids), width), -1, np.int64)
        for k, some in enumerate(ids):
            own[k, : len(some)] = some
        whole = np.zeros((len(ids), dims), dtype)
        for k, v in enumerate(vectors):
            x = np.frombuffer(v, dtype)
            whole[k, : len(x)] = x
        return own.tobytes() + whole.tobytes()

    @classmethod
    def unpack(cls, data: bytes, n: int, width: int, dtype: type) -> Block:
        cut = 8 * n * width
        return cls(np.frombuffer(data[:cut], np.int64).reshape(n, width), np.frombuffer(data[cut:], dtype).reshape(n, -1).astype(np.float64))


class Tiles:
    """Blocks of queries against blocks of candidates. pairs and kept: how many there were, and survived the bounds."""

    #: More than what single precision and the rounding of scores are off by.
    MARGIN = 1e-5

    def __init__(self, k: int):
        self.k, self.queries = k, []
        self.heaps: list[list[list[tuple[float, int]]]] = []
        self.least: list[np.ndarray] = []
        self.pairs = self.kept = 0

    def add(self, block: Block) -> None:
        self.queries.append(block)
        self.heaps.append([[] for _ in block.ids])
        self.least.append(np.full(len(block.ids), -np.inf))

    def meet(self, block: Block) -> None:
        exact = np.float32 if block.tile.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products are whole numbers
        candidates = block.tile.astype(exact).T
        for query, heaps, least in zip(self.queries, self.heaps, self.least, strict=True):
            product = query.tile.astype(exact) @ candidates
            open_ = np.flatnonzero(least == -np.inf)
            floor = least.copy()
            if len(open_) and product.shape[1] >= self.k:
                low = product[open_] * np.outer(query.step[open_], block.step) - self._error(query, block, open_)
                floor[open_] = np.partition(low, -self.k, 1)[:, -self.k]
            floor = np.maximum(floor, -2.0)
            need = np.outer((floor - self.MARGIN) / query.step, 1 / block.step)
            need -= self._error(query, block, slice(None)) / np.outer(query.step, block.step)
            rows, columns = np.nonzero(product >= need)
            self.pairs += product.size
            self.kept += len(rows)
            self._push(query, block, heaps, least, rows, columns)

    def _error(self, query: Block, block: Block, some: np.ndarray | slice) -> np.ndarray:
        return np.outer(query.size[some], block.error) + np.outer(query.error[some], block.size + block.error)

    def _push(self, query: Block, block: Block, heaps: list, least: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        k = self.k
        for lo in range(0, len(rows), 16384):
            r, c = rows[lo : lo + 16384], columns[lo : lo + 16384]
            dots = (query.whole[r] * block.whole[c]).cumsum(1)[:, -1]  # in order, as a plain loop adds
            scores = np.clip(dots / np.sqrt(query.squares[r] * block.squares[c]), -1.0, 1.0)
            ok = np.flatnonzero(scores >= least[r])
            ids = block.ids[c[ok]].tolist()
            for row, score, some in zip(r[ok].tolist(), scores[ok].tolist(), ids, strict=True):
                heap = heaps[row]
                for i in some:
                    if i < 0:
                        break
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -i))
                    elif (score, -i) > heap[0]:
                        heapq.heapreplace(heap, (score, -i))
                    else:
                        break
                if len(heap) == k:
                    least[row] = heap[0][0]

    def best(self) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """Each query's name and its best pairs (-score, identifier), in order."""
        for query, heaps in zip(self.queries, self.heaps, strict=True):
            for name, heap in zip(query.ids[:, 0].tolist(), heaps, strict=True):
                yield name, sorted((-s, -i) for s, i in heap)


_BEST = "name bigint, scores array<double>, ids array<bigint>"


def _best_rows(rows: list[tuple[int, list[tuple[float, int]]]]) -> pa.RecordBatch:
    columns = [pa.array([n for n, _ in rows], pa.int64()), pa.array([[-s for s, _ in b] for _, b in rows], pa.list_(pa.float64())), pa.array([[i for _, i in b] for _, b in rows], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["name", "scores", "ids"])


def blocks(classes: DataFrame, groups: int, width: int, dims: int, dtype: type, rows: int) -> DataFrame:
    """classes (v, ids) packed by group: grp, n and data, at most so many rows a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors = None, [], []

        def out() -> pa.RecordBatch:
            data = [Block.pack(ids, vectors, width, dims, dtype)] if ids else []
            batch = pa.RecordBatch.from_arrays([pa.array([group] * len(data), pa.int32()), pa.array([len(ids)] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["grp", "n", "data"])
            ids.clear()
            vectors.clear()
            return batch

        for batch in batches:
            for g, some, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group or len(ids) == rows:
                    yield out()
                    group = g
                ids.append(some)
                vectors.append(v)
        yield out()

    dealt = classes.select(F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int").alias("grp"), "ids", "v")
    return dealt.repartitionById(groups, F.col("grp")).sortWithinPartitions("grp").mapInArrow(trimmed(run), "grp int, n int, data binary")


def tiles(queries: DataFrame, candidates: DataFrame, rows: int, columns: int, k: int, dtype: type) -> DataFrame:
    """The best of every pair of a group of queries (of `rows`) and one of candidates (of `columns`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        tile, own = None, Tiles(k)
        for batch in batches:
            for at, side, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != tile:
                    yield _best_rows(list(own.best()))
                    tile, own = at, Tiles(k)
                block = Block.unpack(data, n, k, dtype)
                own.meet(block) if side else own.add(block)
        yield _best_rows(list(own.best()))

    own = queries.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).select((F.col("grp") * columns + F.col("to")).alias("at"), F.lit(0).alias("side"), "n", "data")
    other = candidates.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select((F.col("to") * columns + F.col("grp")).alias("at"), F.lit(1).alias("side"), "n", "data")
    dealt = own.unionByName(other).repartitionById(rows * columns, F.col("at")).sortWithinPartitions("at", "side")
    return dealt.mapInArrow(trimmed(run), _BEST)


def merged(rows: DataFrame, k: int) -> DataFrame:
    """The k best of all rows of each name, by a heap over their heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, lists, out = None, [], []
        for batch in batches:
            for n, scores, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n != name:
                    if lists:
                        out.append((name, list(itertools.islice(heapq.merge(*lists), k))))
                    name, lists = n, []
                lists.append([(-s, i) for s, i in zip(scores, ids, strict=True)])
                if len(lists) == 256:  # so that a name's lists stay few
                    lists = [list(itertools.islice(heapq.merge(*lists), k))]
            yield _best_rows(out)
            out = []
        yield _best_rows([(name, list(itertools.islice(heapq.merge(*lists), k)))] if lists else [])

    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(run, _BEST)


def nearest(df: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 1024, query_rows: int = 32768, group_rows: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose identifier `every` divides, against all rows."""
    spark = df.sparkSession
    rows, dtype = packed(df, id_col, vector_col)
    own = materialise(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    asked = F.pmod(F.col("id"), F.lit(every)) == 0
    first = Window.partitionBy("v", "asked").orderBy("id")  # cut inside tasks before it is dealt
    few = own.withColumn("asked", asked).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    classes = materialise(few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked")), "classes")
    found = classes.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q"), F.max(F.length("v")).alias("size")).first()
    if not found.q:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, tasks = found.size // np.dtype(dtype).itemsize, spark.sparkContext.defaultParallelism
    own_groups = -(-found.q // query_rows)
    groups = max(-(-found.n // group_rows), min(-(-tasks // own_groups), -(-found.n // block_rows)))
    queries = materialise(blocks(classes.where("asked"), own_groups, k + 1, dims, dtype, block_rows), "query-blocks")
    candidates = materialise(blocks(classes, groups, k + 1, dims, dtype, block_rows), "blocks")
    best = materialise(merged(tiles(queries, candidates, own_groups, groups, k + 1, dtype), k + 1), "best")
    counts = own.where(asked).groupBy("v").agg(F.count(F.lit(1)).alias("times"))
    names = classes.where("asked").select("v", F.element_at("ids", 1).alias("name"))
    per_class = materialise(names.join(best, "name").join(counts, "v").select("v", "times", F.arrays_zip("scores", "ids").alias("near")), "per-class")
    discard(queries, candidates, best)
    out = lookup(own.where(asked), per_class, ["v"], "times")
    others = F.slice(F.filter("near", lambda x: x["ids"] != F.col("id")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.ids").alias("vec_id"), F.col("one.scores").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 5, 50)


SQL = {
    "op11_neighbours": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from p qualify rank <= 5"""
}
