"""Near-dedup by min-max hashing, with every link confirmed on full shingle sets.

Each permutation gives two signature values, the minimum and the maximum over the document's shingles, so half the hash
evaluations give a signature of the same length, whose estimate is unbiased and of lower variance. `bands` bands of
`rows` values each name buckets; a pair at the threshold shares none with probability (1 - t**rows)**bands, one in a
million with the defaults at 0.75.

Documents with the same shingle set are one class from the start. In each bucket all classes are compared on full sets
with the smallest one; what is confirmed gives components. Only documents of buckets that still hold several components go
on: they get a second, longer signature, whose bands of twice as many rows split the buckets further (a pair at the
threshold shares none of these with probability 1.4e-6). Inside such a fine bucket the long signatures are compared, and
those documents that have one of another component near or over the threshold (five standard deviations below it; a pair
at the threshold is missed with probability 3e-7) get their texts and are compared on full sets there. So a row is a
document in a bucket or a link, never a pair: a large group of near copies costs a star and no cap drops a pair.

Words are hashed to 64 bits of XXH3 and shingles to 64 bits made of these; sets are compared as sets of
such hashes. Nulls and texts without words have an empty set, link with nothing and are their own component. A document of
fewer than `shingle` words has one shingle, the whole sequence. Rows repeated with the same identifier and text get the
same result; rows with the same identifier and other texts each get that of their own text's class, and a link of any of
the texts counts for the identifier; rows without an identifier are no documents. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._common import discard, lookup, materialise, mix, release, stretches, table, trimmed, windows, word_hashes
from treeline.llm.components import components


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for t in texts:
        words, _ = word_hashes([t.lower()])
        yield np.unique(windows(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


class MinMax:
    """bands * rows: an even number of signature values, of half as many permutations."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.a = (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.order = rng.permutation(bands * rows)  # a permutation's two values go to different bands

    def signature(self, sets: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 2**64 - 1, np.uint64)
        high = np.zeros(len(self.a), np.uint64)
        step = max(64, (1 << 17) // len(self.a))
        for i in range(0, len(sets), step):
            x = self.a[:, None] * sets[None, i : i + step]
            x += self.b[:, None]
            x ^= x >> np.uint64(29)
            low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
        return np.concatenate([low, high])[self.order]

    def buckets(self, sig: np.ndarray) -> np.ndarray:
        h = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in sig.reshape(self.bands, self.rows).T:
            h = mix(h ^ row)
        return h.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, size: int, minmax: MinMax) -> DataFrame:
    """id, n (size of the set), key (its digest) and buckets of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, texts in stretches(batch.column(1)):
                n, keys, buckets = [], [], []
                for s in shingle_sets(texts, size):
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    buckets.append(minmax.buckets(minmax.signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["id", "n", "key", "buckets"])

    return df.select(id_col, text_col).mapInArrow(trimmed(run), "id bigint, n bigint, key binary, buckets array<bigint>")


def long_signatures(texts: DataFrame, size: int, minmax: MinMax) -> DataFrame:
    """id, n and, for each band of eight values, these values with eight bits each, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, some in stretches(batch.column(1)):
                n, sigs = [], []
                for s in shingle_sets(some, size):
                    n.append(len(s))
                    sigs.append(mix(minmax.signature(s)).astype(np.uint8).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)), pa.array(n, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "n", "sig"])

    return texts.select("id", "text").mapInArrow(trimmed(run), "id bigint, n bigint, sig array<bigint>")


def confirm(texts: DataFrame, pairs: DataFrame, size: int, num: int, den: int, block: int = 48) -> DataFrame:
    """texts: id, text. pairs: a, b, a written table. Those with den * intersection >= num * union of their full sets. Each a
    goes with at most about `block` of its partners to a task, so one with very many is spread; a task holds the set of one
    a and one b."""
    spark = texts.sparkSession
    spread = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times")).withColumn("k", F.ceil(F.col("times") / block).cast("int")), "spread")
    ours = spread.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("side"))
    theirs = lookup(pairs, spread, ["a"], "times").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), F.lit(1).alias("side"))
    rows = texts.join(ours.unionByName(theirs), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, own, compared = None, [], False
        for batch in batches:
            ids, aa, sides, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for lo, some in stretches(batch.column(3)):
                for i, s in enumerate(shingle_sets(some, size), lo):
                    if sides[i] == 0:
                        own = [*own, s] if a == aa[i] and not compared else [s]
                        a, compared = aa[i], False
                        continue
                    assert a == aa[i]
                    compared = True
                    for x in own:
                        if den * min(len(x), len(s)) >= num * max(len(x), len(s)):
                            both = len(np.intersect1d(x, s, assume_unique=True))
                            if both and den * both >= num * (len(x) + len(s) - both):
                                found.append((a, ids[i]))
                                break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    dealt = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "a", "salt")
    return dealt.sortWithinPartitions("a", "salt", "side").select("id", "a", "side", "text").mapInArrow(trimmed(run), "a bigint, b bigint")


class Near:
    """Pairs of a unit's rows (i, id, comp, n, sig) of different components that are near by their long signatures: pairs at
    the threshold agree in `least` of the values at least. A pair belongs to the first band that it shares."""

    def __init__(self, num: int, den: int, values: int):
        self.num, self.den = num, den
        self.least = math.floor(values * num / den - 5 * math.sqrt(values * num * (den - num)) / den)

    def pairs(self, band: int, held: list) -> list[tuple[int, int]]:
        """Places of the two rows, the nearest pair first."""
        blocks, _, comps, n = (np.array([h[k] for h in held], np.int64) for k in range(4))
        bands = np.array([h[4] for h in held], np.int64)
        sigs = bands.view(np.uint8)
        cut, found = blocks.min() != blocks.max(), []
        for i in np.flatnonzero(blocks == blocks[0]).tolist():
            others = np.flatnonzero((comps != comps[i]) & (self.den * np.minimum(n, n[i]) >= self.num * np.maximum(n, n[i])))
            others = others[blocks[others] != blocks[i]] if cut else others[others > i]
            if not len(others):
                continue
            agree = (sigs[others] == sigs[i]).sum(1)
            others, agree = others[agree >= self.least], agree[agree >= self.least]
            mine = (bands[others] == bands[i]).argmax(1) == band if len(others) else others
            found += [(-int(c), i, int(k)) for c, k in zip(agree[mine], others[mine], strict=True)]
        return [(i, k) for _, i, k in sorted(found)]


_UNIT = ["band", "key", "x", "y"]


def _units(rows: DataFrame, flush, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Deals rows (_UNIT, i, id, comp, n, sig, ...) out by unit and gives what flush gives for each; holds one unit."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done() -> pa.RecordBatch:
            out = flush(unit, held) if len({h[2] for h in held}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True):
                    if row[:4] != unit:
                        if held:
                            yield done()
                        unit, held = row[:4], []
                    held.append((*row[4:8], np.array(row[8], np.int64), *row[9:]))
        if held:
            yield done()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *_UNIT).sortWithinPartitions(*_UNIT, "id").mapInArrow(trimmed(run), schema)


def close_links(texts: DataFrame, tagged: DataFrame, size: int, num: int, den: int, block: int = 2048, shingles: int = 1 << 21) -> DataFrame:
    """tagged: id, comp of the documents of buckets with several components; texts: id, text of at least these. The links
    between components, as a, b.

    Fine buckets are units; those of more than `block` members or of many more than `shingles` shingles are cut into blocks,
    of which each two are a unit. A unit's signatures say which documents have a near one of another component; only these
    get their texts and are compared on full sets, the nearest first, but for pairs that links of the unit already connect."""
    wide = materialise(long_signatures(texts.join(tagged.select("id"), "id", "left_semi"), size, MinMax(128, 8, seed=2)), "wide")
    own = materialise(wide.join(tagged, "id"), "own")
    fine = own.select("comp", "n", F.posexplode("sig").alias("band", "key")).groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("times"), F.sum("n").alias("all"))
    cuts = F.ceil(F.greatest(F.col("times") / block, F.col("all") / shingles)).cast("int")
    fine = materialise(fine.where("lo < hi").select("band", "key", "times", cuts.alias("k")), "fine")
    # signatures are long, so that only those of members are dealt
    members = lookup(own.select("id", F.posexplode("sig").alias("band", "key")), fine, ["band", "key"], "times").select("id", "band", "key", "k").join(own, "id")
    rest = ["id", "comp", "n", "sig"]
    whole = members.where("k = 1").select("band", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("i"), *rest)
    cut = members.where("k > 1").withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cut = cut.select("band", "key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", *rest)
    near = Near(num, den, 1024)

    def involved(unit: tuple, held: list) -> list[tuple]:
        return [(*unit, *held[p]) for p in sorted({p for pair in near.pairs(unit[0], held) for p in pair})]

    def links(unit: tuple, held: list) -> list[tuple[int, int]]:
        sets, up, out = {}, {}, []

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        def shingles_of(p: int) -> np.ndarray:
            if p not in sets:
                sets[p] = next(shingle_sets([(held[p][5] or "").encode()], size))
            return sets[p]

        for i, k in near.pairs(unit[0], held):
            a, b = top(held[i][2]), top(held[k][2])
            if a != b:
                x, y = shingles_of(i), shingles_of(k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and den * both >= num * (len(x) + len(y) - both):
                    up[max(a, b)] = min(a, b)
                    out.append((held[i][1], held[k][1]))
        return out

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    some = materialise(_units(whole.unionByName(cut), involved, "band int, key bigint, x int, y int, i int, id bigint, comp bigint, n bigint, sig array<bigint>", kinds), "involved")
    out = materialise(_units(some.join(texts, "id").select(*some.columns, "text"), links, "a bigint, b bigint", [pa.int64(), pa.int64()]), "links")
    discard(own, wide, fine, some)
    return out


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75, den: int = 100, bands: int = 36, rows: int = 4) -> DataFrame:
    """A row for each row of df: id_col, n_shingles, component_id, kept."""
    df = df.where(F.col(id_col).isNotNull())
    sigs = materialise(signatures(df, id_col, text_col, size, MinMax(bands, rows)), "signatures")
    classes = materialise(sigs.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")), "classes")
    reps = sigs.join(classes, (sigs.id == classes.rep) & (sigs.key == classes.key)).select("id", "buckets")
    entries = materialise(reps.select(F.explode("buckets").alias("bucket"), "id").distinct(), "buckets")
    heads = materialise(entries.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("times")).where("a < z").drop("z"), "heads")
    shared = materialise(lookup(entries, heads, ["bucket"], "times").select("bucket", "id", "a"), "shared")
    discard(entries, heads)
    # all that is compared on full sets: documents that share a bucket
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(shared.select("id").distinct(), "id")
    texts = materialise(texts, "texts")
    release(df.sparkSession)
    first = materialise(shared.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    links = materialise(confirm(texts, first, size, num, den), "links")
    release(df.sparkSession)
    nodes = components(links)
    discard(first, links)
    tagged = materialise(shared.join(nodes, shared.id == nodes.node, "left").select("bucket", "id", F.coalesce("component", "id").alias("comp")), "tagged")
    mixed = materialise(tagged.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("times")).where("lo < hi").select("bucket", "times"), "mixed")
    left = materialise(lookup(tagged, mixed, ["bucket"], "times").select("id", "comp").distinct(), "left")
    discard(shared, tagged, mixed)
    more = close_links(texts, left, size, num, den)
    discard(left, texts)
    release(df.sparkSession)
    if not more.isEmpty():
        nodes = components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    whole = materialise(classes.join(nodes, classes.rep == nodes.node, "left").select("key", "times", F.coalesce("component", "rep").alias("component_id")), "whole")
    rows = sigs.select("id", "n", "key")
    out = lookup(rows.where("key is not null"), whole, ["key"], "times").select("id", "n", "component_id")
    out = out.unionByName(rows.where("key is null").select("id", "n", F.col("id").alias("component_id")))  # texts without words, however many, are not dealt
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {
    "op6_minhash": f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as sh
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
sets as (select doc_id, sha256(string_agg(sh, chr(10) order by sh)) as k from s group by doc_id),
cls as (select k, min(doc_id) as rep from sets group by k),
rs as (select s.doc_id, s.sh from s join cls on s.doc_id = cls.rep),
x as (select a.doc_id as a, b.doc_id as b, count(*) as c from rs a join rs b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
e2 as (select a, b from e union all select b, a from e),
r(node, root) as (select rep, rep from cls union select e2.b, r.root from r join e2 on e2.a = r.node),
comp as (select node, min(root) as component from r group by node)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.component, w.doc_id) as component_id,
  coalesce(comp.component, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join sets using (doc_id) left join cls using (k) left join comp on comp.node = cls.rep"""
}
