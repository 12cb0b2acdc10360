"""Mixing sources to target weights, with DataFrame operations only.

The words of each source's documents, in a pseudorandom order, are packed into blocks of fixed length. The mix is a
sequence of slots of one block each, cut into output shards of fixed length; each shard's counts of slots by source are a
multinomial draw. A source's slots are numbered through all shards and mapped to its blocks by a pseudorandom permutation
of the block indexes for each pass over the source, and blocks are joined by index. What a source was drawn over its
target goes to the slots of those that were drawn less, and the slot in which a target ends takes a part of its block; so
a source gives its target to the word, and passes a document's word at most as often as the source is passed, twice.

Targets: sources by code point, null last, weigh 3, 1, 2 and so on and share `share` of all words; a target stops at
`most` times its source's words and the excess is shared again by weight.

Documents without words are in the result with nothing taken; rows repeated with the same identifier are separate
documents; an empty table gives an empty result. Rows without an identifier count too, as documents of identifier null.
Everything derives from hashes of identifiers, texts and indexes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm._common import WORD, materialise, smallest, table

ROUNDS = 24


def permuted(x: str, n: str, key: str, back: bool = False) -> str:
    """SQL for a permutation of 0 .. n - 1 (swap-or-not: in every round x may change places with its mirror image)."""
    rounds = f"sequence({ROUNDS}, 1)" if back else f"sequence(1, {ROUNDS})"
    mirror = f"pmod(pmod(xxhash64({key}, r), {n}) - p, {n})"
    return f"aggregate({rounds}, cast({x} as bigint), (p, r) -> if(pmod(xxhash64({key}, r, greatest(p, {mirror}), 'swap'), 2L) = 1L, {mirror}, p))"


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """sources: source, source_size. Adds sid (place by code point) and target: the smaller of most * source_size and
    level * weight, at the level where all targets sum to share of all sizes. A row for each source, so small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("sid", F.row_number().over(by_name).cast("bigint"))
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    rows = rows.withColumn("all", F.sum("source_size").over(whole) * F.lit(float(share)))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("all") - before) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.row_number().over(fill), "level"))).over(whole)["level"])
    return rows.select("source", "source_size", "sid", F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).alias("target"))


def running(rows: DataFrame, key: str, order: str, value: str, name: str, span: int = 1024) -> DataFrame:
    """Adds name: the sum of value over rows of the same key with a smaller order (a whole number, once for each key). Sums of
    spans of the order come first, so that no task sees all rows of a key."""
    rows = rows.withColumn("_span", F.expr(f"{order} div {span}"))
    sums = rows.groupBy(key, "_span").agg(F.sum(value).alias("_sum"))
    spans = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, "_span", F.coalesce(F.sum("_sum").over(spans), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, [key, "_span"])
    return rows.withColumn(name, (F.col("_inside") + F.col("_base")).cast("bigint")).drop("_span", "_inside", "_base")


class Mix:
    """documents: id, mark (a hash of the text), source, size, sid, source_size, target, start (place in its source's words).
    spans: shard, sid, pass, block, id, start, first (word of the document), words."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, block: int = 256, shard: int = 1024, seed: int = 11, bucket_rows: int = 1024):
        self.spark, self.block, self.shard, self.seed = df.sparkSession, block, shard, seed
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
        own = materialise(df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
        wanted = targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
        wanted = wanted.withColumn("wanted", F.round("target").cast("bigint")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
        wanted = wanted.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0).cast("bigint"))
        wanted = wanted.withColumn("rest", F.col("wanted") - F.col("passes") * F.col("source_size"))
        wanted = wanted.withColumn("short_len", F.col("source_size") - (F.col("blocks") - 1) * block)
        wanted = wanted.withColumn("short_at", F.when(F.col("blocks") > 0, F.expr(permuted("blocks - 1", "blocks", f"{seed}, sid, passes", back=True))))
        over = F.col("rest") - F.col("short_at") * block
        slots = F.when(F.col("rest") == 0, 0).when(over <= 0, F.ceil(F.col("rest") / block)).when(over <= F.col("short_len"), F.col("short_at") + 1).otherwise(F.col("short_at") + 1 + F.ceil((over - F.col("short_len")) / block))
        wanted = wanted.withColumn("slots", (F.col("passes") * F.col("blocks") + slots).cast("bigint"))
        self.sources = materialise(wanted, "sources")
        n = own.count()
        self.documents = materialise(self._placed(own, max(1, n // bucket_rows)), "placed")
        self.spans = materialise(self._joined(), "spans")

    def _placed(self, own: DataFrame, buckets: int) -> DataFrame:
        """Each document's place among its source's words: places of hash buckets, then places in the bucket."""
        rows = own.join(self.sources.select("source", "sid", "source_size", "target"), own.source.eqNullSafe(self.sources.source)).drop(self.sources.source)
        rows = rows.withColumn("at", F.xxhash64("id", F.lit(self.seed))).withColumn("bucket", F.pmod("at", F.lit(buckets)))
        sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
        sums = running(sums, "sid", "bucket", "words", "base").drop("words")
        inside = Window.partitionBy("sid", "bucket").orderBy("at", "id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])
        return rows.select("id", "mark", "source", "size", "sid", "source_size", "target", (F.col("start") + F.col("base")).cast("bigint").alias("start"))

    def _slots(self) -> DataFrame:
        """shard, sid, j: the j-th slot of source sid is in that shard."""
        src = self.sources.select("sid", "slots").where("slots > 0")
        total = src.agg(F.sum("slots")).first()[0] or 0
        cell = max(1, total // 1024)
        upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
        limits = src.withColumn("low", F.coalesce(F.sum("slots").over(upto), F.lit(0))).withColumn("high", F.col("low") + F.col("slots"))
        cells = limits.select("sid", "low", "high", F.explode(F.expr(f"sequence(low div {cell}, (high - 1) div {cell})")).alias("cell"))
        draws = self.spark.range(total).select((F.expr(f"id div {self.shard}")).alias("shard"), F.pmod(F.xxhash64("id", F.lit(self.seed), F.lit("draw")), F.lit(max(total, 1))).alias("x"))
        draws = draws.withColumn("cell", F.expr(f"x div {cell}")).join(cells, "cell").where("x >= low and x < high")
        counts = draws.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("c"))
        counts = materialise(running(counts, "sid", "shard", "c", "j"), "counts")
        drawn = counts.groupBy("sid").agg(F.sum("c").alias("drawn"))
        upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
        even = src.join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        even = even.withColumn("over", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
        even = even.withColumn("over_at", F.coalesce(F.sum("over").over(upto), F.lit(0))).withColumn("under_at", F.coalesce(F.sum("under").over(upto), F.lit(0)))
        even = materialise(even, "even")
        parts = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        counts = counts.repartition(parts, "shard", "sid")  # a row becomes up to a shard of slots
        each = counts.join(F.broadcast(even.select("sid", "slots", "over_at")), "sid").withColumn("j", F.explode(F.expr("sequence(j, j + c - 1)")))
        good = each.where("j < slots").select("shard", "sid", "j")
        extra = each.where("j >= slots").select("shard", (F.col("over_at") + F.col("j") - F.col("slots")).alias("e"))
        free = even.where("under > 0").select("sid", "drawn", "under_at", F.explode(F.expr("sequence(0L, under - 1)")).alias("i")).select("sid", (F.col("drawn") + F.col("i")).alias("j"), (F.col("under_at") + F.col("i")).alias("e"))
        return good.unionByName(extra.join(free, "e").select("shard", "sid", "j"))

    def _joined(self) -> DataFrame:
        b = self.block
        slots = self._slots().join(self.sources.select("sid", "blocks", "passes", "rest", "short_at", "short_len"), "sid")
        slots = slots.withColumn("pass", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
        slots = slots.withColumn("block", F.expr(permuted("i", "blocks", f"{self.seed}, sid, pass")))
        length = F.when(F.col("block") == F.col("blocks") - 1, F.col("short_len")).otherwise(b)
        done = F.when(F.col("i") <= F.col("short_at"), F.col("i") * b).otherwise((F.col("i") - 1) * b + F.col("short_len"))
        slots = slots.withColumn("take", F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - done)))
        pieces = self.documents.where("size > 0").select("sid", "id", "mark", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        pieces = pieces.withColumn("lo", F.greatest(F.col("start") - F.col("block") * b, F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b)))
        spans = slots.select("shard", "sid", "pass", "block", "take").join(pieces, ["sid", "block"]).where("lo < take")
        return spans.select("shard", "sid", "pass", "block", "id", "mark", "start", (F.col("block") * b + F.col("lo") - F.col("start")).alias("first"), (F.least("hi", "take") - F.col("lo")).cast("bigint").alias("words"))

    def taken(self) -> DataFrame:
        """id, size, source_size, target, taken for each document."""
        sums = self.spans.groupBy("sid", "start").agg(F.sum("words").alias("taken"))
        some = self.documents.where("size > 0").join(sums, ["sid", "start"], "left")
        none = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
        cols = ["id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")]
        return some.select(*cols).unionByName(none.select(*cols))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_chars", **options) -> DataFrame:
    """df's columns, a row for each document and pass over its source from which words were taken. A document taken whole
    keeps its text; else it has the words taken, joined by one space."""
    mix = Mix(df, id_col, text_col, **options)
    parts = mix.spans.groupBy("id", "mark", "sid", "start", "pass").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"))
    parts = parts.join(mix.documents.where("size > 0").select("sid", "start", "size"), ["sid", "start"]).select("id", "mark", "parts", (F.col("taken") < F.col("size")).alias("cut"))
    # all of df's columns in one, as they may have any names; equal rows of one identifier and text are one here
    each = df.select(F.struct("*").alias("doc"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark")).groupBy("id", "mark").agg(smallest(df, "doc").alias("doc"))
    rows = parts.join(each, parts.id.eqNullSafe(each.id) & (parts.mark == each.mark)).select("doc", "parts", "cut")
    text = F.col("doc").getField(text_col)
    rows = rows.withColumn("split", F.when(F.col("cut"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("split"), (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")
    rows = rows.withColumn("whole", F.when(F.col("cut"), some).otherwise(text))
    fields = {c: F.col("doc").getField(c) for c in df.columns} | {text_col: F.col("whole")}
    if n_col in df.columns:
        fields[n_col] = F.when(F.col("cut"), F.char_length("whole")).otherwise(fields[n_col]).cast(df.schema[n_col].dataType)
    return rows.select(*[x.alias(c) for c, x in fields.items()])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().withColumnRenamed("id", "doc_id")
