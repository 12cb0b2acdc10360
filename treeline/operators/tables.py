"""Tables as logs of versions: rows are only appended, and a view of the newest row of each key is the table. A tombstone is
a row with gone = true. So an upsert, an update and a delete are each one write, and a reader sees all of it or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(log: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The newest row of each key, without versions, tombstones and what these hide. One aggregation, no window."""
    rest = [c for c in log.columns if c not in (*keys, version)]
    rows = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row")).select(*keys, "row.*")
    return rows.where("not gone").drop("gone") if "gone" in rest else rows


def upserts(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of its rows of the same keys; of rows of one key the one with the largest `version`."""
    old = table.withColumns({"version": F.lit(None).cast(rows.schema["version"].dataType), "gone": F.lit(False)})
    return current(old.unionByName(rows.withColumn("gone", F.lit(False))).withColumn("version", F.struct(F.col("version").isNotNull(), "version")), keys)


def inserts(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What insert-or-ignore appends: rows of keys that the table has not, of each key the first by `order`."""
    new = rows.join(table.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def updates(table: DataFrame, changes: DataFrame, keys: list[str], columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table with columns set where changes have the key, and changes with `matched`: whether there was a row."""
    hit = changes.select(*keys, *[c for c in changes.columns if c not in keys])
    rows = table.join(hit.withColumn("hit", F.lit(True)), keys, "left")
    out = rows.select(*[F.when(F.col("hit"), columns[c]).otherwise(table[c]).alias(c) if c in columns else F.col(c) if c in keys else table[c] for c in table.columns])
    return out, changes.join(table.select(*keys).distinct().withColumn("there", F.lit(True)), keys, "left").select(*keys, F.coalesce("there", F.lit(False)).alias("matched"))


def deletes(table: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without these keys; those it has not make no difference."""
    return table.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def lookup(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each asked key with its row's columns, null where there is none, and `found`."""
    return asked.join(table.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def positional(asked: DataFrame, got: DataFrame, key: str, order: str) -> DataFrame:
    """asked (order, key) with got's columns in the same order; fails unless every asked key has an answer."""
    rows = asked.join(got.withColumn("answered", F.lit(True)), key, "left")
    rows = rows.withColumn("answered", F.when(F.col("answered"), True).otherwise(F.raise_error(F.lit("fewer answers than requests")).cast("boolean")))
    return rows.where("answered").drop("answered").orderBy(order)
