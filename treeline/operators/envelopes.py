"""Manifests and chunks of encrypted workspaces: envelopes, addresses of ciphertexts, keyrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import crypto

STORED = "generation int, ciphertext string, hashes array<string>"


def seal_documents(documents: DataFrame, keys: DataFrame, hashes: DataFrame) -> DataFrame:
    """documents: ws, json. keys: ws, generation, key (32 bytes). hashes: ws, hash. ws and stored: the document under the
    newest generation in base64, with its chunks' hashes sorted, each once, so that references can be told without the key."""
    newest = keys.groupBy("ws").agg(F.max(F.struct("generation", "key")).alias("k")).select("ws", "k.*")
    own = hashes.groupBy("ws").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    rows = documents.join(newest, "ws").join(own, "ws", "left")
    sealed = F.base64(crypto.encrypt_blob(F.encode("json", "UTF-8"), F.col("key")))
    return rows.select("ws", F.to_json(F.struct("generation", sealed.alias("ciphertext"), F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"))).alias("stored"))


def parse_stored(rows: DataFrame) -> DataFrame:
    """Adds envelope (null for a bare document of before) and plain."""
    rows = rows.withColumn("envelope", F.from_json("stored", STORED))
    whole = F.col("envelope.generation").isNotNull() & F.col("envelope.ciphertext").isNotNull() & F.col("envelope.hashes").isNotNull()
    return rows.withColumn("envelope", F.when(whole, F.col("envelope"))).withColumn("plain", F.col("envelope").isNull())


def open_documents(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """ws and json: bare documents as they are, others under the newest generation whose key opens them; null if none does."""
    rows = parse_stored(stored)
    tries = rows.where("not plain").join(keys, "ws", "left")
    text = F.decode(crypto.decrypt(F.unbase64("envelope.ciphertext"), F.col("key")), "UTF-8")
    opened = tries.select("ws", "generation", text.alias("json")).groupBy("ws").agg(F.max_by("json", F.when(F.col("json").isNotNull(), F.col("generation"))).alias("json"))
    return rows.where("plain").select("ws", F.col("stored").alias("json")).unionByName(opened)


def seal_chunks(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """chunks: ws, data. ws, hash, data: each under the newest generation, its address the digest of the ciphertext; equal
    chunks of a workspace are one, and are so before they are sealed. What a key brings to a nonce is worked out once a key."""
    newest = keys.groupBy("ws").agg(F.max(F.struct("generation", "key")).alias("k")).select("ws", "k.key")
    pads = newest.select("key").distinct().select(F.col("key").alias("_key"), crypto.hmac_pads(F.col("key")).alias("_pads"))
    newest = newest.join(pads, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
    rows = chunks.select("ws", "data").distinct().join(newest, "ws")
    rows = rows.select("ws", crypto.encrypt_chunk(F.col("data"), F.col("key"), F.col("_pads")).alias("data"))
    return rows.withColumn("hash", F.sha2("data", 256)).dropDuplicates(["ws", "hash"]).select("ws", "hash", "data")


def open_chunks(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """ws, hash, data: ciphertexts that are their address's, by the newest generation that opens them; data is null else. The
    keys of a workspace come as one row, newest first, and older ones are tried only where newer ones failed."""
    ring = keys.groupBy("ws").agg(F.array_sort(F.collect_list(F.struct((-F.col("generation")).alias("g"), "key"))).alias("ring"))
    good = F.sha2("data", 256) == F.col("hash")
    rows = sealed.groupBy("ws", "hash").agg(F.max(F.when(good, F.col("data"))).alias("data")).join(ring, "ws", "left")
    tried = F.expr("aggregate(ring, cast(null as binary), (found, k) -> coalesce(found, try_aes_decrypt(data, k.key, 'GCM')))")
    return rows.select("ws", "hash", tried.alias("data"))


def keyring(payload: Column) -> Column:
    """A keyring {generation: 64 hex digits} as a map, null if it is empty, has generation 0 or a key of another length."""
    ring = F.from_json(payload, "map<string, string>")
    good = lambda g, k: g.rlike("^[1-9][0-9]{0,8}$") & k.rlike("^[0-9a-f]{64}$")
    ok = (F.size(ring) > 0) & F.forall(F.map_entries(ring), lambda e: F.coalesce(good(e["key"], e["value"]), F.lit(False)))
    return F.when(ok, F.transform_keys(ring, lambda g, _: g.cast("int")))


def keyring_of_wrapped(payload: Column) -> Column:
    """Of unwrapped bytes: exactly 32 are the one key of generation 1, others a keyring's text."""
    legacy = F.create_map(F.lit(1), F.lower(F.hex(payload)))
    return F.when(F.octet_length(payload) == 32, legacy).otherwise(keyring(F.decode(payload, "UTF-8")))
