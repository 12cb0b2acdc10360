"""Convergent encryption of chunks and keyed digests.

AES-256-GCM is built in; its layout is nonce, ciphertext, tag. HMAC and HKDF with SHA-256 are built of sha2 on the JVM, so
no step leaves it. The content digest is SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _xor(key: Column, byte: int) -> Column:
    """A 64-byte key with every byte changed by `byte`, through its hex digits."""
    digits = "0123456789ABCDEF"
    high, low = byte >> 4, byte & 15
    pairs = F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.concat(F.translate(F.substr(F.hex(key), i, F.lit(1)), digits, "".join(digits[k ^ high] for k in range(16))), F.translate(F.substr(F.hex(key), i + 1, F.lit(1)), digits, "".join(digits[k ^ low] for k in range(16)))))
    return F.unhex(F.array_join(pairs, ""))


def hmac_pads(key: Column) -> Column:
    """What of a keyed digest depends on the key alone: outer and inner."""
    block = F.unhex(F.rpad(F.hex(F.when(F.octet_length(key) > 64, _sha(key)).otherwise(key)), 128, "0"))
    return F.struct(_xor(block, 0x5C).alias("outer"), _xor(block, 0x36).alias("inner"))


def hmac_sha256(key: Column, data: Column, pads: Column | None = None) -> Column:
    """pads: hmac_pads of the key where they are known."""
    pads = hmac_pads(key) if pads is None else pads
    return _sha(F.concat(pads["outer"], _sha(F.concat(pads["inner"], data))))


def hkdf_sha256(secret: Column, salt: Column, info: Column, blocks: int = 1) -> Column:
    """`blocks` times 32 bytes of output."""
    key = hmac_sha256(salt, secret)
    out, last = F.unhex(F.lit("")), F.unhex(F.lit(""))
    for k in range(1, blocks + 1):
        last = hmac_sha256(key, F.concat(last, info, F.unhex(F.lit(f"{k:02X}"))))
        out = F.concat(out, last)
    return out


def encrypt_chunk(data: Column, key: Column, pads: Column | None = None) -> Column:
    """Equal data under one key gives equal bytes: the nonce is the first 12 bytes of a keyed digest."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.substring(hmac_sha256(key, data, pads), 1, 12))


def encrypt_blob(data: Column, key: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    """Null where the key or the bytes are wrong."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"))
