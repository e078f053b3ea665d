"""Checksums, signatures and encryption of columns, all in built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.common import col

BLOCK = 64


def checksum(content: str | Column, algorithm: str = "sha256") -> Column:
    """Hex digest of plain text or bytes."""
    if algorithm == "sha256":
        return F.sha2(col(content), 256)
    if algorithm == "md5":
        return F.md5(col(content))
    raise ValueError(f"unsupported checksum algorithm: {algorithm}")


def secret(spark: SparkSession, key: bytes) -> Column:
    """A key that plans and event logs don't show: a scalar subquery over a table of one row.

    The row is made from an RDD of the driver, whose content no plan prints. Use it, or any scalar subquery over a table of
    keys, in place of the bytes.
    """
    row = spark.createDataFrame(spark.sparkContext.parallelize([(bytearray(key),)], 1), "key binary")
    return row.select("key").scalar()


def _key(key: bytes | Column) -> Column:
    return key if isinstance(key, Column) else F.lit(bytearray(key))


def _padded(key: bytes | Column, byte: int) -> Column:
    """The key, digested if it is longer than a block, filled up with zeros, each byte combined with `byte`."""
    if not isinstance(key, Column):
        short = hashlib.sha256(key).digest() if len(key) > BLOCK else key
        return F.lit(bytearray(b ^ byte for b in short.ljust(BLOCK, b"\0")))
    short = F.when(F.octet_length(key) > BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(short), 2 * BLOCK, "0")
    at = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int").bitwiseXOR(F.lit(byte))
    return F.unhex(F.concat(*[F.lpad(F.hex(at(i)), 2, "0") for i in range(BLOCK)]))


def hmac_sha256(message: str | Column, key: bytes | Column) -> Column:
    """HMAC-SHA256 as hex: two nested digests over the padded key (RFC 2104).

    Bytes become a literal of the plan; a Column, such as `secret`, does not.
    """
    digest = F.unhex(F.sha2(F.concat(_padded(key, 0x36), col(message).cast("binary")), 256))
    return F.sha2(F.concat(_padded(key, 0x5C), digest), 256)


def hmac_matches(message: str | Column, signature: str | Column, key: bytes | Column) -> Column:
    """Whether the signature belongs to the message; false when it is missing."""
    return F.coalesce(hmac_sha256(message, key) == F.lower(col(signature)), F.lit(False))


def encrypt_column(value: str | Column, key: bytes | Column) -> Column:
    """AES-GCM with a random vector, as base64 text."""
    return F.base64(F.aes_encrypt(col(value).cast("binary"), _key(key), F.lit("GCM")))


def encrypt_record(columns: list[str], key: bytes | Column) -> Column:
    """Encrypt several columns as one JSON object."""
    return encrypt_column(F.to_json(F.struct(*columns)), key)


def decrypt_column(token: str | Column, key: bytes | Column, strict: bool = True) -> Column:
    """Plain text of a token; a wrong key is an error, or null with `strict=False`."""
    decrypt = F.aes_decrypt if strict else F.try_aes_decrypt
    return decrypt(F.unbase64(col(token)), _key(key), F.lit("GCM")).cast("string")
