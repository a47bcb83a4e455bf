"""Content-derived ids, content hashes and message signatures."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the namespace all derived ids share.
NAMESPACE = uuid.UUID("f47ac10b-58cc-4372-a567-0e02b2c3d479")


def uuid5(text: Column) -> Column:
    """Name-based (SHA-1) UUID of a string column, canonical 36 characters."""
    digest = F.sha1(F.concat(F.lit(NAMESPACE.bytes), F.encode(text, "UTF-8")))
    # Version nibble is 5; the variant nibble keeps its two low bits under binary 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def article_id(link: Column, *identity: Column) -> Column:
    """Id from the link; without a link, from the columns that identify the row, so a
    retried batch gives the same id again."""
    named = F.coalesce(link, F.lit("")) != ""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in identity]
    return uuid5(F.when(named, link).otherwise(F.concat_ws("\u001f", *parts)) if identity else link)


def content_hash(*columns: Column) -> Column:
    """SHA-256 (binary) over the given columns in the given order."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def with_hmac_keys(df: DataFrame, secret: Column, inner: str, outer: str) -> DataFrame:
    """Adds the (inner, outer) padded keys of a secret. Work these out once per source, not
    once per message."""
    raw = F.encode(secret, "UTF-8")
    key = F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    # Four bytes at a time: a block of 64 is sixteen words.
    words = F.array(*[F.conv(F.substring("_digits", at, 8), 16, 10).cast("bigint") for at in range(1, 128, 8)])

    def masked(mask: int) -> Column:
        word = F.lit(int.from_bytes(bytes([mask] * 4))).cast("bigint")
        return F.unhex(
            F.concat_ws("", F.transform("_words", lambda w: F.lpad(F.hex(w.bitwiseXOR(word)), 8, "0")))
        )

    return (
        df.withColumn("_digits", F.rpad(F.hex(key), 128, "0"))
        .withColumn("_words", words)
        .withColumns({inner: masked(0x36), outer: masked(0x5C)})
        .drop("_digits", "_words")
    )


def hmac_sha256(inner: Column, outer: Column, body: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a text column."""
    nested = F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(outer, nested), 256)
