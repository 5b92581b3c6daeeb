"""Digests, keyed tokens and canonical JSON."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 (hex) of a string, from two built-in digests and the key's pads."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    pads = [F.lit(bytearray(b ^ p for b in key)) for p in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pads[1], inner), 256)


def token(key: bytes, label: Column | str, value: Column) -> Column:
    """<LABEL:first 16 digits of the keyed digest of label:value>."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit("<"), label, F.lit(":"), F.left(hmac_sha256(key, F.concat(label, F.lit(":"), value)), F.lit(16)), F.lit(">"))


def canonical(**fields: Column) -> Column:
    """Compact JSON of the fields, sorted by name, nulls written. Non-ASCII characters are kept as they are."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def key_of(text: str) -> bytes:
    """A region's key from hexadecimal digits; anything else is refused."""
    try:
        key = bytes.fromhex(text)
    except ValueError:
        raise ValueError("a key must be hexadecimal digits") from None
    if len(key) < 16:
        raise ValueError("a key must have at least 16 bytes")
    return key
