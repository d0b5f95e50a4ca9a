"""Content-derived ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name spaces of ids.
NS_TAXONOMY = "d9f6a9f29d0a4c2e8e2f2c9b5b7b6a11"
NS_DOCUMENT = "6f1a6f2e6d0a4c2e8e2f2c9b5b7b6a22"
NS_SENTENCE = "7a2b7f3e7e0a4c2e8e2f2c9b5b7b6a33"
NS_SYNTHETIC_DOCUMENT = "9c4d9f5e9f0a4c2e8e2f2c9b5b7b6a55"
NS_SYNTHETIC_SENTENCE = "ad5eaf6eaf0a4c2e8e2f2c9b5b7b6a66"
NS_SYNTHETIC_REWRITE = "be6fbf7ebf0a4c2e8e2f2c9b5b7b6a77"


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name (RFC 4122), in SQL."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
