"""Text and hashing expressions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the corpus format strips it, and the token separator class.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKEN_GAP = r"[ \t\n\x0b\f\r]+"
HASH_BASE = 1000003
HASH_MODULUS = 2147483647
STRIP_PATTERN = f"^{WHITESPACE}+|{WHITESPACE}+$"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace, tabs and line ends included."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def hash_int(text: Column, digits: int = 15) -> Column:
    """First ``digits`` hex digits of md5 as a non-negative long (15 digits = 60 bits)."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def order_key(columns: Sequence[str], seed: int) -> Column:
    """Seeded pseudo-random sort key of a row; independent of partitioning."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
