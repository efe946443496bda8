"""Order-free, partition-free randomness: everything random is a hash of (seed, salt, key)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(seed: int | Column, key: Column, salt: str = "") -> Column:
    """Hex digest that puts rows in a reproducible random order; the seed may differ by row."""
    tail = f":{salt}:" if salt else ":"
    prefix = [F.lit(f"{seed}{tail}")] if isinstance(seed, int) else [seed.cast("string"), F.lit(tail)]
    return F.md5(F.concat(*prefix, key.cast("string")))


def uniform(seed: int | Column, key: Column, salt: str) -> Column:
    """Reproducible number in [0, 1) per (seed, salt, key)."""
    digits = F.substring(order_hash(seed, key, salt), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
