"""Heavy keys by a top-k sketch, and joins whose heavy keys are dealt to shares.

One aggregate of bounded size per task (``approx_top_k`` over 64-bit key hashes)
names the keys that hold more rows than one task should; it needs no shuffle of
keys.  Keys that share a hash are treated alike, which is harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a task's sketch tracks; the counts of the sketch are off by at most some 1/20,000 of all rows.
TRACKED = 50_000
# Keys that are looked at; no more than this many can hold one row in so many each.
MOST = 128
# Rows of one key that one task should get, and shares of a key at most.
SHARE_ROWS = 1_000_000
MAX_SHARES = 4096


def heavy_keys(df: DataFrame, key: Column, rows: int, most: int = MOST) -> dict[int, int]:
    """Hash and about how many rows of the keys with more than ``rows`` rows; ``most`` entries at most reach the driver."""
    top = df.agg(F.call_function("approx_top_k", F.xxhash64(key), F.lit(most), F.lit(TRACKED)).alias("_top")).first()[0]
    return {r["item"]: r["count"] for r in top or [] if r["count"] > rows}


class Shares:
    """How many shares each key is dealt to: one, and more for heavy keys, by their measured rows."""

    def __init__(self, heavy: dict[int, int], share_rows: int = SHARE_ROWS):
        self.by_hash = {h: min(MAX_SHARES, -(-n // share_rows)) for h, n in heavy.items()}

    def of(self, key: Column) -> Column:
        if not self.by_hash:
            return F.lit(1)
        table = F.create_map(*[F.lit(x) for h, n in self.by_hash.items() for x in (h, n)])
        return F.coalesce(F.try_element_at(table, F.xxhash64(key)), F.lit(1))

    def one(self, key: Column, row: Column) -> Column:
        """The share of a row, by a hash of ``row``."""
        return F.pmod(F.xxhash64(row), self.of(key)).cast("int")

    def all(self, key: Column) -> Column:
        """Every share of a key, for the side that is copied."""
        return F.sequence(F.lit(0), (self.of(key) - 1).cast("int"))
