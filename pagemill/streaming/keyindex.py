"""An index of published URLs for the deterministic stream (ST3), read only where a batch may hit.

The index is a folder of segments ``segment-<first>-<last>-w<words>-k<buckets>``, each for
a range of micro-batches:

* ``keys/bucket=B``: the URLs and their 64-bit hashes, dealt to buckets by hash;
* ``filter``: a Bloom filter of the hashes, two slots each in a bit space of about
  ``BITS`` bits a key, as 4 KB bitmaps that are joined by number.

A batch tests its URLs against the filters, and reads only the buckets that hold a URL
that may have been published; these are compared exactly.  Segments of not many more keys
than the batch has URLs are compared whole, at once: to test each
URL would move more than the keys.  Every ``FAN`` segments of one
size are merged into a larger one, so that N batches leave about ``FAN`` log N
segments.  A segment gets its name by one rename when it is whole; segments
inside a larger one, which a crash may leave, do not count.
"""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path
from ..sinks import writers as S

BITS = 32  # of the filter per key
BUCKET_KEYS = 4096  # keys of a bucket, about
MAX_BUCKETS = 4096
FAN = 8
WHOLE = 4  # keys a URL of the batch, up to which a segment is compared whole
_WORD = 1 << 15  # bits of a bitmap
_NAME = re.compile(r"segment-(\d+)-(\d+)-w(\d+)-k(\d+)")


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _slots(h: Column, words: int) -> Column:
    """The two slots of a hash, from 1 as bitmaps count them."""
    return F.array(*[F.pmod(F.xxhash64(h, F.lit(k)), F.lit(words * _WORD)) + 1 for k in (1, 2)])


class KeyIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def segments(self, before: int | None = None) -> list[tuple[int, int, int, int]]:
        """(first, last, words, buckets) of the segments that count, for batches below ``before``."""
        fs, p, _ = S._fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        found = [tuple(map(int, m.groups())) for st in fs.listStatus(p) if (m := _NAME.fullmatch(st.getPath().getName()))]
        found = sorted(s for s in found if before is None or s[1] < before)
        return [s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] and (o[:2] != s[:2] or o > s) for o in found)]

    def _path(self, segment: tuple[int, int, int, int]) -> str:
        return f"{self.root}/segment-{segment[0]}-{segment[1]}-w{segment[2]}-k{segment[3]}"

    def add(self, urls: DataFrame, first: int, last: int) -> None:
        """Index distinct ``url``s as the segment of the batches ``first`` to ``last``."""
        n = urls.count()
        words, buckets = _power(-(-n * BITS // _WORD)), min(MAX_BUCKETS, _power(-(-n // BUCKET_KEYS)))
        staged = f"{self.root}/_staged-{uuid.uuid4().hex[:12]}"
        keys = urls.select(F.xxhash64("url").alias("hash"), "url").withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
        keys.repartition("bucket").write.partitionBy("bucket").parquet(f"{staged}/keys")
        slots = urls.select(F.explode(_slots(F.xxhash64("url"), words)).alias("slot"))
        slots.groupBy(F.bitmap_bucket_number("slot").alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")) \
            .write.parquet(f"{staged}/filter")
        for old in self.segments():
            if old[:2] == (first, last):  # of an earlier attempt
                remove_path(self.spark, self._path(old))
        S.move_over(self.spark, staged, self._path((first, last, words, buckets)))

    def keys(self, segment: tuple[int, int, int, int], buckets: list[int] | None = None) -> DataFrame:
        found = self.spark.read.schema("hash long, url string, bucket int").parquet(f"{self._path(segment)}/keys")
        return found if buckets is None else found.filter(F.col("bucket").isin(buckets))

    def candidates(self, urls: DataFrame, segment: tuple[int, int, int, int]) -> DataFrame:
        """(hash, url, bucket) of the URLs that the segment's filter lets through."""
        bits = self.spark.read.schema("word long, bits binary").parquet(f"{self._path(segment)}/filter")
        at = urls.select(F.xxhash64("url").alias("hash"), "url").select("hash", "url", F.explode(_slots(F.col("hash"), segment[2])).alias("_slot"))
        at = at.withColumn("word", F.bitmap_bucket_number("_slot")).join(bits, "word")
        byte = F.conv(F.hex(F.expr("substring(bits, int(bitmap_bit_position(_slot) div 8) + 1, 1)")), 16, 10).cast("int")
        is_set = F.call_function("shiftright", byte, F.expr("int(bitmap_bit_position(_slot) % 8)")).bitwiseAND(F.lit(1)) == 1
        both = at.filter(is_set).groupBy("hash", "url").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2")
        return both.select("hash", "url", F.pmod("hash", F.lit(segment[3])).cast("int").alias("bucket"))

    def published(self, urls: DataFrame, before: int) -> DataFrame:
        """The ``url``s that batches below ``before`` hold."""
        found, segments = self.spark.createDataFrame([], "url string"), self.segments(before)
        n = urls.count() if segments else 0
        whole = [s for s in segments if s[2] * _WORD // BITS <= WHOLE * n]  # keys by the filter's size, at most twice as many as there are
        if whole:
            held = functools.reduce(DataFrame.unionByName, [self.keys(s).select("hash", "url") for s in whole])
            found = urls.select(F.xxhash64("url").alias("hash"), "url").join(held, ["hash", "url"], "left_semi").select("url")
        for segment in (s for s in segments if s not in whole):
            maybe = self.candidates(urls, segment)
            hit = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # MAX_BUCKETS numbers at most
            if hit:
                found = found.unionByName(maybe.join(self.keys(segment, hit), ["hash", "url"], "left_semi").select("url"))
        return found

    def merge(self, before: int) -> None:
        """Merge every ``FAN`` neighbouring segments of about one size below ``before``."""
        while True:
            live = self.segments(before)
            level = [(s[1] - s[0] + 1).bit_length() // 3 for s in live]  # FAN is 2^3
            at = next((i for i in range(len(live) - FAN + 1) if len(set(level[i:i + FAN])) == 1), None)
            if at is None:
                return
            part = live[at:at + FAN]
            urls = self.keys(part[0]).select("url")
            for s in part[1:]:
                urls = urls.unionByName(self.keys(s).select("url"))
            self.add(urls, part[0][0], part[-1][1])
            for s in part:
                remove_path(self.spark, self._path(s))
