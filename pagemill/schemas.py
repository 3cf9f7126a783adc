"""Declared schemas for every relation the library reads or writes.

Nothing is inferred: sources are read with these schemas and every public
operator returns columns named exactly as below.
"""

from pyspark.sql import types as T

# Fetched HTML pages (S1).  ``fetched_at`` is optional in inputs.
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

# Raw, not yet validated item records (S4 / E0 output).
RAW_ITEMS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("availability", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
])

# Prepared items, field order of the record type (JSON order).
ITEMS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("price_numeric", T.DoubleType()),
    T.StructField("rating", T.StringType()),
    T.StructField("rating_numeric", T.IntegerType()),
    T.StructField("availability", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
])

# Item column names, and the CSV header order.
ITEM_COLUMNS = ["title", "price", "price_numeric", "rating", "rating_numeric",
                "availability", "image_url", "url", "scraped_at"]
CSV_COLUMNS = ["title", "price", "rating", "rating_numeric", "availability",
               "image_url", "url", "scraped_at", "price_numeric"]

# One row per fetch attempt (S3).
FETCH_LOG = T.StructType([
    T.StructField("attempt_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("attempt_ts", T.TimestampType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("duration_s", T.DoubleType()),
])

# Robots rules (F3), re-aimed from robots.txt download to a table.
ROBOTS_RULES = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("allow", T.BooleanType()),
    T.StructField("path_prefix", T.StringType()),
])

# Columns that define "arrival order" for first-wins de-duplication: seq (with
# item_pos inside a page, where items come from pages), then
# every remaining raw column, so the winner is a total order up to rows that
# are identical in all columns (and therefore interchangeable).
DEDUP_ORDER = ["seq", "item_pos", "title", "price", "rating", "availability", "image_url", "scraped_at"]
