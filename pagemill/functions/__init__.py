"""Scalar rules as native Spark ``Column`` expressions."""

from .fetch import classify_error, per_second, retry_backoff, success_rate
from .text import (decode_entities, format_2dp, format_rfc3339, is_blank, normalize_availability,
                   normalize_price, parse_price, rating_to_numeric, strip_tags, trim_ws)
from .urls import absolute_url, remove_dot_segments, url_host, url_path

__all__ = [
    "absolute_url", "classify_error", "decode_entities", "format_2dp", "format_rfc3339",
    "is_blank", "normalize_availability", "normalize_price", "parse_price", "per_second",
    "rating_to_numeric", "remove_dot_segments", "retry_backoff", "strip_tags", "success_rate",
    "trim_ws", "url_host", "url_path",
]
