"""Fetch-attempt rules (N8-N10) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error kinds recorded per attempt, and the labels they map to.
TIMEOUT_KINDS = ["deadline", "net_timeout", "op_timeout"]
CONNECTION_KINDS = ["op_error"]
STATUS_LABELS = {403: "forbidden", 404: "not_found", 429: "rate_limited"}
ERROR_LABELS = ["unknown", "timeout", "connection", "forbidden", "not_found",
                "rate_limited", "other"]

# Default retry back-off base when none is set, in ms.
DEFAULT_BACKOFF_MS = 100


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_error(error_kind, status) -> Column:
    """First matching rule wins.

    no error and no status -> unknown; timeouts -> timeout; other network
    operation errors -> connection; 403/404/429 -> their label; no error ->
    unknown; anything else -> other.
    """
    k, s = _c(error_kind), F.coalesce(_c(status), F.lit(0))
    out = F.when(k.isNull() & (s == 0), F.lit("unknown"))
    out = out.when(k.isin(*TIMEOUT_KINDS), F.lit("timeout"))
    out = out.when(k.isin(*CONNECTION_KINDS), F.lit("connection"))
    for code, label in STATUS_LABELS.items():
        out = out.when(s == code, F.lit(label))
    return out.when(k.isNull(), F.lit("unknown")).otherwise(F.lit("other"))


def retry_backoff(attempt, base_ms, max_ms) -> Column:
    """``base * 2^(attempt-1)`` in ms, capped at ``max_ms`` when it is > 0.

    attempt <= 0 counts as 1; base <= 0 falls back to 100 ms.  An uncapped
    delay that does not fit a long gives NULL instead of wrapping around.
    """
    a = F.greatest(_c(attempt).cast("long"), F.lit(1))
    base = F.when(_c(base_ms) <= 0, F.lit(DEFAULT_BACKOFF_MS)).otherwise(_c(base_ms)).cast("long")
    mx = _c(max_ms).cast("long")
    exp = F.least(a - 1, F.lit(62)).cast("int")
    raw = F.try_multiply(base, F.call_function("shiftleft", F.lit(1).cast("long"), exp))
    capped = F.when((mx > 0) & (raw.isNull() | (raw > mx)), mx).otherwise(raw)
    return capped.cast("long")


def success_rate(requests, errors) -> Column:
    """(requests - errors) / requests * 100, 0 when there were none."""
    r, e = _c(requests).cast("double"), _c(errors).cast("double")
    return F.coalesce(F.try_divide((r - e) * F.lit(100.0), r), F.lit(0.0))


def per_second(count, seconds) -> Column:
    """Count / seconds, 0 when no time passed."""
    s = _c(seconds).cast("double")
    return F.when(s > 0, _c(count).cast("double") / s).otherwise(F.lit(0.0))
