"""Job options (U4): defaults, coherent validation, environment overrides."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from urllib.parse import urlsplit

from .sinks.writers import FORMATS


@dataclass(frozen=True)
class JobOptions:
    # Defaults of the crawl/pipeline options.
    base_url: str = "https://books.toscrape.com/"
    max_pages: int = 50
    parallelism: int = 16
    max_retries: int = 2
    retry_backoff_ms: int = 200
    retry_backoff_max_ms: int = 2000
    output_file: str = "books.csv"
    output_format: str = "csv"
    respect_robots_txt: bool = True
    pipeline_buffer_size: int = 512
    batch_size: int = 64
    dedupe_max_size: int = 100_000
    dedup_horizon: str = "1 hour"

    def validate(self) -> "JobOptions":
        """Raise ``ValueError`` on the first incoherent option."""
        parts = urlsplit(self.base_url or "")
        if not self.base_url:
            raise ValueError("base_url is required")
        if not parts.hostname:
            raise ValueError(f"base_url {self.base_url!r} has no host")
        if self.max_pages <= 0:
            raise ValueError("max_pages must be > 0")
        if self.parallelism <= 0:
            raise ValueError("parallelism must be > 0")
        if self.max_retries < 0:
            raise ValueError("max_retries must be >= 0")
        if self.retry_backoff_ms < 0 or self.retry_backoff_max_ms < 0:
            raise ValueError("retry back-off must be >= 0")
        if self.retry_backoff_max_ms > 0 and self.retry_backoff_ms > self.retry_backoff_max_ms:
            raise ValueError("retry_backoff_ms must not exceed retry_backoff_max_ms")
        if not self.output_file:
            raise ValueError("output_file is required")
        if self.output_format.lower() not in FORMATS:
            raise ValueError(f"output_format must be one of {FORMATS}")
        for n in ("pipeline_buffer_size", "batch_size", "dedupe_max_size"):
            if getattr(self, n) < 0:
                raise ValueError(f"{n} must be >= 0")
        return self

    @property
    def allowed_host(self) -> str:
        """the seed's host name (port ignored)."""
        return (urlsplit(self.base_url).hostname or "").lower()

    @property
    def effective_batch_size(self) -> int:
        return self.batch_size if self.batch_size > 0 else 64

    @property
    def effective_buffer_size(self) -> int:
        return self.pipeline_buffer_size if self.pipeline_buffer_size > 0 else 512

    @classmethod
    def from_env(cls, prefix: str = "PAGEMILL_", environ: Mapping[str, str] | None = None, **overrides) -> "JobOptions":
        """Defaults, then ``PAGEMILL_<FIELD>`` environment values (or those of
        ``environ``), then explicit overrides.  A malformed integer raises ``ValueError``."""
        opts = cls()
        env, values = {}, os.environ if environ is None else environ
        for f in fields(cls):
            raw = values.get(prefix + f.name.upper())
            if raw is None or raw == "":
                continue
            cur = getattr(opts, f.name)
            if isinstance(cur, bool):
                env[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(cur, int):
                try:
                    env[f.name] = int(raw.strip())
                except ValueError as ex:
                    raise ValueError(f"{prefix + f.name.upper()}: not an integer: {raw!r}") from ex
            else:
                env[f.name] = raw
        return replace(opts, **env, **overrides)
