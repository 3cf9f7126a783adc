"""pagemill: crawl-catalogue ETL as Spark DataFrame operators.

Packages: ``functions`` (scalar rules as Column expressions), ``sources``
(scans and driver views), ``operators`` (extraction, validation,
de-duplication, fetch-log analytics, history), ``plans`` (multi-job plans:
traversal, the batch run, the driver query map), ``sinks`` (CSV / JSON Lines
/ dual with staged publish), ``streaming`` (Structured Streaming pipeline).
"""

__version__ = "0.1.0"
