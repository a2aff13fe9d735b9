"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

import os
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its row count is at most this many rows.  The
# count is an action on a small reference table; a large side falls back to a
# shuffle join (sort-merge, AQE skew split) instead of exhausting executors.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 100 * 1024 * 1024
CONF_KEY = "rxgrid.broadcast.maxRows"
CONF_BYTES_KEY = "rxgrid.broadcast.maxBytes"

_WIDTH = {"string": 32, "double": 8, "bigint": 8, "int": 4, "boolean": 1, "date": 4, "timestamp": 8, "float": 4}


def max_broadcast_rows(df: DataFrame) -> int:
    """Row bound: the smaller of the row setting and the byte setting divided by
    an estimated row width (strings counted as 32 bytes)."""
    conf = df.sparkSession.conf
    rows = int(conf.get(CONF_KEY, None) or DEFAULT_MAX_BROADCAST_ROWS)
    max_bytes = int(conf.get(CONF_BYTES_KEY, None) or DEFAULT_MAX_BROADCAST_BYTES)
    width = sum(_WIDTH.get(f.dataType.simpleString(), 16) for f in df.schema.fields) + 8
    return max(1, min(rows, max_bytes // width))


def broadcast_if_small(df: DataFrame, max_rows: int | None = None, bound_from: DataFrame | None = None) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df``.

    The bound is checked with a ``limit(max_rows + 1).count()`` so the check
    itself never scans more than the bound.  ``bound_from`` names a source
    whose row count bounds ``df`` (``df`` is an aggregate or projection of
    it); counting a stored source is a footer read.
    """
    limit = max_rows if max_rows is not None else max_broadcast_rows(df)
    if bound_from is not None:
        # ``df`` has at most as many rows as its source (an aggregate, a projection):
        # a source within the bound proves the bound without computing ``df`` first;
        # a map of a source over the bound may still be small, so it is checked itself
        if bound_from.limit(limit + 1).count() <= limit:
            return F.broadcast(df)
    # Persist while checking: when the side is small the check has computed
    # every partition, so the join reads it from the cache instead of
    # recomputing it; when it is large only a prefix was touched and the
    # cache is dropped again.
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    if os.environ.get("RXGRID_DEBUG"):
        df.sparkSession.sparkContext.setJobDescription(f"broadcast check {df.columns[:3]}")
    t0 = time.time()
    n = cached.limit(limit + 1).count()
    if os.environ.get("RXGRID_DEBUG"):
        print(f"[broadcast_if_small] rows={n} sec={time.time() - t0:.2f} cols={df.columns[:4]}", flush=True)
    if n <= limit:
        return F.broadcast(cached)
    cached.unpersist()
    return df


def broadcast_fixed(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size is fixed by construction (a handful of codes)."""
    return F.broadcast(df)
