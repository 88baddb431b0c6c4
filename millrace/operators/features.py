"""Feature points: range reads, cursors, expiry."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_small, with_scalar


def range_scan(points: DataFrame, where: Column, ts: str, start: Column, end: Column, tie: Sequence[str], limit: int | None = 1000, asc: bool = True) -> DataFrame:
    """Points in ``[start, end)`` up to ``limit``, all of them for None, with ``truncated`` telling of more.

    One row more than asked is read, by a top-k that never sorts the whole range.
    """
    order = [F.asc(c) if asc else F.desc(c) for c in (ts, *tie)]
    inside = points.where(where & (F.col(ts) >= start) & (F.col(ts) < end))
    if limit is None:
        return inside.withColumn("truncated", F.lit(False))
    top = inside.orderBy(*order).limit(limit + 1)
    size = top.agg(F.count("*").alias("__n"))
    page = with_scalar(top.orderBy(*order).limit(limit), size)
    return page.withColumn("truncated", F.col("__n") > limit).drop("__n")


def keyset_page(points: DataFrame, where: Column, ts: str, tie: str, after_ts: Column, after_tie: Column, limit: int = 1000) -> DataFrame:
    """The page after a cursor (last time, last tie value), in ascending order."""
    later = (F.col(ts) > after_ts) | ((F.col(ts) == after_ts) & (F.col(tie) > after_tie))
    return points.where(where & (F.col(ts) >= after_ts) & later).orderBy(ts, tie).limit(limit)


def make_cursor(query: Mapping[str, object], after_ts: str, after_tie: object) -> str:
    """An opaque text that continues this query after a row: its place, and a hash of the query."""
    asked = hashlib.sha256(json.dumps(query, sort_keys=True, default=str).encode()).hexdigest()
    return base64.urlsafe_b64encode(json.dumps([asked, after_ts, after_tie]).encode()).decode()


def read_cursor(cursor: str, query: Mapping[str, object]) -> tuple[str, object]:
    """The place of a cursor; raises if it was made for another query or is none."""
    try:
        asked, after_ts, after_tie = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as error:
        raise ValueError("not a cursor") from error
    if asked != hashlib.sha256(json.dumps(query, sort_keys=True, default=str).encode()).hexdigest():
        raise ValueError("the cursor belongs to another query")
    return after_ts, after_tie


def filter_since(df: DataFrame, tenant: Column, ts: str, since: Column, tie: str, limit: int | None = 100, service: Column | None = None) -> DataFrame:
    """Rows of a tenant (and service) strictly after ``since``, newest first; all of them for a limit of None."""
    rows = df.where(tenant & (F.col(ts) > since))
    if service is not None:
        rows = rows.where(service)
    return rows if limit is None else rows.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def ttl_evict(points: DataFrame, definitions: DataFrame, name: str, ts: str, now: Column) -> DataFrame:
    """Points not older than the time to live of their feature; none set means kept.

    ``definitions`` has the feature name and ``ttl_seconds``.
    """
    joined = join_small(points, definitions, [name], "left")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    ttl = F.col("ttl_seconds")
    return joined.where(ttl.isNull() | (ttl <= 0) | (age <= ttl * 1_000_000)).drop("ttl_seconds")
