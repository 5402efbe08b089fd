"""Sessions, seen sets and result caches."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.maintenance import latest

CHUNK = ["collection", "path", "seq_id"]


def touch(sessions: DataFrame, event: DataFrame) -> DataFrame:
    """Upserts sessions (session_id, created_at, last_active_at): first creation, last activity."""
    return sessions.unionByName(event).groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("last_active_at").alias("last_active_at"))


def seen(results: DataFrame, session_id: str | None = None) -> DataFrame:
    rows = results.filter(F.col("session_id") == session_id) if session_id is not None else results
    return rows.select(*([] if session_id is not None else ["session_id"]), *CHUNK).distinct()


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    """What chunks are known by: their place, and the session where both tables have one."""
    return (["session_id"] if "session_id" in a.columns and "session_id" in b.columns else []) + CHUNK


def exclude_seen(hits: DataFrame, seen_chunks: DataFrame) -> DataFrame:
    """Drops seen chunks before ranks are cut; of hits with a session_id those that the session itself has seen."""
    keys = _shared(hits, seen_chunks)
    return hits.join(seen_chunks.select(*keys).distinct(), keys, "left_anti")


def exclusion_stats(scope: DataFrame, seen_chunks: DataFrame) -> DataFrame:
    """How many chunks and documents of the scope are seen."""
    keys = _shared(scope, seen_chunks)
    return scope.join(seen_chunks.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("chunks"), F.count_distinct("collection", "path").alias("documents"))


def session_info(events: DataFrame, results: DataFrame) -> DataFrame:
    a = events.groupBy("session_id").agg(F.count("*").alias("events"))
    b = results.groupBy("session_id").agg(F.count("*").alias("results"), F.count_distinct("collection", "path").alias("documents"))
    return a.join(b, "session_id", "full_outer").na.fill(0, ["events", "results", "documents"])


def exclusion_policy(session_id: str | None, include_seen: bool = False, exclude: bool = False) -> bool:
    """An explicit session excludes what it has seen unless told otherwise; others only on request."""
    return not include_seen if session_id else exclude


def cache_key(**parameters: Any) -> str:
    """SHA-256 of the sorted parameters; callers add the snapshot and the models."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


class ResultCache:
    """Results by parameters and snapshot; a seen set bypasses it.

    The last ``size`` are held on the driver. With ``read`` (key to text, or None) and ``write`` (key,
    text) results are kept as JSON as well, and other processes find them.
    """

    def __init__(self, size: int = 256, read: Any = None, write: Any = None):
        self.size, self.held, self.read, self.write = size, {}, read, write

    def get(self, key: str, make: Any, bypass: bool = False) -> Any:
        if bypass:
            return make()
        if key not in self.held:
            if len(self.held) >= self.size:
                self.held.pop(next(iter(self.held)))
            kept = self.read(key) if self.read else None
            self.held[key] = json.loads(kept) if kept is not None else make()
            if kept is None and self.write:
                self.write(key, json.dumps(self.held[key], default=str))
        return self.held[key]


__all__ = ["ResultCache", "cache_key", "exclude_seen", "exclusion_policy", "exclusion_stats", "latest", "seen", "session_info", "touch"]
