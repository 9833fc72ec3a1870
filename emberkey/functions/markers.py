"""Log-line patterns and what they label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts the services log during a migration.
MIGRATION_MARKERS = {
    "started": r"TTL legacy backfill STARTED:",
    "progress": r"TTL legacy backfill progress:",
    "finished": r"TTL legacy backfill FINISHED:",
    "flip": r"Backfilled (\d+) legacy records and flipped state store",
    "replay_flip": r"Recovery: __ttl_stamped__ header on default-CF replay; flipping",
    "cold_complete": r"Recovery: completing interrupted legacy-TTL migration at",
    "resume_started": r"TTL legacy backfill RESUME STARTED:",
    "resume_completed": r"TTL legacy backfill RESUME COMPLETED:",
    "failsafe_read": r"Fail-safe TTL read:",
    "silently_deleting": r"silently deleting",
}

# The texts logged when partitions move between replicas.
HANDOVER_MARKERS = {
    "lock_retry": r"cannot acquire a lock",
    "fast_revoke": r"Fast revoke: skipping local state flush",
    "orphan_resume": r"Resuming data partitions paused for recovery",
    "open_budget": r"Open budget exhausted|would be exceeded by the next retry",
    "revoke_timeout": r"Revoke:.*flush timed out",
    "eviction": r"MAXPOLL|maximum poll interval|member[- ]left[- ]group",
}
ATTEMPT_OF_MAX = r"\(attempt (\d+)/\d+\)"
ATTEMPT_DEPTH = r"Opening rocksdb partition on .* attempt=(\d+)"

# A first attempt: whoever opens has started anew.
FIRST_ATTEMPT = r"Opening rocksdb partition on .* attempt=1$"

# Table options in a store's own log, and the values that betray dropped options.
CAPACITY = r"capacity\s+:\s+(\d+)"
FILTER_POLICY = r"filter_policy:\s*(\S+)"
DEFAULT_CAPACITY = 8388608
NO_FILTER = "nullptr"


def captured(text: Column, pattern: str) -> Column:
    """First group of `pattern` as a number, null where it does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("bigint"))


def labels(text: Column, patterns: dict[str, str]) -> Column:
    """Array of the labels whose pattern occurs in `text`."""
    return F.array_compact(
        F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()])
    )
