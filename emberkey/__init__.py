"""Keyed state with event-time expiry, state-table upkeep and a partitioned lake, on Spark."""
