"""Markers, store verdicts, cycle windows and the report."""

import pytest

from emberkey.functions import markers as M
from emberkey.operators import progress

ACTIONS = "deployment string, cycle int, ts_ms bigint"
SAMPLES = "deployment string, ts_ms bigint, hwm bigint"
LINES = "deployment string, ts_ms bigint, line string"


@pytest.fixture
def churn(spark):
    """Two cycles of one deployment, sampled each second."""
    actions = [("d", 1, 1000), ("d", 1, 4000), ("d", 2, 9000)]
    high = [5, 5, 5, 7, 8, 8, 8, 8, 9, 9, 9, 10]  # seconds 0 .. 11
    samples = [("d", s * 1000, h) for s, h in enumerate(high)]
    lines = [
        ("d", 500, "cannot acquire a lock (attempt 9/10)"),  # before the first cycle
        ("d", 1000, 'on "/s/1", cannot acquire a lock (attempt 1/10). Retrying'),
        ("d", 2000, 'on "/s/1", cannot acquire a lock (attempt 2/10). Retrying'),
        ("d", 8999, "Fast revoke: skipping local state flush"),
        ("d", 9000, 'Opening rocksdb partition on "/s/1" attempt=7'),
        ("d", 9500, "Application maximum poll interval (60000ms) exceeded"),
        ("d", 9600, "Revoke: sink x flush timed out"),
        ("d", 11000, "Open budget exhausted for rocksdb partition on /s/1"),
    ]
    make = spark.createDataFrame
    return make(actions, ACTIONS), make(samples, SAMPLES), make(lines, LINES)


def test_windows_are_half_open(churn):
    actions, samples, _ = churn
    got = {r["cycle"]: (r["start_ms"], r["end_ms"]) for r in progress.cycle_windows(actions, samples).collect()}
    assert got == {1: (1000, 9000), 2: (9000, 11001)}


@pytest.mark.parametrize("slot_ms", [700, 3_600_000])
def test_report(churn, slot_ms):
    report = {r["cycle"]: r.asDict() for r in progress.cycle_report(*churn).collect()}
    assert report[1] == {
        "cycle": 1, "deployment": "d", "handover_s": 2.0, "lock_retry_count": 2,
        "max_lock_attempt": 2, "evictions": 0, "fast_revoke_seen": True,
        "orphan_resume_seen": False, "longest_output_stall_s": 3.0, "open_budget_hit": False,
        "revoke_flush_timeout": False,
    }
    assert report[2] == {
        "cycle": 2, "deployment": "d", "handover_s": 2.0, "lock_retry_count": 0,
        "max_lock_attempt": 7, "evictions": 1, "fast_revoke_seen": False,
        "orphan_resume_seen": False, "longest_output_stall_s": 1.0, "open_budget_hit": True,
        "revoke_flush_timeout": True,
    }
    actions, samples, lines = churn
    windows = progress.cycle_windows(actions, samples)
    assigned = progress.assign_cycles(lines, windows, slot_ms)
    assert sorted(r["cycle"] for r in assigned.collect()) == [1, 1, 1, 2, 2, 2, 2]


def test_handover_needs_a_baseline_and_an_advance(spark):
    samples = spark.createDataFrame([("d", 2000, 5), ("d", 3000, 6)], SAMPLES)
    actions = spark.createDataFrame([("d", 1, 1000), ("d", 2, 2000), ("d", 3, 3000)], ACTIONS)
    windows = progress.cycle_windows(actions, samples)
    got = {r["cycle"]: r["handover_s"] for r in progress.handover(windows, samples).collect()}
    assert got == {1: None, 2: 1.0, 3: None}


def test_criteria(spark):
    schema = (
        "cycle int, deployment string, handover_s double, lock_retry_count bigint, "
        "max_lock_attempt bigint, evictions bigint, fast_revoke_seen boolean, "
        "orphan_resume_seen boolean, longest_output_stall_s double, open_budget_hit boolean, "
        "revoke_flush_timeout boolean"
    )
    rows = [
        (1, "good", 1.0, 1, 1, 0, True, False, 5.0, False, False),
        (2, "good", 1.0, 0, 0, 0, False, False, None, False, False),
        (1, "bad", 1.0, 1, 3, 0, True, False, 5.0, False, False),
        (1, "stuck", 1.0, 0, 0, 0, False, False, 60.0, False, False),
        (1, "storm", 1.0, 40, 0, 1, False, False, 1.0, False, False),
        (1, "quiet", 1.0, 0, 0, 0, False, False, 1.0, False, False),
        (1, "evicted_only", 1.0, 0, 0, 1, False, False, 1.0, False, False),
    ]
    out = progress.cycle_criteria(spark.createDataFrame(rows, schema), ["good", "bad"])
    assert {r["deployment"]: r["verdict"] for r in out.collect()} == {
        "good": "pass", "bad": "fail", "stuck": "degraded", "storm": "degraded",
        "quiet": "inconclusive", "evicted_only": "inconclusive",
    }


def test_migration_markers(spark):
    lines = spark.createDataFrame(
        [
            ("A", 1, "[INFO] TTL legacy backfill STARTED: chunk=50"),
            ("A", 2, "[INFO] TTL legacy backfill FINISHED: 10"),
            ("A", 3, "Backfilled 90742 legacy records and flipped state store partition"),
            ("A", 4, "Backfilled 5 legacy records and flipped state store partition"),
            ("B", 1, "TTL legacy backfill STARTED:"),
            ("B", 2, "Fail-safe TTL read: value"),
        ],
        "scenario string, n int, line string",
    )
    got = progress.marker_verdicts(
        lines, "scenario", M.MIGRATION_MARKERS, ["started", "finished"], ["failsafe_read"]
    )
    assert {(r["scenario"], r["marker"]) for r in got.filter("not ok").collect()} == {
        ("B", "finished"), ("B", "failsafe_read")
    }
    count = progress.captured_count(lines, "scenario", M.MIGRATION_MARKERS["flip"], ["n"])
    assert {r["scenario"]: r["captured"] for r in count.collect()} == {"A": 90742, "B": None}
    marked = progress.extract_markers(lines, M.MIGRATION_MARKERS)
    assert marked.count() == 6


def test_store_verdict(spark):
    lines = spark.createDataFrame(
        [
            ("s1", "  capacity : 134217728"), ("s1", " filter_policy: bloomfilter"),
            ("s1", "  capacity : 134217728"), ("s1", "capacity: 128"),
            ("s2", "block_cache: capacity : 8388608 filter_policy: nullptr"),
            ("s3", "filter_policy: nullptr"), ("s4", "nothing here"),
        ],
        "store string, line string",
    )
    got = {r["store"]: tuple(r)[1:] for r in progress.store_verdict(lines).collect()}
    assert got == {
        "s1": ([134217728], ["bloomfilter"], 2, False),
        "s2": ([8388608], ["nullptr"], 1, True),
        "s3": ([], ["nullptr"], 0, True),
    }


def test_all_criteria_and_every_marker(spark):
    """Each deployment shows one thing more than the clean ones."""
    lock, first, fast = (
        "Failed to open rocksdb partition , cannot acquire a lock. Retrying in 3sec.",
        'Opening rocksdb partition on "/state/3" attempt=1',
        "Fast revoke: skipping local state flush",
    )
    told = {
        "clean": [fast, first, first],
        "budget": [fast, "Open budget exhausted"],
        "flush": [fast, "Revoke: sink flush timed out"],
        "evicted": [fast, "Application maximum poll interval (60000ms) exceeded"],
        "orphan": [fast, "Resuming data partitions paused for recovery"],
        "restarted": [fast, lock, first],
        "no-marker": [first],
        "old": [lock, lock, first, lock, first, first],
        "old-once": [lock, first],
        "wrong-build": [fast, lock, first, lock, first],
        "quiet": [],
    }
    names = list(told)
    actions = spark.createDataFrame([(d, c, c * 10_000) for d in names for c in (1, 2)], "deployment string, cycle int, ts_ms bigint")
    samples = spark.createDataFrame([(d, 10_000 + 500 * k, k) for d in names for k in range(41)], "deployment string, ts_ms bigint, hwm bigint")
    lines = [(d, 11_000 + k, line) for d in names for k, line in enumerate(told[d])]
    lines = spark.createDataFrame(lines, "deployment string, ts_ms bigint, line string")
    report = progress.cycle_report(actions, samples, lines)
    restarts = progress.lock_restarts(lines, progress.cycle_windows(actions, samples))
    counted = {(r["deployment"], r["cycle"]): r["lock_restarts"] for r in restarts.collect()}
    assert len(counted) == 2 * len(names)
    assert {k: n for k, n in counted.items() if n} == {("restarted", 1): 1, ("old", 1): 2, ("old-once", 1): 1, ("wrong-build", 1): 2}
    seen = {r["deployment"]: r for r in report.filter("cycle = 1").collect()}
    assert [d for d in names if seen[d]["open_budget_hit"]] == ["budget"] and [d for d in names if seen[d]["revoke_flush_timeout"]] == ["flush"]
    assert [d for d in names if seen[d]["orphan_resume_seen"]] == ["orphan"] and [d for d in names if seen[d]["evictions"]] == ["evicted"]
    feature = ["clean", "budget", "flush", "evicted", "orphan", "restarted", "no-marker"]
    out = {r["deployment"]: r for r in progress.all_criteria(report, restarts, feature).collect()}
    assert {d: out[d]["verdict"] for d in names} == {
        "clean": "pass", "budget": "fail", "flush": "fail", "evicted": "fail", "orphan": "pass", "restarted": "fail", "no-marker": "fail",
        "old": "degraded", "old-once": "inconclusive", "wrong-build": "inconclusive", "quiet": "inconclusive",
    }
    assert [d for d in names if not out[d]["build_as_expected"]] == ["no-marker", "wrong-build"]
    assert [d for d in names if not out[d]["no_crash_loop"]] == ["restarted", "old", "old-once", "wrong-build"]
