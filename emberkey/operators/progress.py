"""Reports over log lines, churn actions and progress samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberkey.functions import markers as M
from emberkey.operators.carry import null_safe_join
from emberkey.operators.enrich import latest_before
from emberkey.operators.ordered import Lane, over_lanes

HOUR_MS = 3_600_000


def extract_markers(lines: DataFrame, patterns: dict[str, str], text: str = "line") -> DataFrame:
    """Each line once per label whose pattern it contains, as column `marker`."""
    return lines.withColumn("marker", F.explode(M.labels(F.col(text), patterns)))


def marker_verdicts(
    lines: DataFrame,
    scenario: str,
    patterns: dict[str, str],
    required: list[str],
    forbidden: list[str],
    text: str = "line",
) -> DataFrame:
    """Per scenario and listed marker: kind, whether it was seen, and whether that is as it should.

    A scenario's lines are reduced to one flag per marker before the shuffle.
    """
    wanted = [*required, *forbidden]
    seen = lines.groupBy(scenario).agg(
        *[F.bool_or(F.col(text).rlike(patterns[m])).alias(f"__{m}") for m in wanted]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("marker"),
                F.lit("required" if m in required else "forbidden").alias("kind"),
                F.coalesce(f"__{m}", F.lit(False)).alias("seen"),
            )
            for m in wanted
        ]
    )
    verdicts = seen.select(scenario, F.inline(rows))
    return verdicts.withColumn("ok", F.col("seen") == (F.col("kind") == "required"))


def captured_count(
    lines: DataFrame, scenario: str, pattern: str, order: list[str], text: str = "line"
) -> DataFrame:
    """Per scenario the number in the first line that matches, null if none does."""
    number = M.captured(F.col(text), pattern)
    at = F.when(number.isNotNull(), F.struct(*order))
    return lines.groupBy(scenario).agg(F.min_by(number, at).alias("captured"))


def store_verdict(lines: DataFrame, store: str = "store", text: str = "line") -> DataFrame:
    """Per store the distinct cache capacities and filter policies it reports, and the verdict.

    Stores that report neither are left out.
    """
    line = F.col(text)
    caps = F.regexp_extract_all(line, F.lit(M.CAPACITY), 1)
    policies = F.regexp_extract_all(line, F.lit(M.FILTER_POLICY), 1)
    found = lines.select(
        store,
        F.explode(
            F.concat(
                F.transform(
                    caps,
                    lambda c: F.struct(
                        c.cast("bigint").alias("cap"), F.lit(None).cast("string").alias("policy")
                    ),
                ),
                F.transform(
                    policies,
                    lambda p: F.struct(
                        F.lit(None).cast("bigint").alias("cap"), p.alias("policy")
                    ),
                ),
            )
        ).alias("f"),
    )
    per_store = found.groupBy(store).agg(
        F.sort_array(F.collect_set("f.cap")).alias("block_cache_capacity"),
        F.sort_array(F.collect_set("f.policy")).alias("filter_policy"),
        F.count("f.cap").alias("cf_count"),
    )
    degraded = F.array_contains(
        "block_cache_capacity", F.lit(M.DEFAULT_CAPACITY).cast("bigint")
    ) | F.array_contains("filter_policy", M.NO_FILTER)
    return per_store.withColumn("degraded", degraded)


def cycle_windows(actions: DataFrame, samples: DataFrame) -> DataFrame:
    """Per deployment and cycle: `start_ms` (its first action) and `end_ms` (excluded).

    A cycle ends where the next one starts, the last one after the last sample. `actions` holds
    deployment, cycle, ts_ms; `samples` deployment, ts_ms.
    """
    starts = actions.groupBy("deployment", "cycle").agg(F.min("ts_ms").alias("start_ms"))
    ends = samples.groupBy("deployment").agg((F.max("ts_ms") + 1).alias("__last"))
    order = Window.partitionBy("deployment").orderBy("start_ms", "cycle")
    return (
        starts.join(ends, "deployment", "left")
        .withColumn("end_ms", F.coalesce(F.lead("start_ms").over(order), "__last"))
        .drop("__last")
    )


def assign_cycles(rows: DataFrame, windows: DataFrame, slot_ms: int = HOUR_MS) -> DataFrame:
    """Rows (deployment, ts_ms, ...) with the `cycle` whose window holds them.

    An equi-join on (deployment, time slot) with the exact range behind it: no range is scanned
    against all rows, a busy slot is split by AQE, and the windows are broadcast only if small.
    """
    slots = F.sequence(F.floor(F.col("start_ms") / slot_ms), F.floor((F.col("end_ms") - 1) / slot_ms))
    spread = windows.filter(F.col("end_ms") > F.col("start_ms")).select(
        F.col("deployment").alias("__d"),
        "cycle",
        F.col("start_ms").alias("__start"),
        F.col("end_ms").alias("__end"),
        F.explode(slots).alias("__slot"),
    )
    match = (
        (F.col("deployment") == F.col("__d"))
        & (F.floor(F.col("ts_ms") / slot_ms) == F.col("__slot"))
        & (F.col("ts_ms") >= F.col("__start"))
        & (F.col("ts_ms") < F.col("__end"))
    )
    return rows.join(spread, match).drop("__d", "__start", "__end", "__slot")


def handover(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per cycle the seconds from its start until the total high-water exceeds its value at the start.

    `samples`: deployment, ts_ms, hwm, where hwm never falls. So the first sample of each hwm value
    is the moment of an advance, and the next advance after the start is the one looked for. Null
    without a sample at or before the start, or without an advance after it.
    """
    advances = samples.groupBy("deployment", "hwm").agg(F.min("ts_ms").alias("ts_ms"))
    base = samples.groupBy("deployment").agg(F.min("ts_ms").alias("__first"))
    # Negated times turn "latest before" into "first strictly after".
    refs = windows.withColumn("__at", -F.col("start_ms") - 1)
    later = advances.select("deployment", "ts_ms", (-F.col("ts_ms")).alias("__neg"))
    found = latest_before(refs, later, "deployment", ["__at"], ["__neg"], "__n")
    return (
        found.join(base, "deployment", "left")
        .withColumn(
            "handover_s",
            F.when(
                F.col("__first") <= F.col("start_ms"),
                (F.col("__n.ts_ms") - F.col("start_ms")) / 1000.0,
            ),
        )
        .select("deployment", "cycle", "handover_s")
    )


def longest_stall(samples_in_cycles: DataFrame) -> DataFrame:
    """Per cycle the longest span of samples without any advance, in seconds.

    As hwm never falls, samples with one value form one span; no ordering is needed.
    """
    spans = samples_in_cycles.groupBy("deployment", "cycle", "hwm").agg(
        (F.max("ts_ms") - F.min("ts_ms")).alias("span")
    )
    return spans.groupBy("deployment", "cycle").agg(
        (F.max("span") / 1000.0).alias("longest_output_stall_s")
    )


def cycle_report(actions: DataFrame, samples: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per cycle and deployment; `lines` holds deployment, ts_ms, line."""
    windows = cycle_windows(actions, samples)
    line = F.col("line")
    has = {m: line.rlike(p) for m, p in M.HANDOVER_MARKERS.items()}
    counted = (
        assign_cycles(lines, windows)
        .groupBy("deployment", "cycle")
        .agg(
            F.count_if(has["lock_retry"]).alias("lock_retry_count"),
            F.max(M.captured(line, M.ATTEMPT_OF_MAX)).alias("__attempt"),
            F.max(M.captured(line, M.ATTEMPT_DEPTH)).alias("__depth"),
            F.count_if(has["eviction"]).alias("evictions"),
            F.bool_or(has["fast_revoke"]).alias("fast_revoke_seen"),
            F.bool_or(has["orphan_resume"]).alias("orphan_resume_seen"),
            F.bool_or(has["open_budget"]).alias("open_budget_hit"),
            F.bool_or(has["revoke_timeout"]).alias("revoke_flush_timeout"),
        )
    )
    stall = longest_stall(assign_cycles(samples, windows))
    at = ["deployment", "cycle"]
    rows = null_safe_join(windows.select(*at), handover(windows, samples), at, "left")
    rows = null_safe_join(rows, counted, at, "left")
    rows = null_safe_join(rows, stall, at, "left")
    no = F.lit(False)
    return rows.select(
        "cycle",
        "deployment",
        "handover_s",
        F.coalesce("lock_retry_count", F.lit(0)).alias("lock_retry_count"),
        F.coalesce("__attempt", "__depth", F.lit(0)).alias("max_lock_attempt"),
        F.coalesce("evictions", F.lit(0)).alias("evictions"),
        F.coalesce("fast_revoke_seen", no).alias("fast_revoke_seen"),
        F.coalesce("orphan_resume_seen", no).alias("orphan_resume_seen"),
        "longest_output_stall_s",
        F.coalesce("open_budget_hit", no).alias("open_budget_hit"),
        F.coalesce("revoke_flush_timeout", no).alias("revoke_flush_timeout"),
    )


def cycle_criteria(
    report: DataFrame,
    feature: list[str],
    max_attempt: int = 2,
    stall_s: float = 60.0,
    storm_retries: int = 10,
) -> DataFrame:
    """Per deployment the criteria over all its cycles and the verdict.

    Deployments in `feature` pass or fail; without progress samples in some cycle they can't pass and
    are `inconclusive`. The others are expected to show trouble: `degraded` if a
    cycle stalls for `stall_s`, or has an eviction together with a retry storm (more than
    `max_attempt` attempts on a lock or at least `storm_retries` retries); else `inconclusive`.
    """
    stall = F.coalesce("longest_output_stall_s", F.lit(0.0))
    storm = (F.col("max_lock_attempt") > max_attempt) | (F.col("lock_retry_count") >= storm_retries)
    found = report.groupBy("deployment").agg(
        F.bool_and(F.col("max_lock_attempt") <= max_attempt).alias("bounded_lock_retries"),
        F.bool_or("fast_revoke_seen").alias("fast_revoke_present"),
        F.bool_and(stall < stall_s).alias("bounded_output_stall"),
        F.bool_or(F.coalesce("longest_output_stall_s", "handover_s").isNull()).alias("__unseen"),
        F.bool_and(F.col("evictions") == 0).alias("no_eviction"),
        F.bool_and(~F.col("open_budget_hit") & ~F.col("revoke_flush_timeout")).alias(
            "budgets_not_exhausted"
        ),
        F.bool_or(((F.col("evictions") > 0) & storm) | (stall >= stall_s)).alias("degraded_seen"),
    )
    passed = (
        F.col("bounded_lock_retries")
        & F.col("fast_revoke_present")
        & F.col("bounded_output_stall")
        & F.col("no_eviction")
        & F.col("budgets_not_exhausted")
    )
    return found.withColumn(
        "verdict",
        F.when(
            F.col("deployment").isin(feature),
            F.when(passed & F.col("__unseen"), "inconclusive").when(passed, "pass").otherwise("fail"),
        )
        .when(F.col("degraded_seen"), "degraded")
        .otherwise("inconclusive"),
    ).drop("__unseen")


def lock_restarts(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Per deployment and cycle, how often somebody started anew right after failing to get a lock.

    Of the lines that tell of a lock not got or of a first attempt to open, in order of time (at one time failures first), it counts the
    first attempts that follow a failure. A first attempt after another one is the next partition.
    """
    line = F.col("line")
    started = F.when(line.rlike(M.HANDOVER_MARKERS["lock_retry"]), 0).when(line.rlike(M.FIRST_ATTEMPT), 1)
    told = assign_cycles(lines.withColumn("__started", started).filter("__started is not null"), windows)
    at = ["deployment", "cycle"]

    def follow(rows: DataFrame, lane: Lane) -> DataFrame:
        return lane.previous(rows, "__prev", {"started": F.col("__started")})

    rows = over_lanes(told.select(*at, "ts_ms", "__started"), at, ["ts_ms", "__started"], follow)
    again = (F.col("__started") == 1) & (F.col("__prev.started") == 0)
    counted = rows.groupBy(*at).agg(F.count_if(again).alias("lock_restarts"))
    out = null_safe_join(windows.select(*at), counted, at, "left")
    return out.withColumn("lock_restarts", F.coalesce("lock_restarts", F.lit(0)))


def all_criteria(
    report: DataFrame, restarts: DataFrame, feature: list[str], loop: int = 2, **options
) -> DataFrame:
    """`cycle_criteria` with what restarts and the build's own marker say.

    `no_crash_loop`: no restart in any cycle; `crash_loop_seen`: at least `loop` in one, which makes a deployment
    that isn't in `feature` degraded; `build_as_expected`: a fast revoke was logged if, and only if, the deployment is in `feature`.
    A feature deployment passes only without restarts. One of the others with the wrong build is `inconclusive`, whatever it shows.
    """
    seen = restarts.groupBy("deployment").agg(
        F.bool_and(F.col("lock_restarts") == 0).alias("no_crash_loop"),
        F.bool_or(F.col("lock_restarts") >= loop).alias("crash_loop_seen"),
    )
    rows = null_safe_join(cycle_criteria(report, feature, **options), seen, ["deployment"], "left")
    ours = F.col("deployment").isin(feature)
    rows = rows.withColumn("build_as_expected", F.col("fast_revoke_present") == ours)
    verdict = (
        F.when(ours & (F.col("verdict") != "fail") & ~F.col("no_crash_loop"), "fail")
        .when(ours, F.col("verdict"))
        .when(~F.col("build_as_expected"), "inconclusive")
        .when(F.col("crash_loop_seen"), "degraded")
        .otherwise(F.col("verdict"))
    )
    return rows.withColumn("verdict", verdict)
