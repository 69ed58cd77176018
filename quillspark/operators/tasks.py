"""Tasks and their items: the projection of items on their task, claimable items, and where stored counters disagree.

Items have task_id, ordinal, status, attempts, paused_attempts, released_attempts, waiting_reason, dependency_key,
next_attempt_at, is_live (a running item whose worker is alive), failure_stage. Tasks have task_id, queue, kind, status,
pause_state, created_at, next_attempt_at, is_deleted, total_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# States of items and tasks, and what the scheduler keeps apart.
STATUSES = ("queued", "running", "waiting", "succeeded", "failed", "cancelled")
OPEN = STATUSES[:3]
REBUILD = "vector_rebuild"
MOST_ATTEMPTS = 5


def rollup(items: DataFrame) -> DataFrame:
    """Of each task: its item count, a counter for each status, the current item (the first open one), the first failure's stage and the first failure's message. Items may have stage and
    error_message too."""
    open_ordinal, is_failed = F.when(F.col("status").isin(*OPEN), F.col("ordinal")), F.col("status") == "failed"
    failed_ordinal = F.when(is_failed & F.col("failure_stage").isNotNull(), F.col("ordinal"))
    had = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    return items.groupBy("task_id").agg(
        F.count("*").alias("n_items"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        F.min_by(F.struct("ordinal", "status", had("stage").alias("stage"), "waiting_reason", "dependency_key", "next_attempt_at"), open_ordinal).alias("current"),
        F.min_by("failure_stage", failed_ordinal).alias("failure_stage"),
        F.min_by(had("error_message"), F.when(is_failed & had("error_message").isNotNull(), F.col("ordinal"))).alias("error_summary"),
    )


def _projected(total: Column) -> Column:
    n_open = F.col("n_queued") + F.col("n_running") + F.col("n_waiting")
    done = F.col("n_succeeded") + F.col("n_failed") + F.col("n_cancelled") == total
    return (
        F.when((F.col("status") == "cancelled") & (n_open == 0), "cancelled")
        .when(F.col("n_cancelled") == total, "cancelled")
        .when(done & (F.col("n_failed") == 0), "succeeded")
        .when(done, "failed")
        .when(F.col("current.status").isNull(), "queued")
        .otherwise(F.col("current.status"))
    )


def project(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """The status, pause state and current item that each task with items should have."""
    rows = tasks.drop("stage", "waiting_reason", "dependency_key", "next_attempt_at").join(rollup(items), "task_id")
    done = F.col("n_succeeded") + F.col("n_failed") + F.col("n_cancelled") == F.col("total_count")
    ended = ((F.col("status") == "cancelled") & (F.col("n_queued") + F.col("n_running") + F.col("n_waiting") == 0)) | (F.col("n_cancelled") == F.col("total_count")) | done
    return rows.select(
        "task_id", *[f"n_{s}" for s in STATUSES], "failure_stage", "error_summary", F.col("current.ordinal").alias("current"),
        *[F.col(f"current.{c}").alias(c) for c in ("stage", "waiting_reason", "dependency_key", "next_attempt_at")], _projected(F.col("total_count")).alias("status"), F.when(ended, "unpaused").otherwise(F.col("pause_state")).alias("pause_state"),
    )


def gates(tasks: DataFrame, items: DataFrame, eligible: DataFrame, now: Column) -> DataFrame:
    """Of each queue that a rebuild holds or waits for: mode (rebuild or drain) and the rebuild's task. Other queues are in normal mode."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    runnable = eligible.where(F.col("kind") == REBUILD).join(tasks.where(~F.col("is_deleted") & F.col("status").isin(*OPEN) & due).select("task_id"), "task_id", "left_semi")
    waiting = runnable.groupBy("queue").agg(F.min_by("task_id", F.struct("created_at", "task_id")).alias("runnable"))
    live = items.where((F.col("status") == "running") & F.col("is_live")).select("task_id").join(tasks.select("task_id", "queue", "kind"), "task_id")
    running = live.groupBy("queue").agg(
        F.min(F.when(F.col("kind") == REBUILD, F.col("task_id"))).alias("rebuilding"), F.coalesce(F.bool_or(F.col("kind") != REBUILD), F.lit(False)).alias("ordinary")
    )
    both = running.join(waiting, "queue", "full").where("rebuilding is not null or runnable is not null")
    mode = F.when(F.col("rebuilding").isNull() & F.coalesce("ordinary", F.lit(False)), "drain").otherwise("rebuild")
    return both.select("queue", mode.alias("mode"), F.coalesce("rebuilding", "runnable").alias("rebuild_task"))


def claimable(tasks: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The items that may be claimed now: of each task the first open one, if it waits for nothing, has attempts left, is due and its task is
    open, unpaused and due; and if no rebuild gates the queue, or it is the rebuild's own."""
    first = F.min_by(F.struct(*[c for c in items.columns if c != "task_id"]), "ordinal")
    current = items.where(F.col("status").isin(*OPEN)).groupBy("task_id").agg(first.alias("item"))
    used = F.col("item.attempts") - F.col("item.paused_attempts") - F.col("item.released_attempts")
    is_waiting, reason = F.col("item.status") == "waiting", F.coalesce("item.waiting_reason", F.lit(""))
    parked = is_waiting & ((reason == "docling") | ((reason == "dependency") & F.coalesce(F.col("item.dependency_key") == "vector_rebuild_paused", F.lit(False))))
    due = lambda c: F.col(c).isNull() | (F.col(c) <= now)
    usable = F.col("item.status").isin("queued", "waiting") & (used < MOST_ATTEMPTS) & due("item.next_attempt_at") & ~parked
    eligible = current.where(usable).join(tasks.where("pause_state = 'unpaused'"), "task_id")
    gate = gates(tasks, items, eligible.select("task_id", "queue", "kind", "created_at"), now)
    admitted = eligible.where(F.col("status").isin(*OPEN) & ~F.col("is_deleted") & due("next_attempt_at")).join(gate, "queue", "left")
    free = F.col("mode").isNull() | ((F.col("mode") == "rebuild") & (F.col("task_id") == F.col("rebuild_task")))
    return admitted.where(free).select("task_id", F.col("item.ordinal").alias("ordinal"), "queue", F.coalesce("mode", F.lit("normal")).alias("mode"))


def consistency(tasks: DataFrame, stored: DataFrame, items: DataFrame) -> DataFrame:
    """(task_id, field, stored, actual) of every counter of ``stored`` that differs from the items. Tasks without items count as zeros."""
    fields = ["n_items", *[f"n_{s}" for s in STATUSES]]
    actual = rollup(items).select("task_id", *[F.col(f).alias(f"{f}_now") for f in fields])
    rows = tasks.where(~F.col("is_deleted")).select("task_id").join(stored.select("task_id", *fields), "task_id", "left").join(actual, "task_id", "left")
    rows = rows.na.fill(0, [f"{f}_now" for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("stored"), F.col(f"{f}_now").alias("actual")) for f in fields])
    return rows.select("task_id", F.explode(F.filter(pairs, lambda p: ~p["stored"].eqNullSafe(p["actual"]))).alias("p")).select("task_id", "p.field", "p.stored", "p.actual")


#: What a task stores of its items, in the order in which mismatches are named. Absent and empty texts are the same.
STORED = ("status", "total_count", *(f"{s}_count" for s in STATUSES), "stage", "waiting_reason", "dependency_key")
NEARLY_EXHAUSTED = 4


def facts(tasks: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Each task that isn't deleted with what its items say: counters, the current item, live, lapsed, nearly exhausted and claimable items, and the status they imply.

    tasks also have stage, waiting_reason, dependency_key, the stored counters (queued_count ...), lease_until and started_at; items stage and lease_until.
    A task without items counts as zeros.
    """
    is_open, running = F.col("status").isin(*OPEN), F.col("status") == "running"
    used = F.col("attempts") - F.col("paused_attempts") - F.col("released_attempts")
    lapsed = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    counts = items.groupBy("task_id").agg(
        F.count("*").alias("n_items"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        F.count_if(running & (F.col("lease_until").isNull() | (F.col("lease_until") > now))).alias("n_live"), F.count_if(running & lapsed).alias("n_lapsed"),
        F.count_if(is_open & (used >= NEARLY_EXHAUSTED)).alias("n_near"), F.count_if(is_open & (used < MOST_ATTEMPTS)).alias("n_unspent"),
        F.min_by(F.struct("ordinal", "status", "stage", "waiting_reason", "dependency_key"), F.when(is_open, F.col("ordinal"))).alias("current"),
    )
    rows = tasks.where(~F.col("is_deleted")).join(counts, "task_id", "left")
    rows = rows.na.fill(0, [c for c in counts.columns if c.startswith("n_")])
    return rows.withColumn("derived_status", _projected(F.col("total_count"))).withColumn("is_claimable", (F.col("n_unspent") > 0) & (F.col("pause_state") == "unpaused"))


def verdicts(found: DataFrame) -> DataFrame:
    """task_id and mismatch_fields of the rows of facts: the names of the stored fields that the items contradict. A queued task's stage is its entry stage, and isn't compared."""
    text = lambda c: F.coalesce(c, F.lit(""))
    differs = {"status": F.col("status") != F.col("derived_status"), "total_count": F.col("n_items") != F.col("total_count")}
    differs |= {f"{s}_count": F.col(f"n_{s}") != F.col(f"{s}_count") for s in STATUSES}
    differs |= {c: text(F.col(c)) != text(F.col(f"current.{c}")) for c in ("stage", "waiting_reason", "dependency_key")}
    differs["stage"] &= F.col("status") != "queued"
    return found.select("task_id", F.filter(F.array(*[F.when(differs[c], c) for c in STORED]), lambda x: x.isNotNull()).alias("mismatch_fields"))


def gauges(found: DataFrame, now: Column) -> DataFrame:
    """One row over the rows of facts: tasks, active ones, ones that wait for a dependency, running ones without a running item, live items, slots that nothing can
    use, items near their last attempt, the oldest admission of a live slot, and tasks with mismatches."""
    active, leased = F.col("status").isin(*OPEN), F.coalesce(F.col("lease_until") > now, F.lit(False))
    orphan = active & leased & (F.col("n_live") == 0) & ((F.col("n_lapsed") > 0) | ~F.col("is_claimable"))
    wrong = verdicts(found).where(F.size("mismatch_fields") > 0).select("task_id", F.lit(True).alias("_wrong"))
    return found.join(wrong, "task_id", "left").agg(
        F.count("*").alias("tasks"), F.count_if(active).alias("active"), F.count_if(F.col("current.waiting_reason") == "dependency").alias("waiting_for_dependency"),
        F.count_if((F.col("status") == "running") & (F.col("n_running") == 0)).alias("running_without_item"), F.coalesce(F.sum("n_live"), F.lit(0)).alias("live_items"),
        F.count_if(orphan).alias("orphaned_slots"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("nearly_exhausted"),
        F.min(F.when(active & leased, F.col("started_at"))).alias("oldest_admitted"), F.count_if("_wrong").alias("mismatched"),
    )
