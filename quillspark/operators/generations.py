"""Generations of a repository's snapshot: publishing, retention, and proofs of a rebuilt snapshot against the live one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F


def publish(generations: DataFrame, sources: DataFrame, active: DataFrame, built: DataFrame) -> DataFrame:
    """The generations' next states: repository, generation, status, is_active.

    A built generation (repository, generation, revision, target) becomes ready and active if it is still building and its source still
    has that revision and target, is enabled and not being deleted; the active ready one before it is superseded. Else nothing changes.
    """
    current = sources.where("is_enabled and not is_deleting").select("repository", "revision", F.col("target").alias("wanted"))
    good = built.join(current, ["repository", "revision"]).where(F.col("target").eqNullSafe(F.col("wanted")))
    good = good.join(generations.where("status = 'building'").select("repository", "generation"), ["repository", "generation"], "left_semi")
    now = good.groupBy("repository").agg(F.max("generation").alias("published"))
    rows = generations.join(active.select("repository", F.col("generation").alias("active")), "repository", "left").join(now, "repository", "left")
    is_new = F.coalesce(F.col("generation") == F.col("published"), F.lit(False))
    was_active = F.coalesce(F.col("generation") == F.col("active"), F.lit(False))
    left = was_active & F.col("published").isNotNull() & ~is_new
    status = F.when(is_new, "ready").when(left & (F.col("status") == "ready"), "superseded").otherwise(F.col("status"))
    return rows.select("repository", "generation", status.alias("status"), (is_new | (was_active & ~left)).alias("is_active"))


def removable(generations: DataFrame, active: DataFrame, keep: int, now: Column, abandoned_after: str = "1 hour") -> DataFrame:
    """(repository, generation) that may be removed: successful ones behind the ``keep`` latest or still owing their cleanup, failed ones,
    and those that have been building too long; never the active one, nor one whose next try isn't due."""
    good = F.col("status").isin("ready", "superseded")
    rank = F.row_number().over(Window.partitionBy("repository", good).orderBy(F.desc("number")))
    rows = generations.withColumn("rank", rank)  # ranks count among the successful ones, the active one included
    old = good & ((F.col("rank") > keep) | F.col("cleanup_pending"))
    stuck = (F.col("status") == "building") & (F.col("started_at") < now - F.expr(f"interval {abandoned_after}"))
    due = ~F.col("cleanup_pending") | F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    rows = rows.where((old | stuck | (F.col("status") == "failed")) & due).select("repository", "generation")
    return rows.join(active.select("repository", "generation"), ["repository", "generation"], "left_anti")


def manifest(old: DataFrame, new: DataFrame, key: list[str], owner: str) -> DataFrame:
    """The manifest with the files of every owner in ``new`` replaced by its new ones; an owner whose new files repeat a key keeps its old
    ones, as a whole."""
    wrong = new.groupBy(owner, *key).count().where("count > 1").select(owner).distinct()
    fine = new.join(wrong, owner, "left_anti")
    return old.join(fine.select(owner).distinct(), owner, "left_anti").unionByName(fine)


def verify_rebuild(live: DataFrame, staged: DataFrame, chunks: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """One row of counters: staged documents that are gone or changed, whose chunk count is wrong, chunks of another hash than their
    document's with translated chunks of another hash than the live document's, staged documents, and live documents that aren't staged.

    live has (document_id, record_hash), staged also chunk_count, chunks and the staged translations (document_id, record_hash).
    """
    per_document = chunks.join(staged.select("document_id", F.col("record_hash").alias("want")), "document_id").groupBy("document_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("record_hash") != F.col("want")).alias("wrong")
    )
    rows = staged.select("document_id", F.col("record_hash").alias("staged_hash"), "chunk_count").join(live, "document_id", "full").join(per_document, "document_id", "left")
    if translations is not None:
        stale = translations.join(live.select("document_id", F.col("record_hash").alias("_now")), "document_id").where("record_hash <> _now").groupBy("document_id").agg(F.count("*").alias("stale"))
        rows = rows.join(stale, "document_id", "left")
    wrong = F.coalesce("wrong", F.lit(0)) + (F.coalesce("stale", F.lit(0)) if translations is not None else F.lit(0))
    is_staged, is_live = F.col("chunk_count").isNotNull(), F.col("record_hash").isNotNull()
    return rows.agg(
        F.count_if(is_staged & (~is_live | (F.col("staged_hash") != F.col("record_hash")))).alias("document_hash_mismatch"),
        F.count_if(is_staged & (F.col("chunk_count") != F.coalesce("n", F.lit(0)))).alias("chunk_count_mismatch"),
        F.coalesce(F.sum(wrong), F.lit(0)).alias("chunk_hash_mismatch"),
        F.count_if(is_staged).alias("staged_documents"),
        F.count_if(is_live & ~is_staged).alias("document_membership_mismatch"),
    )


def page_mismatches(staged: DataFrame, live: DataFrame, fields: list[str], low: tuple[int, int] | None = None, high: tuple[int, int] | None = None) -> DataFrame:
    """The staged rows of the page (low, high] of (document_id, chunk_index) and, in ``differs``, whether the live row lacks or has another field."""
    keys = ["document_id", "chunk_index"]
    beyond = lambda at, op: F.expr(f"document_id {op} {int(at[0])} or (document_id = {int(at[0])} and chunk_index {op}{'=' * (op == '<')} {int(at[1])})")
    page = staged if low is None else staged.where(beyond(low, ">"))
    page = page if high is None else page.where(beyond(high, "<"))
    other = live.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    differs = reduce(or_, [~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields], F.col("_there").isNull())
    return page.join(other, keys, "left").select(*keys, differs.alias("differs"))


def free_names(new: DataFrame, taken: DataFrame, folder: str = "folder", name: str = "name", order: str = "id") -> DataFrame:
    """Each new row with ``free_name``: its name if no file of its folder has it, else the first of "stem (2).ext", "stem (3).ext" ... that is free.

    Rows of one name take free names in their order. Names that other new rows bring count as taken for numbered ones.
    """
    rows = new.withColumn("_place", F.row_number().over(Window.partitionBy(folder, name).orderBy(order)))
    wanted = rows.groupBy(folder, name).agg(F.count("*").alias("_n"))
    # No more numbers are taken than there are names of that form, so one of so many more than are wanted is free.
    form = r"(?s)^(.*) \(\d+\)(\.[^.]*)?$"
    names = taken.select(folder, name).unionByName(wanted.select(folder, name)).distinct()
    numbered = names.where(F.col(name).rlike(form)).groupBy(folder, F.regexp_replace(name, form, "$1$2").alias(name)).agg(F.count("*").alias("_m"))
    tries = wanted.join(numbered, [folder, name], "left")
    last = F.col("_n") + F.coalesce("_m", F.lit(0)) + 1
    tries = tries.select(folder, name, F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("_k"))
    stem = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1)
    extension = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    free_name = F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_k").cast("string"), F.lit(")"), extension))
    held = taken.select(folder, F.col(name).alias("free_name"), F.lit(True).alias("_held")).distinct()
    brought = wanted.select(folder, F.col(name).alias("free_name"), F.lit(True).alias("_brought"))
    tries = tries.withColumn("free_name", free_name).join(held, [folder, "free_name"], "left").join(brought, [folder, "free_name"], "left")
    tries = tries.where("_held is null and (_k = 1 or _brought is null)").withColumn("_place", F.row_number().over(Window.partitionBy(folder, name).orderBy("_k")))
    return rows.join(tries.select(folder, name, "_place", "free_name"), [folder, name, "_place"]).drop("_place")
