"""Who may see what, what is hidden or excluded, which sources are due, and limits of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# States of points that readers don't see yet, and limits of a code snapshot.
HIDDEN_STATES = ("staged", "pending")
MOST_FILES, MOST_FILE_BYTES, MOST_TOTAL_BYTES = 16_384, 8 << 20, 64 << 20
LEAST_RETRY_SECONDS = 60


@dataclass(frozen=True)
class Scope:
    """The groups a reader is a member of, a group path that the request is bound to (and whether it is known), and an allow-list."""

    private: tuple = ()
    path: str | None = None
    path_is_known: bool = True
    allowed: tuple | None = None


def visible(scope: Scope, group: str = "group_id", visibility: str = "visibility", path: str = "full_path") -> Column:
    """Public rows and those of the reader's groups, within the path and the allow-list. An unknown path or an empty list sees nothing."""
    if (scope.path is not None and not scope.path_is_known) or scope.allowed == ():
        return F.lit(False)
    out = F.col(visibility) == "public"
    if scope.private:
        out = out | F.col(group).isin(*scope.private)
    if scope.path is not None:
        out = out & (F.col(path) == scope.path)
    if scope.allowed is not None:
        out = out & F.col(group).isin(*scope.allowed)
    return F.coalesce(out, F.lit(False))


def not_hidden(state: Column) -> Column:
    return ~F.coalesce(state, F.lit("")).isin(*HIDDEN_STATES)


def excluded_ids(registry: DataFrame, kind: str) -> DataFrame:
    """(id) that readers leave out: of a registry of (kind, phase, staged_ids, retired_ids), the staged ones before the switch, the retired
    ones after it, both in a phase that isn't known."""
    ids = F.when(F.col("phase") == "staging", F.col("staged_ids")).when(F.col("phase") == "retiring", F.col("retired_ids")).otherwise(F.concat("staged_ids", "retired_ids"))
    return registry.where(F.col("kind") == kind).select(F.explode(ids).alias("id")).distinct()


def due_sources(sources: DataFrame, open_tasks: DataFrame, now: Column) -> DataFrame:
    """The sources to refresh: enabled, not being deleted, without an open task, tried LEAST_RETRY_SECONDS ago at least, and either dirty
    or an interval past the last indexing and the last try. Sources have key, is_enabled, is_deleting, is_dirty, interval_seconds,
    created_at, indexed_at, tried_at."""
    seconds = lambda c: F.unix_timestamp(c)
    rested = F.col("tried_at").isNull() | (seconds(F.col("tried_at")) <= seconds(now) - LEAST_RETRY_SECONDS)
    last = F.greatest(F.coalesce("indexed_at", "created_at"), F.coalesce("tried_at", "created_at"))
    elapsed = F.col("interval_seconds").isNotNull() & (seconds(last) + F.col("interval_seconds") <= seconds(now))
    rows = sources.where(F.col("is_enabled") & ~F.col("is_deleting") & rested & (F.col("is_dirty") | elapsed))
    return rows.join(open_tasks.select("key"), "key", "left_anti")


def snapshot_verdicts(files: DataFrame, owner: str, sha: str = "sha", size: str = "bytes") -> DataFrame:
    """Of each owner's snapshot, the first limit it breaks: too_many_files, too_many_blobs, file_too_large, total_too_large, or ok. Every
    distinct blob counts once."""
    blobs = files.groupBy(owner, sha).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    sums = blobs.groupBy(owner).agg(F.sum("n").alias("files"), F.count("*").alias("blobs"), F.max("size").alias("largest"), F.sum("size").alias("total"))
    verdict = (
        F.when(F.col("files") > MOST_FILES, "too_many_files").when(F.col("blobs") > MOST_FILES, "too_many_blobs")
        .when(F.col("largest") > MOST_FILE_BYTES, "file_too_large").when(F.col("total") > MOST_TOTAL_BYTES, "total_too_large").otherwise("ok")
    )
    return sums.select(owner, "files", "blobs", "total", verdict.alias("verdict"))


def safe_ref(ref: Column) -> Column:
    """A branch or tag name: 1 to 255 characters, no control or special characters, no empty, dotted or locked segment."""
    wrong = r"[\x00-\x20\x7f~^:?*\[\\]|\.\.|@\{|//|^/|/$|^\.|/\.|\.$|\.lock(/|$)|^-|^@$"
    return F.coalesce((F.length(ref) >= 1) & (F.length(ref) <= 255) & ~ref.rlike(wrong), F.lit(False))


def safe_sha(sha: Column) -> Column:
    """A commit's name: 40 or 64 lower-case hex digits."""
    return F.coalesce(sha.rlike(r"^([0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False))


def safe_path(path: Column, most_depth: int = 32, most_chars: int = 1024) -> Column:
    """A relative path within the depth and length, without control characters, backslashes and empty, "." or ".." segments."""
    wrong = r"[\x00-\x1f\x7f\\]|^/|/$|//|(^|/)\.\.?(/|$)"
    return F.coalesce((path != "") & (F.length(path) <= most_chars) & (F.size(F.split(path, "/")) <= most_depth) & ~path.rlike(wrong), F.lit(False))


def importable_url(url: Column) -> Column:
    """May the URL be imported: https, a host, no user information."""
    authority = F.regexp_extract(url, r"^[Hh][Tt][Tt][Pp][Ss]://([^/?#]*)", 1)
    return F.coalesce(url.rlike(r"^[Hh][Tt][Tt][Pp][Ss]://") & (authority != "") & ~authority.contains("@") & ~authority.startswith(":"), F.lit(False))


def url_file_name(url: Column) -> Column:
    """The last segment of the URL's path without query and fragment; null if it is empty."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z]+://[^/]*", "")
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def remote_file_name(requested: Column, disposition: Column, url: Column) -> Column:
    """The name of a download: the one asked for, else that of the Content-Disposition header, else the last filled segment of the URL's path; of that, what is behind the last
    slash or backslash. Null if nothing usable is left; a header's empty name doesn't fall back to the URL."""
    parts = F.transform(F.split(disposition, ";"), lambda p: F.trim(p))
    named = F.try_element_at(F.filter(parts, lambda p: p.startswith("filename=")), F.lit(1))
    header = F.regexp_replace(F.substring(named, 10, 1 << 20), r"""^["']+|["']+$""", "")
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z]+://[^/]*", "")
    segment = F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1))
    name = F.trim(F.regexp_extract(F.coalesce(F.nullif(F.trim(requested), F.lit("")), header, segment), r"([^/\\]*)$", 1))
    return F.when(~name.isin("", ".", ".."), name)


# Media types of the extensions that downloads may have.
DOCUMENT_MEDIA = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def media_fits(name: Column, media: Column) -> Column:
    """Whether a download's media type fits its name: documents by their own type, Markdown and text by any text type, JSON by both; names without an extension by any of them, other
    extensions by none."""
    extension, is_text, json = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)), media.startswith("text/"), media == "application/json"
    out = F.when(~name.contains("."), is_text | json | media.isin(*DOCUMENT_MEDIA.values())).when(extension.isin("md", "txt"), is_text).when(extension == "json", is_text | json)
    for k, kind in DOCUMENT_MEDIA.items():
        out = out.when(extension == k, media == kind)
    return F.coalesce(out.otherwise(False), F.lit(False))
