"""Read queries on the service's metadata: jobs, projects, what was deleted, and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import older_than_days
from .grid import placed

UNGROUPED = "未分组"  # fixed value: the group of jobs without a project
NO_PROJECT = "__none__"
KEPT_DAYS = 10


def newest_first(rows: DataFrame, time: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc(time), "id")


def of_project(jobs: DataFrame, project: str | None = None) -> DataFrame:
    """All jobs, those of a project, or with NO_PROJECT those of none."""
    if not project:
        return jobs
    return jobs.filter(F.col("project_id").isNull() if project == NO_PROJECT else F.col("project_id") == project)


def jobs_page(jobs: DataFrame, project: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first; ids settle ties."""
    return newest_first(of_project(jobs, project)).offset(offset).limit(limit)


def job_total(jobs: DataFrame, project: str | None = None) -> DataFrame:
    return of_project(jobs, project).agg(F.count("*").alias("total"))


def next_offset(offset: int, limit: int, total: int) -> int:
    return offset + limit if offset + limit < total else offset


def previous_offset(offset: int, limit: int) -> int:
    return max(0, offset - limit)


def paged(rows: DataFrame, limit: int = 50) -> DataFrame:
    """All rows of a sorted frame with their place and the offsets of their page, the next and the previous one: a listing for deep pages, made once."""
    found = placed(rows)
    total = found.agg(F.count("*").alias("__total"))
    offset = ((F.col("place") - 1) / limit).cast("long") * limit
    following = F.when(offset + limit < F.col("__total"), offset + limit).otherwise(offset)
    # one row
    return found.join(F.broadcast(total)).select(*found.columns, offset.alias("offset"), following.alias("next_offset"), F.greatest(offset - limit, F.lit(0)).alias("previous_offset"))


def by_id(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col("id") == key)


def recoverable(deleted: DataFrame, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """What was deleted at most ``days`` ago, last deleted first."""
    return deleted.filter(~older_than_days(F.col("deleted_at"), now, days)).orderBy(F.desc("deleted_at"), "id")


def with_deleted(live: DataFrame, deleted: DataFrame) -> DataFrame:
    """Live and deleted rows with a flag; older tables may lack columns."""
    return live.withColumn("deleted", F.lit(False)).unionByName(deleted.withColumn("deleted", F.lit(True)), allowMissingColumns=True)


def labelled(jobs: DataFrame) -> DataFrame:
    """A job's label: its own, else its file's name, else its id."""
    return jobs.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.nullif("file_a_name", F.lit("")), "id"))


def looked_up(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``rows`` joined with ``found`` by ``key``, nulls where nothing is found. Rows without a key, often the most, find nothing; they are dealt by their id, or one task would get them all."""
    name = lambda value, missing: F.struct(value.alias("value"), missing.alias("missing")).alias("__key")
    others = [c for c in found.columns if c != key]
    dealt = rows.select(*rows.columns, name(F.coalesce(key, "id"), F.col(key).isNull()))
    joined = dealt.join(found.select(name(F.col(key), F.lit(False)), *others), "__key", "left")
    return joined.select(key, *(c for c in rows.columns if c != key), *others)


def with_projects(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs with their project's owner, publicity, lock and name; nulls without a project. Spark picks the strategy by size."""
    own = projects.select(F.col("id").alias("project_id"), F.col("user_id").alias("project_owner"), "is_public", (F.coalesce("password_hash", F.lit("")) != "").alias("is_locked"), F.col("name").alias("project_name"))
    return looked_up(jobs, "project_id", own)


def accessible(jobs: DataFrame, projects: DataFrame, user: str) -> DataFrame:
    """Each job with ``may_read``: its owner may, and anyone if its project is public and has no password."""
    rule = (F.col("user_id") == user) | (F.coalesce("is_public", F.lit(False)) & ~F.coalesce("is_locked", F.lit(False)))
    return with_projects(jobs, projects).withColumn("may_read", F.coalesce(rule, F.lit(False)))


def grouped(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs with their group's label, groups by label, jobs without a project last, newest first within a group."""
    named = with_projects(jobs, projects).withColumn("group_label", F.coalesce("project_name", F.lit(UNGROUPED)))
    return named.orderBy(F.col("project_name").isNull(), "group_label", F.desc("created_at"), "id")


def group_sizes(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    return with_projects(jobs, projects).groupBy(F.coalesce("project_name", F.lit(UNGROUPED)).alias("group_label")).agg(F.count("*").alias("n_jobs"), F.max("created_at").alias("newest"))


def finished_single(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("mode") == "single") & (F.col("status") == "done"))


def with_paths(jobs: DataFrame, among: DataFrame | None = None, sides: str = "ab") -> DataFrame:
    """A job's trace paths, gzipped before plain; where it has neither, those of its source jobs' first files. file_a_exists says whether there is one.

    ``among``: all jobs, where ``jobs`` are only some. ``sides``: the traces whose paths are wanted, a at least.
    """
    own = jobs.withColumns({f"path_{s}": F.coalesce(f"gzip_{s}_path", f"file_{s}_path") for s in sides})
    source = (jobs if among is None else among).select(F.col("id").alias("source_id"), F.coalesce("gzip_a_path", "file_a_path").alias("source_path"))
    for side in sides:
        of_side = source.select(F.col("source_id").alias(f"source_job_{side}_id"), F.col("source_path").alias(f"source_path_{side}"))
        own = looked_up(own, f"source_job_{side}_id", of_side).withColumn(f"path_{side}", F.coalesce(f"path_{side}", f"source_path_{side}")).drop(f"source_path_{side}")
    return own.withColumn("file_a_exists", F.col("path_a").isNotNull())


def comparable(jobs: DataFrame, a: str, b: str, user: str) -> DataFrame:
    """One row saying whether jobs a and b can be compared by a user: both there, both the user's, both with a file."""
    both = with_paths(jobs).filter(F.col("id").isin(a, b))
    ok = (F.countDistinct("id") == len({a, b})) & F.coalesce(F.bool_and((F.col("user_id") == user) & F.col("file_a_exists")), F.lit(False))
    return both.agg(ok.alias("comparable"))


def new_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users seen that aren't known yet, each once."""
    return seen.dropDuplicates(["id"]).join(users, "id", "left_anti")
