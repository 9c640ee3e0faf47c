"""Schemas of events and metadata tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The keys of an event's args that are read.
IO_GB, IO_EFF, KWARGS, CODE, COLLECTIVE = "kernel num(GB)", "IO efficiency(GB/s)", "kernel kwargs", "triton output code", "Collective name"

ARGS = T.StructType([T.StructField(k, T.StringType()) for k in (IO_GB, IO_EFF, KWARGS, CODE, COLLECTIVE)])

#: An event as it stands in a file. Other keys are never parsed.
RAW_EVENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("cat", T.StringType()), T.StructField("ts", T.DoubleType()), T.StructField("dur", T.DoubleType()), T.StructField("args", ARGS)])

TRACE = T.StructType([T.StructField("traceEvents", T.ArrayType(RAW_EVENT))])

#: The canonical long frame: ord is the event's place in its file.
EVENTS = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("ord", T.LongType()), *RAW_EVENT.fields])

_ID, _TIME = ("id", "string"), ("created_at", "timestamp")
_JOB = [_ID, ("user_id", "string"), ("project_id", "string"), ("label", "string"), ("mode", "string"), ("file_a_name", "string"), ("file_b_name", "string"), ("file_a_path", "string"), ("file_b_path", "string"), ("gzip_a_path", "string"), ("gzip_b_path", "string"), ("source_job_a_id", "string"), ("source_job_b_id", "string"), ("status", "string"), ("error", "string"), _TIME, ("finished_at", "timestamp")]
_PROJECT = [_ID, ("user_id", "string"), ("name", "string"), ("folder_id", "string"), ("is_public", "boolean"), ("password_hash", "string"), _TIME]
_METADATA = {
    "users": [_ID, _TIME],
    "folders": [_ID, ("user_id", "string"), ("name", "string"), _TIME],
    "projects": _PROJECT,
    "jobs": _JOB,
    "deleted_projects": [*_PROJECT, ("deleted_at", "timestamp")],
    "deleted_jobs": [*_JOB, ("deleted_at", "timestamp")],
}

#: Metadata tables as Spark reads them.
METADATA = {name: ", ".join(f"{c} {kind}" for c, kind in columns) for name, columns in _METADATA.items()}

MODES = ("single", "compare")
STATUSES = ("pending", "running", "done", "error")
