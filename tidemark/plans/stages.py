"""Stages over files that are taken up again: what was built from what, and whether it is still there.

A report names the identities of all inputs and outputs of a stage and its status: running, completed, review (built, but a
person has to look), interrupted or failed. A stage is skipped only if its report says completed or review, and inputs, version
and outputs are those that are there now.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from ..sources import tables
from . import sinks

DONE = ("completed", "review")


def identity(spark: SparkSession, path: str) -> str | None:
    """SHA-256 over the names, sizes and contents of the data files under a path; none if there is nothing, and ``unreadable`` if
    the store finds a file damaged."""
    if not sinks.exists(spark, path):
        return None
    try:
        files = tables.file_identity(spark, path, recursive=True).collect()  # a row for each file
    except Exception as e:
        if "checksum" not in str(e).lower():
            raise
        return "unreadable"
    found = sorted((f["path"].rsplit("/", 1)[-1], f["size_bytes"], f["sha256"]) for f in files)
    return hashlib.sha256(repr(found).encode()).hexdigest()


def report_of(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """A report, or none if there is none or it cannot be read."""
    if not sinks.exists(spark, path):
        return None
    try:
        found = tables.read_document(spark, path)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def run(spark: SparkSession, report: str | None, stage: str, version: str, inputs: dict[str, str], outputs: dict[str, str], build: Callable[[], tuple[bool, dict]]) -> int:
    """Runs ``build``, which says whether all is well and what else to report, unless it has been run on the same inputs and its
    outputs are still the same. Returns 0, or 1 if a person has to look. Without a report to keep, it is printed."""
    if report is None:
        good, more = build()
        print(json.dumps({"stage": stage, "status": "completed" if good else "review"} | more, default=str, sort_keys=True))
        return 0 if good else 1
    given = {name: identity(spark, path) for name, path in inputs.items()}
    state = {"stage": stage, "version": version, "inputs": given, "paths": inputs | outputs}
    before = report_of(spark, report)
    if before and before.get("status") in DONE and all(before.get(k) == state[k] for k in state):
        if before.get("outputs") == {name: identity(spark, path) for name, path in outputs.items()}:
            return 0 if before["status"] == "completed" else 1
    sinks.write_json(spark, state | {"status": "running"}, report)
    try:
        good, more = build()
    except KeyboardInterrupt:
        sinks.write_json(spark, state | {"status": "interrupted"}, report)
        raise
    except Exception as e:
        sinks.write_json(spark, state | {"status": "failed", "error": str(e)[:500]}, report)
        raise
    made = {name: identity(spark, path) for name, path in outputs.items()}
    sinks.write_json(spark, state | {"status": "completed" if good else "review", "outputs": made, **more}, report)
    return 0 if good else 1


def gate(spark: SparkSession, report: str, stage: str, output: str, path: str) -> dict[str, Any]:
    """The report of an earlier stage, which must be completed and have made what is at ``path`` now."""
    found = report_of(spark, report)
    if found is None or found.get("stage") != stage or found.get("status") != "completed":
        raise ValueError(f"{report} is no report of a completed {stage}")
    if found.get("outputs", {}).get(output) != identity(spark, path):
        raise ValueError(f"{path} is not what {report} says that {stage} made")
    return found
