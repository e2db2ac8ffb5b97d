"""Captured files as records by day and role, and lookups that must be unambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2
#: fixed values: roles and the file names that carry them
ROLES = {
    "binance_raw": r"^binance_raw_events_(20\d{2}-\d{2}-\d{2})\.jsonl\.gz$",
    "polymarket_raw": r"^polymarket_raw_events_(20\d{2}-\d{2}-\d{2})\.jsonl\.gz$",
    "recorder_log": r"^recorder\.log\.(20\d{2}-\d{2}-\d{2})\.gz$",
}
CAPTURE = "binance_raw"  # the role that is audited
ZIP = "zip_archive"  # fixed value: role of a legacy archive, which is a record of its own


def layout(files: DataFrame, wanted: str = "auto") -> str:
    """``grouped-gzip`` or ``zip``; without a wish a folder that holds both stops it."""
    if wanted != "auto":
        return wanted
    grouped, zipped = not classify(files).isEmpty(), not files.where("name LIKE '%.zip'").isEmpty()
    if grouped and zipped:
        raise ValueError("both grouped gzip inputs and zip archives; name a layout")
    return "zip" if zipped else "grouped-gzip"


def zip_records(files: DataFrame) -> DataFrame:
    """A record for each zip archive, known by its path, with the columns of ``records``."""
    x = files.where("name LIKE '%.zip'")
    item = F.struct("name", F.col("path").alias("relative_path"), "size_bytes", "sha256")
    return x.select(
        F.lit(None).cast("string").alias("day"),
        F.col("path").alias("group_id"),
        F.create_map(F.lit(ZIP), item).alias("inputs"),
        F.array().cast("array<string>").alias("missing_input_roles"),
        F.sha2(F.concat(F.lit(f"{ZIP}:"), "sha256"), 256).alias("identity"),
        F.lit("pending").alias("status"),
    )


def classify(files: DataFrame) -> DataFrame:
    """Files with role and day; names of no role are left out."""
    role, day = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in ROLES.items():
        hit = F.col("name").rlike(pattern)
        role = F.when(hit, name).otherwise(role)
        day = F.when(hit, F.regexp_extract("name", pattern, 1)).otherwise(day)
    return files.withColumns({"role": role, "day": day}).where(F.col("role").isNotNull())


def records(files: DataFrame) -> DataFrame:
    """A record for each day: inputs by role, roles that lack, the group's identity; two files of a role stop it.

    The identity is the SHA-256 of a JSON document: by role, in order, relative_path, sha256 and size_bytes.
    """
    x = classify(files)
    item = F.struct("name", F.col("path").alias("relative_path"), "size_bytes", "sha256")
    wanted = F.array(*[F.lit(r) for r in ROLES])
    x = x.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("role", item.alias("input")))).alias("found"))
    roles = F.col("found.role")
    clash = F.size(roles) != F.size(F.array_distinct(roles))
    whole = F.when(clash, F.raise_error(F.concat(F.lit("two files of one role on "), F.col("day"))).cast("string")).otherwise(F.col("day"))
    described = lambda i: F.to_json(F.struct(i["relative_path"].alias("relative_path"), i["sha256"].alias("sha256"), i["size_bytes"].alias("size_bytes")))
    members = F.transform("found", lambda f: F.concat(F.lit('"'), f["role"], F.lit('":'), described(f["input"])))
    identity = F.sha2(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")), 256)
    return x.select(
        whole.alias("day"),
        F.concat(F.lit("group-"), F.col("day")).alias("group_id"),
        F.map_from_entries("found").alias("inputs"),
        F.array_except(wanted, roles).alias("missing_input_roles"),
        identity.alias("identity"),
        F.lit("pending").alias("status"),
    )


def with_status(manifest: DataFrame, statuses: dict[str, tuple[str, str | None]]) -> DataFrame:
    """The manifest with new (status, last_error) of some groups."""
    new = manifest.sparkSession.createDataFrame([(g, *s) for g, s in statuses.items()], "group_id string, new_status string, new_error string")
    known = manifest if "last_error" in manifest.columns else manifest.withColumn("last_error", F.lit(None).cast("string"))
    hit = F.col("new_status").isNotNull()
    x = known.join(new, "group_id", "left").withColumns({"status": F.coalesce("new_status", "status"), "last_error": F.when(hit, F.col("new_error")).otherwise(F.col("last_error"))})
    return x.select(known.columns)


def role_counts(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode(F.map_keys("inputs")).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("records"))


def with_coverage(manifest: DataFrame, coverage: DataFrame) -> DataFrame:
    """Records with the start of their capture (alias, start_utc), under any of their names; different starts stop it."""
    names = F.concat(F.array("group_id", "day"), F.transform(F.map_values("inputs"), lambda i: i["name"]), F.transform(F.map_values("inputs"), lambda i: i["relative_path"]))
    x = manifest.withColumn("alias", F.explode(F.array_distinct(names))).join(coverage, "alias")
    starts = x.groupBy("group_id").agg(F.collect_set("start_utc").alias("starts"))
    one = F.when(F.size("starts") > 1, F.raise_error(F.concat(F.lit("conflicting coverage of "), F.col("group_id"))).cast("string")).otherwise(F.element_at("starts", 1))
    return manifest.join(starts.select("group_id", one.alias("start_utc")), "group_id", "left")


def find(manifest: DataFrame, name: str) -> DataFrame:
    """The one record that has ``name`` as its group, day or a file; none or several stop it."""
    hit = (F.col("group_id") == name) | (F.col("day") == name) | F.exists(F.map_values("inputs"), lambda i: (i["name"] == name) | (i["relative_path"] == name))
    found = manifest.where(hit)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no record' if n == 0 else 'several records'} for {name}")
    return found


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("records"))


def runnable(manifest: DataFrame, force: bool = False, retry_failed: bool = True, recover_running: bool = False) -> DataFrame:
    """Records a batch may work on: pending and interrupted ones; failed ones with ``retry_failed``, and all with ``force``. Running
    ones stop it, unless a crash left them behind and ``recover_running`` takes them up; unknown or uncovered ones stop it."""
    known = ["pending", "completed", "failed", "interrupted", *(["running"] if recover_running else [])]
    bad = manifest.where(~F.col("status").isin(known) | F.col("start_utc").isNull()).select("group_id", "status").limit(3).collect()
    if bad:
        raise ValueError(f"records that cannot run: {bad}")
    due = ["pending", "interrupted", *(["failed"] if retry_failed else []), *(["running"] if recover_running else [])]
    return manifest if force else manifest.where(F.col("status").isin(due))
