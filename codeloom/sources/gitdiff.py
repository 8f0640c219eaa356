"""Diffs as tables: name-status lines, unified hunks, both together."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import graph

_SCOPES = {"unstaged": [], "staged": ["--cached"], "all": ["HEAD"]}


def parse_status(lines: DataFrame) -> DataFrame:
    """(path, status, old_path) of ``--name-status`` lines (line): A, D, M, T, R and C with tabs between."""
    part = F.split("line", "\t")
    letter = F.substring(part[0], 1, 1)
    two = letter.isin("R", "C")
    status = F.when(letter.isin("A", "C"), "added").when(letter == "D", "deleted").when(letter == "R", "renamed").otherwise("modified")
    rows = lines.where(F.col("line").rlike(r"^[ADMTRC]\d*\t")).select(F.when(two, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("path"), status.alias("status"), F.when(two, F.get(part, F.lit(1))).alias("old_path"))
    return rows.where("path is not null and path <> ''")


def parse_unified(lines: DataFrame) -> DataFrame:
    """(diff_id, path, hunk_start, hunk_lines) of unified diffs; ``lines`` has diff_id, seq, line.

    The file of a hunk is the last ``+++`` line above it, carried down by a window; a
    count that is left out is 1, ``/dev/null`` has no hunks.  Diffs are independent, so
    the window is per diff.
    """
    head = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1))
    at = Window.partitionBy("diff_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("path", F.last(head, ignorenulls=True).over(at)).where(F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+") & (F.col("path") != "/dev/null"))
    count = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    return rows.select("diff_id", "path", F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int").alias("hunk_start"), F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -\\\\d+(?:,\\\\d+)? \\\\+\\\\d+,(\\\\d+)', 1) as int)")).cast("int").alias("hunk_lines"))


def combine(status: DataFrame, hunks: DataFrame) -> DataFrame:
    """Changes with their hunks, one row per hunk or one without; deleted files have none, ignored paths go."""
    h = hunks.select(F.col("path").alias("of"), "hunk_start", "hunk_lines")
    rows = status.where(~graph.is_ignored(F.col("path")))
    return rows.join(h, (F.col("path") == F.col("of")) & (F.col("status") != "deleted"), "left").select("path", "old_path", "status", "hunk_start", "hunk_lines")


def diff(spark: SparkSession, repository: str, scope: str = "unstaged", base: str | None = None) -> DataFrame:
    """The working tree's changes as hunks (S14); one repository's diff is read on the driver."""
    base = base or "HEAD"
    if base.startswith("-"):  # else git would take it for an option
        raise ValueError(f"not a revision: {base}")
    which = [base] if scope == "compare" else _SCOPES[scope]
    git = lambda *a: subprocess.run(["git", "-C", repository, "diff", *a, *which], capture_output=True, text=True, check=True).stdout.split("\n")
    status = spark.createDataFrame([(x,) for x in git("--name-status")], "line string")
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(git("--unified=0"))], "diff_id string, seq long, line string")
    return combine(parse_status(status), parse_unified(lines))
