"""Texts for a coding agent: tasks and commit diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The placeholders of a task template, in the order they are filled.
PLACEHOLDERS = ("{issue-title}", "{issue-description}", "{buggy-module}", "{buggy-files}", "{repo-name}")

TEMPLATES = {
    "patch": "Project {repo-name}, module(s) {buggy-module}.\nIssue: {issue-title}\n{issue-description}\n"
    "Make these files faster without changing behaviour:\n{buggy-files}\n",
    "test": "Project {repo-name}, module(s) {buggy-module}.\nFixed issue: {issue-title}\n{issue-description}\n"
    "Write tests that show the gain in:\n{buggy-files}\n",
}


def task_texts(commits: DataFrame, template: str) -> DataFrame:
    """SC-22: one filled template per commit.

    ``commits`` has ``repo``, ``title``, ``body``, and the sorted lists
    ``modified_modules`` and ``changed_files``.
    """
    values = (
        F.coalesce("title", F.lit("")),
        F.coalesce("body", F.lit("")),
        F.array_join("modified_modules", ","),
        F.array_join("changed_files", "\n"),
        F.substring_index("repo", "/", -1),
    )
    text = F.lit(template)
    for placeholder, value in zip(PLACEHOLDERS, values):
        text = F.replace(text, F.lit(placeholder), value)
    return commits.withColumn("task", text)


def diff_pieces(files: DataFrame) -> DataFrame:
    """SC-23 as rows (sha, position, piece): ``--- name`` and patch of every file.

    Files without a patch are skipped. The diff of a commit is its pieces in
    order of ``position``.
    """
    piece = F.concat(F.lit("--- "), "path", F.lit("\n"), "patch", F.lit("\n"))
    return files.where(F.coalesce(F.col("patch"), F.lit("")) != "").select("sha", "position", piece.alias("piece"))


def commit_diffs(files: DataFrame) -> DataFrame:
    """SC-23 as one text per commit, for commits that have passed the file limit."""
    pieces = diff_pieces(files).groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("_p"))
    return pieces.select("sha", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("diff"))
