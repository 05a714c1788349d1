"""Predicates and records over file paths and name-status lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_plain_java(path: Column) -> Column:
    """Ends in ``.java`` (case-sensitive) and nowhere says ``test``."""
    return path.endswith(".java") & ~F.contains(F.lower(path), F.lit("test"))


def is_java_source(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith(".java") & ~F.contains(low, F.lit("test")) & ~F.contains(low, F.lit("generated"))


def is_java_test(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith(".java") & F.contains(low, F.lit("/test/")) & ~F.contains(low, F.lit("generated"))


def change_record(status: Column, first: Column, second: Column) -> Column:
    """``struct(old_path, new_path)`` of a name-status line; null for a short line.

    A scored rename or copy uses both paths, D has no new path, M keeps its
    path, and every other status has no old path.
    """
    scored = status.rlike("^[RC].")
    old = F.when(scored | status.isin("D", "M"), first)
    new = F.when(scored, second).when(status != "D", first)
    valid = (status != "") & first.isNotNull() & (~scored | second.isNotNull())
    return F.when(valid, F.struct(old.alias("old_path"), new.alias("new_path")))


def change_record_of_line(line: Column) -> Column:
    """The record of one raw tab-separated line."""
    parts = F.split(line, "\t")
    return change_record(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))


def is_in_place(record: Column) -> Column:
    """The change keeps its path. Adds, deletes, renames and copies do not."""
    return F.coalesce(record["old_path"] == record["new_path"], F.lit(False))


def folder(path: Column) -> Column:
    """The directory of a file, empty at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def ancestors(directory: Column) -> Column:
    """A directory and all above it with their depth; the root is ``.`` at depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    dirs = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda depth: F.struct(
            F.when(depth == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), depth), "/")).alias("dir"),
            depth.alias("depth"),
        ),
    )
    return F.when(directory.isNotNull(), dirs)


def covered_path(module: Column, folder: str, path: Column, name: Column) -> Column:
    """``[module/]folder/[path/]name``; the root module ``.`` has no prefix."""
    prefix = F.when(module == ".", F.lit("")).otherwise(F.concat(module, F.lit("/")))
    inner = F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).otherwise(F.concat(path, F.lit("/")))
    return F.concat(prefix, F.lit(folder), inner, name)
