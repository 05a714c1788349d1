"""Links, keys and labels: repository names, commit links, path keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perfmine.functions.text import stripped

COMMIT_LINK = r"https?://[^/\s]+/([^/\s]+)/([^/\s]+)/commit/([^/\s,]+)"
PULL_LINK = r"https?://[^/\s]+/([^/\s]+)/([^/\s]+)/pull/(\d+)(?:/changes)?"
PATH_KEY = r"^(.+?)__(.+)_([0-9a-f]{7,40})$"


def _or_null(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def commit_link(link: Column) -> Column:
    """``struct(owner, repo, sha)`` of a commit link; fields are null for another text."""
    return F.struct(
        _or_null(link, COMMIT_LINK, 1).alias("owner"),
        _or_null(link, COMMIT_LINK, 2).alias("repo"),
        _or_null(link, COMMIT_LINK, 3).alias("sha"),
    )


def pull_link(link: Column) -> Column:
    """``struct(repo, pr_number)`` of a pull-request link."""
    full = F.concat_ws("/", _or_null(link, PULL_LINK, 1), _or_null(link, PULL_LINK, 2))
    return F.struct(
        F.nullif(full, F.lit("")).alias("repo"),
        _or_null(link, PULL_LINK, 3).try_cast("bigint").alias("pr_number"),
    )


def short_label(repo: Column) -> Column:
    """The part after the first slash; ``Unknown`` for null, ``Others`` for any ``others``."""
    return (
        F.when(repo.isNull(), F.lit("Unknown"))
        .when(F.lower(repo) == "others", F.lit("Others"))
        .when(F.instr(repo, "/") > 0, F.substr(repo, F.instr(repo, "/") + F.lit(1)))
        .otherwise(repo)
    )


def path_key(repo: Column, sha: Column) -> Column:
    """``owner__repo_sha``, usable as one path segment."""
    return F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit("_"), sha)


def decode_path_key(key: Column) -> Column:
    """``struct(repo, sha)`` of a path key; null fields for an irregular key."""
    owner, name = _or_null(key, PATH_KEY, 1), _or_null(key, PATH_KEY, 2)
    return F.struct(F.concat(owner, F.lit("/"), name).alias("repo"), _or_null(key, PATH_KEY, 3).alias("sha"))


def commit_key(repo: Column, sha: Column) -> Column:
    """``repo@sha`` of the trimmed parts."""
    return F.concat(stripped(repo), F.lit("@"), stripped(sha))
