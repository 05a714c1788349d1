"""Issue references in commit and pull-request text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The verbs and reference forms that close an issue.
CLOSING_VERBS = (
    "fix", "fixes", "fixed", "close", "closes", "closed", "resolve", "resolves",
    "resolved", "address", "addresses", "addressed",
)
REFERENCE_FORMS = (
    r"#\d+",
    r"GH-\d+",
    r"issue\s*#\d+",
    r"bug\s*#\d+",
    r"[\w.-]+/[\w.-]+#\d+",
    r"https?://github\.com/[\w.-]+/[\w.-]+/issues/\d+",
)
PROJECT_KEY_FORMS = (
    r"\b([A-Z]+-(\d+))(?:\s*:|,|\s|$)",
    r"\[([A-Z]+-(\d+))\]",
    r"Issue:\s*\[?([A-Z]+-(\d+))\]?",
)

# case-insensitive, ^ and $ per line, only \n ends a line, Unicode classes
_FLAGS = "(?imdU)"
_ANY_FORM = "(?:" + "|".join(REFERENCE_FORMS) + ")"
CLOSING_BLOCK = (
    _FLAGS + r"(?<![A-Za-z])(?:" + "|".join(CLOSING_VERBS) + r")(?:\s*[:\-])?\s+"
    + _ANY_FORM + r"(?:\s*(?:,|\band\b|&|\bor\b|\|)\s*" + _ANY_FORM + r")*"
)
_NUMBERED = _FLAGS + r"(?:#|GH-)(\d+)"
_NUMBERED_OWN = _FLAGS + r"(?:(?<![\w.-])(?:issue\s*|bug\s*)?#|GH-)(\d+)"
_QUALIFIED = _FLAGS + r"([\w.-]+/[\w.-]+)#(\d+)"
_ISSUE_URL = _FLAGS + r"https?://github\.com/([\w.-]+/[\w.-]+)/issues/(\d+)"


def _every(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _own(text: Column, repo: Column, pattern: str) -> Column:
    """Numbers of a repo-qualified form whose repository is ``repo``."""
    pairs = F.arrays_zip(_every(text, pattern, 1).alias("name"), _every(text, pattern, 2).alias("number"))
    mine = F.filter(pairs, lambda p: F.lower(p["name"]) == F.lower(repo))
    return F.transform(mine, lambda p: p["number"])


def closing_refs(text: Column, repo: Column, strict_repo: bool = False) -> Column:
    """Distinct numbers the text closes, as ``array<bigint>``.

    By default ``#n`` also counts inside ``other/repo#n``. With ``strict_repo``
    the qualified form counts only for this repository.
    """
    numbered = _NUMBERED_OWN if strict_repo else _NUMBERED
    none = F.array().cast("array<string>")

    def of_block(block: Column) -> Column:
        # links are rare, and a plain search is cheaper than the pattern
        linked = F.when(F.contains(F.lower(block), F.lit("github.com")), _own(block, repo, _ISSUE_URL)).otherwise(none)
        found = [_every(block, numbered, 1), linked]
        if strict_repo:
            # otherwise ``#n`` has already taken these
            found.append(_own(block, repo, _QUALIFIED))
        return F.concat(*found)

    return _positive(F.flatten(F.transform(_every(text, CLOSING_BLOCK, 0), of_block)))


def project_refs(text: Column) -> Column:
    """Distinct numbers of project-key references (``KEY-n``) anywhere in the text."""
    return _positive(F.concat(*[_every(text, _FLAGS + form, 2) for form in PROJECT_KEY_FORMS]))


def fixed_refs(text: Column, repo: Column, strict_repo: bool = False) -> Column:
    """Closing and project-key references together."""
    both = F.array_union(closing_refs(text, repo, strict_repo), project_refs(text))
    return F.coalesce(both, F.array().cast("array<bigint>"))


def _positive(numbers: Column) -> Column:
    # a number beyond 64 bits cannot be an issue; try_cast makes it null
    parsed = F.transform(numbers, lambda n: n.try_cast("bigint"))
    return F.array_distinct(F.filter(parsed, lambda n: n > 0))


def explode_refs(df: DataFrame, text: Column, repo: str = "repo", strict_repo: bool = False) -> DataFrame:
    """One row per (input row, referenced number)."""
    return df.withColumn("number", F.explode(fixed_refs(text, F.col(repo), strict_repo)))
