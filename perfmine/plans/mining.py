"""Static mining end to end: tables of a code host to new dataset rows.

Cheap, reducing steps come first: repository filters, commit dates, one
aggregate over the files, then text, issues and last the verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.operators import mining
from perfmine.session import staged
from perfmine.sources import answers


@dataclass(frozen=True)
class Host:
    """The tables of a code host."""

    repos: DataFrame
    repo_files: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    issues: DataFrame
    pulls: DataFrame


def candidate_commits(
    host: Host, dataset: DataFrame, since: str = mining.START_DATE, max_files: int = mining.MAX_FILES
) -> DataFrame:
    """New commits of eligible repositories that touch only a few plain Java files.

    The join by repository comes first and feeds a shuffle by commit. Were the
    step after it keyed by (repo, sha), Spark would keep the rows partitioned by
    repository, and one large repository would stay in one task.
    """
    repos = mining.with_root_file(mining.eligible_repos(host.repos, since), host.repo_files)
    commits = mining.commits_since(host.commits, since).join(
        repos.select(F.col("full_name").alias("repo")).distinct(), "repo", "left_semi"
    )
    return mining.unseen(mining.with_fitting_files(commits, host.commit_files, max_files), dataset)


def _candidates(host: Host, dataset: DataFrame, limits: dict) -> DataFrame:
    """The few commits that passed the cheap filters, staged for the steps over text."""
    return staged(candidate_commits(host, dataset, **limits).select("repo", "sha", "message"), "candidates")


def mined_commits(host: Host, dataset: DataFrame, verdicts: DataFrame, **limits) -> DataFrame:
    """Rows of (repo, sha, issue_number): commits that fix a confirmed issue.

    ``verdicts`` holds the answers by ``prompt_hash``.
    """
    commits = _candidates(host, dataset, limits)
    asked = mining.prompts(mining.all_refs(commits, host.pulls), commits, host.issues)
    return mining.chosen_issue(mining.confirmed_refs(asked, verdicts))


def pending_prompts(host: Host, dataset: DataFrame, verdicts: DataFrame, **limits) -> DataFrame:
    """Questions that still lack an answer; the side output of mining."""
    commits = _candidates(host, dataset, limits)
    found = mining.all_refs(commits, host.pulls).select("repo", "sha", "number").distinct()
    return mining.to_judge(mining.prompts(found, commits, host.issues), verdicts)


def judged(asked: DataFrame, cache: str, digits: int = answers.DIGITS) -> tuple[DataFrame, DataFrame]:
    """Questions with their verdict from the table cache at ``cache``, and those it lacks.

    ``asked`` has ``prompt_hash``, as ``pending_prompts`` and ``mining.prompts`` give it.
    The cache is read once, in the folders of the questions; ``record_answers`` puts in
    what the model says to the second result, and the next call then finds it.
    """
    asked = staged(asked, "asked")
    verdicts = staged(answers.first_answers(answers.stored_answers(cache, asked, digits)), "verdicts")
    return mining.with_verdicts(asked, verdicts), mining.to_judge(asked, verdicts)
