"""Repositories, commits, issue references and verdicts.

Inputs are tables: repositories, commits, changed files, issues, pull requests
and model verdicts. Each lookup of a single object is a join here, and joins are
left to Catalyst and AQE: no side is assumed to be small. The right side of a
semi or anti join is made distinct first: this combines copies before the
shuffle, and the join reuses the aggregate's partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfmine.functions import paths, refs

# The mining limits.
MAX_FILES = 20
MIN_STARS = 20
NO_STAR_LIMIT = -1
START_DATE = "2015-01-01"
LANGUAGE = "Java"
WRAPPER_FILE = "mvnw"


def eligible_repos(
    repos: DataFrame,
    since: str = START_DATE,
    until: str | None = None,
    min_stars: int = MIN_STARS,
    max_stars: int = NO_STAR_LIMIT,
    language: str = LANGUAGE,
) -> DataFrame:
    """FLT-01: language, not archived, stars and last push in range (ends included)."""
    keep = (F.col("language") == language) & ~F.col("archived") & (F.col("stars") >= min_stars)
    keep = keep & _pushed_between(repos, since, until)
    if max_stars != NO_STAR_LIMIT:
        keep = keep & (F.col("stars") <= max_stars)
    return repos.where(keep)


def _pushed_between(repos: DataFrame, since: str, until: str | None) -> Column:
    """Pushed on a day from ``since`` to ``until``; compares the bare column, so that it reaches the scan."""
    kind = repos.schema["pushed_at"].dataType
    between = F.col("pushed_at") >= F.lit(since).cast(kind)
    if until is not None:
        between = between & (F.col("pushed_at") < F.date_add(F.lit(until).cast("date"), 1).cast(kind))
    return between


def by_stars(repos: DataFrame) -> DataFrame:
    """ST-02: most stars first, the name decides ties."""
    return repos.orderBy(F.col("stars").desc(), "full_name")


def with_root_file(repos: DataFrame, repo_files: DataFrame, name: str = WRAPPER_FILE) -> DataFrame:
    """FLT-02: repositories that hold ``name`` at their root."""
    having = repo_files.where(F.col("path") == name).select(F.col("repo").alias("full_name")).distinct()
    return repos.join(having, "full_name", "left_semi")


def in_push_windows(repos: DataFrame, since: str, until: str) -> DataFrame:
    """JN-13: repositories by one-day push windows, both ends included.

    A window ends on each day from ``since`` to ``until`` and begins the day
    before, so a day lies in at most two windows. They are computed from the
    day, which spares the range join.
    """
    day = F.to_date("pushed_at")
    first, last = F.lit(since).cast("date"), F.lit(until).cast("date")
    ends = F.filter(F.array(day, F.date_add(day, 1)), lambda e: (e >= first) & (e <= last))
    return repos.where(_pushed_between(repos, since, until)).withColumn("window_end", F.explode(ends))


def newest_per_repo(windowed: DataFrame) -> DataFrame:
    """W-01: one row per repository id, newest window first, then most stars."""
    row = F.struct(*[F.col(c) for c in windowed.columns if c != "repo_id"])
    best = F.max_by(row, F.struct("window_end", "stars", "full_name"))
    return windowed.groupBy("repo_id").agg(best.alias("_row")).select("repo_id", "_row.*")


def commits_since(commits: DataFrame, since: str = START_DATE) -> DataFrame:
    """FLT-03. The comparison is with the bare column, so it reaches the scan."""
    return commits.where(F.col("committed_at") >= F.lit(since).cast(commits.schema["committed_at"].dataType))


def commit_year(commits: DataFrame) -> DataFrame:
    """SC-26: year of the author date, else of the committer date."""
    return commits.withColumn("commit_year", F.year(F.coalesce("authored_at", "committed_at")))


def file_profile(files: DataFrame) -> DataFrame:
    """Per commit: number of files, and whether all are plain Java sources."""
    return files.groupBy("sha").agg(
        F.count(F.lit(1)).alias("n_files"), F.bool_and(paths.is_plain_java(F.col("path"))).alias("all_java")
    )


def within_file_limit(commits: DataFrame, files: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """FLT-04: drop commits with more than ``max_files`` files."""
    large = files.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_files)
    return commits.join(large, "sha", "left_anti")


def only_plain_java(commits: DataFrame, files: DataFrame) -> DataFrame:
    """FLT-05: every file is a plain Java source; true for a commit without files."""
    other = files.where(~paths.is_plain_java(F.col("path"))).select("sha").distinct()
    return commits.join(other, "sha", "left_anti")


def with_fitting_files(commits: DataFrame, files: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """FLT-04 and FLT-05 together, over one aggregate of the files."""
    unfit = file_profile(files).where((F.col("n_files") > max_files) | ~F.col("all_java")).select("sha")
    return commits.join(unfit, "sha", "left_anti")


def files_of_small_commits(files: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """FLT-04 on file rows: the files of commits within the limit.

    More than ``max_files`` + 1 files of a commit cannot change the answer, so
    the rank filter lets Spark drop the rest before the shuffle, and a commit
    with very many files never meets in one task.
    """
    by_commit = Window.partitionBy("sha")
    rank = F.row_number().over(by_commit.orderBy("path", "status"))
    first = files.withColumn("_rank", rank).where(F.col("_rank") <= max_files + 1)
    return first.withColumn("_n", F.count(F.lit(1)).over(by_commit)).where(F.col("_n") <= max_files).drop("_rank", "_n")


def with_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """JN-03: commits with their files; a commit without files keeps one row."""
    return commits.join(files, "sha", "left")


def unseen(commits: DataFrame, dataset: DataFrame) -> DataFrame:
    """FLT-09 / JN-14: commits not in the dataset, each sha once.

    The dataset is keyed by repository and commit, but a commit seen in one
    repository is not looked at again in a fork: of rows with one sha, that of
    the first repository by name stays.
    """
    known = dataset.select("repo", F.col("after_commit").alias("sha")).distinct()
    fresh = commits.join(known, ["repo", "sha"], "left_anti")
    rest = [F.col(c) for c in commits.columns if c != "sha"]
    first = fresh.groupBy("sha").agg(F.min_by(F.struct(*rest), "repo").alias("_row"))
    return first.select(*[F.col("sha") if c == "sha" else F.col(f"_row.{c}").alias(c) for c in commits.columns])


def real_issues(issues: DataFrame) -> DataFrame:
    """FLT-21: issues that are not pull requests."""
    return issues.where(~F.col("is_pull_request"))


def message_refs(commits: DataFrame, strict_repo: bool = False) -> DataFrame:
    """SC-01 / SC-02 over commit messages: rows of (repo, sha, number)."""
    return refs.explode_refs(commits, F.col("message"), strict_repo=strict_repo).select("repo", "sha", "number")


def pull_refs(pulls: DataFrame, strict_repo: bool = False) -> DataFrame:
    """References in title, newline and body of pull requests."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return refs.explode_refs(pulls, text, strict_repo=strict_repo).select("repo", "sha", "pr_number", "number")


def existing(found: DataFrame, issues: DataFrame) -> DataFrame:
    """JN-04: references to issues that exist."""
    keys = real_issues(issues).select("repo", "number").distinct()
    return found.join(keys, ["repo", "number"], "left_semi")


def is_confirmed(response: Column) -> Column:
    """SC-20: the answer contains ``yes``, in any case."""
    return F.contains(F.lower(F.trim(response)), F.lit("yes"))


def prompts(found: DataFrame, commits: DataFrame, issues: DataFrame) -> DataFrame:
    """SC-21: the question of each reference to an existing issue, and its md5 key over all its parts.

    A question is about one commit and one issue: the message is part of it. So
    one issue that very many commits name is many keys, and the joins on the key
    that follow have nothing to be skewed by.
    """
    asked = found.join(real_issues(issues).select("repo", "number", "title", "body"), ["repo", "number"]).join(
        commits.select("repo", "sha", "message"), ["repo", "sha"]
    )
    text = F.concat(
        F.lit("Repository: "), F.col("repo"),
        F.lit("\nIssue title: "), F.coalesce("title", F.lit("")),
        F.lit("\nIssue text: "), F.coalesce("body", F.lit("")),
        F.lit("\nCommit message: "), F.coalesce("message", F.lit("")),
        F.lit("\nDoes the commit fix an issue about execution time? Answer yes or no; if unsure, no."),
    )
    return asked.select(*found.columns, text.alias("prompt"), F.md5(text.cast("binary")).alias("prompt_hash"))


def with_verdicts(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JN-06: questions with ``confirmed``; null where there is no answer yet.

    ``verdicts`` holds one answer per ``prompt_hash``, as ``first_answers`` gives it.
    """
    answers = verdicts.select("prompt_hash", is_confirmed(F.col("response")).alias("confirmed"))
    return asked.join(answers, "prompt_hash", "left")


def confirmed_refs(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Questions whose answer is yes; those without an answer wait."""
    yes = verdicts.where(is_confirmed(F.col("response"))).select("prompt_hash").distinct()
    return asked.join(yes, "prompt_hash", "left_semi")


def to_judge(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JN-15: questions without an answer, the work of the model adapter."""
    return asked.join(verdicts.select("prompt_hash").distinct(), "prompt_hash", "left_anti")


def all_refs(commits: DataFrame, pulls: DataFrame, strict_repo: bool = False) -> DataFrame:
    """SET-02 / JN-05: references of messages (rank 0) and of linked pull requests (rank 1)."""
    own = message_refs(commits, strict_repo).withColumn("source_rank", F.lit(0)).withColumn(
        "pr_number", F.lit(None).cast("bigint")
    )
    linked = pulls.join(commits.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi")
    via_pull = pull_refs(linked, strict_repo).withColumn("source_rank", F.lit(1))
    return own.unionByName(via_pull)


def chosen_issue(confirmed: DataFrame) -> DataFrame:
    """AG-27: per commit the first confirmed issue; messages go before pull requests.

    Within one text the smallest number is taken.
    """
    return confirmed.groupBy("repo", "sha").agg(
        F.min_by("number", F.struct("source_rank", "pr_number", "number")).alias("issue_number")
    )


def confirmed_by_message(confirmed: DataFrame) -> DataFrame:
    """AG-28: commits whose own message names a confirmed issue."""
    return confirmed.where(F.col("source_rank") == 0).select("repo", "sha").distinct()


def relevant_pull(pulls: DataFrame, confirmed: DataFrame) -> DataFrame:
    """AG-29 / W-05: per commit the first pull request with a confirmed issue."""
    hits = confirmed.where(F.col("source_rank") == 1).select("repo", "sha", "pr_number").distinct()
    return (
        pulls.join(hits, ["repo", "sha", "pr_number"], "left_semi")
        .groupBy("repo", "sha")
        .agg(F.min_by(F.struct("pr_number", "base_sha", "head_sha"), "pr_number").alias("_pull"))
        .select("repo", "sha", "_pull.*")
    )


def linked_pulls(pulls: DataFrame) -> DataFrame:
    """AG-25: the pull requests of each commit, as rows."""
    return pulls.select("repo", "sha", "pr_number").distinct()
