"""Queries over repositories, commits, references and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfmine.functions import refs
from perfmine.operators import mining as m
from perfmine.plans import mining as plan
from perfmine.queries.bindings import PROMPT
from perfmine.queries.registry import query
from perfmine.session import scratch_path, staged
from perfmine.sources import answers

# fixed values: verbs and forms of references
_FORMS = r"(?:#\d+|GH-\d+|issue\s*#\d+|bug\s*#\d+|[\w.-]+/[\w.-]+#\d+|https?://github\.com/[\w.-]+/[\w.-]+/issues/\d+)"
_BLOCK = (
    r"(?i)(?:^|[^A-Za-z])(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved|address|addresses|addressed)"
    rf"(?:\s*[:\-])?\s+{_FORMS}(?:\s*(?:,|\band\b|&|\bor\b|\|)\s*{_FORMS})*"
)
_URL = r"(?i)https?://github\.com/([\w.-]+/[\w.-]+)/issues/(\d+)"
_QUALIFIED = r"(?i)([\w.-]+/[\w.-]+)#(\d+)"


def _closing(source: str, ids: str, text: str, strict: bool = False) -> str:
    """Closing references of ``text`` in ``source`` as rows of (ids, number)."""
    blocks = f"(select {ids}, unnest(regexp_extract_all({text}, '{_BLOCK}', 0)) as b from {source}) blocks"
    plain = (
        rf"select {ids}, unnest(regexp_extract_all(b, '(?i)(?:^|[^\w.-])(?:issue\s*|bug\s*)?#(\d+)', 1)) as n from {blocks}"
        if strict
        else rf"select {ids}, unnest(regexp_extract_all(b, '#(\d+)', 1)) as n from {blocks}"
    )
    own = " union all ".join(
        f"select {ids}, z[2] as n from (select {ids}, unnest(list_zip(regexp_extract_all(b, '{p}', 1), "
        f"regexp_extract_all(b, '{p}', 2))) as z from {blocks}) q where lower(z[1]) = lower(repo)"
        for p in (_URL, _QUALIFIED)
    )
    return (
        f"select distinct {ids}, cast(n as bigint) as number from ({plain} union all "
        rf"select {ids}, unnest(regexp_extract_all(b, '(?i)GH-(\d+)', 1)) as n from {blocks} union all {own}) u "
        "where cast(n as bigint) > 0"
    )


def _project(source: str, ids: str, text: str) -> str:
    forms = (r"\b([A-Z]+-(\d+))(?:\s*:|,|\s|$)", r"\[([A-Z]+-(\d+))\]", r"Issue:\s*\[?([A-Z]+-(\d+))\]?")
    rows = " union all ".join(
        f"select {ids}, unnest(regexp_extract_all({text}, '(?im){p}', 2)) as n from {source}" for p in forms
    )
    return f"select distinct {ids}, cast(n as bigint) as number from ({rows}) u where cast(n as bigint) > 0"


_MESSAGE = f"""
message_refs as (
  {_closing('b_commits', 'repo, sha', 'message')} union {_project('b_commits', 'repo, sha', 'message')}
)"""
_PULL = f"""
pull_text as (select *, concat(coalesce(title, ''), chr(10), coalesce(body, '')) as t from b_pulls),
pull_refs as (
  {_closing('pull_text', 'repo, sha, pr_number', 't')} union {_project('pull_text', 'repo, sha, pr_number', 't')}
)"""
_ALL = _MESSAGE + "," + _PULL + f""",
all_refs as (
  select r.* from (
    select repo, sha, number, 0 as source_rank, cast(null as bigint) as pr_number from message_refs
    union all select repo, sha, number, 1 as source_rank, pr_number from pull_refs) r
  where exists (select 1 from b_issues i where i.repo = r.repo and i.number = r.number and not i.is_pull_request)
),
asked as (
  select r.*, md5({PROMPT}) as prompt_hash from all_refs r
  join b_issues i on r.repo = i.repo and r.number = i.number join b_commits c on c.repo = r.repo and c.sha = r.sha
),
confirmed as (
  select a.* exclude (prompt_hash) from asked a join b_judgements j using (prompt_hash) where contains(lower(trim(j.response)), 'yes')
)"""


def _found(t):
    return m.all_refs(t.bind("b_commits"), t.bind("b_pulls"))


def _asked(t):
    return m.prompts(_found(t), t.bind("b_commits"), t.bind("b_issues"))


def _confirmed(t):
    return m.confirmed_refs(_asked(t), t.bind("b_judgements"))


@query("flt_01_repo_eligible", oracle="""
select repo_id, full_name, stars from b_repos
where language = 'Java' and not archived and stars >= 20 and stars <= 50000
  and pushed_at >= date '1999-01-01' and cast(pushed_at as date) <= date '2001-07-01'""")
def _(t):
    return m.eligible_repos(t.bind("b_repos"), "1999-01-01", "2001-07-01", max_stars=50_000).select("repo_id", "full_name", "stars")


@query("flt_02_root_wrapper", oracle="""
select repo_id, full_name from b_repos r
where exists (select 1 from b_repo_files f where f.repo = r.full_name and f.path = 'mvnw')""")
def _(t):
    return m.with_root_file(t.bind("b_repos"), t.bind("b_repo_files")).select("repo_id", "full_name")


@query("flt_03_commits_since", oracle="select repo, sha from b_commits where committed_at >= date '1998-06-01'")
def _(t):
    return m.commits_since(t.bind("b_commits"), "1998-06-01").select("repo", "sha")


@query("flt_04_file_limit", oracle="""
select repo, sha from b_commits c where (select count(*) from b_commit_files f where f.sha = c.sha) <= 5""")
def _(t):
    return m.within_file_limit(t.bind("b_commits"), t.bind("b_commit_files"), 5).select("repo", "sha")


_PLAIN = "(path like '%.java' and not contains(lower(path), 'test'))"


@query("flt_05_only_plain_java", oracle=f"""
select repo, sha from b_commits c where not exists (select 1 from b_commit_files f where f.sha = c.sha and not {_PLAIN})""")
def _(t):
    return m.only_plain_java(t.bind("b_commits"), t.bind("b_commit_files")).select("repo", "sha")


_NEWER = "select repo, after_commit from b_dataset where exec_status is not null"
# every third commit also lies in a fork, whose name may come before or after
_FORKED = """(select repo, sha, message from b_commits union all
  select case when sha < '8' then 'a/fork' else 'zz/fork' end, sha, message from b_commits where ascii(sha) % 3 = 0)"""


@query("flt_09_unseen_commits", oracle=f"""
select min(repo) as repo, sha from {_FORKED} c
where not exists (select 1 from ({_NEWER}) d where d.repo = c.repo and d.after_commit = c.sha) group by sha""")
def _(t):
    return m.unseen(_forked(t), t.bind("b_dataset").where("exec_status is not null")).select("repo", "sha")


@query("jn_14_not_in_dataset", oracle=f"""
select sha, arg_min(message, repo) as message from {_FORKED} c
where not exists (select 1 from ({_NEWER}) d where d.repo = c.repo and d.after_commit = c.sha) group by sha""")
def _(t):
    return m.unseen(_forked(t), t.bind("b_dataset").where("exec_status is not null")).select("sha", "message")


def _forked(t):
    commits = t.bind("b_commits").select("repo", "sha", "message")
    fork = F.when(F.col("sha") < "8", F.lit("a/fork")).otherwise(F.lit("zz/fork"))
    return commits.unionByName(commits.where(F.ascii("sha") % 3 == 0).withColumn("repo", fork))


@query("flt_21_real_issues", oracle="select repo, number, title from b_issues where not is_pull_request")
def _(t):
    return m.real_issues(t.bind("b_issues")).select("repo", "number", "title")


@query("sc_01_closing_refs", oracle=_closing("b_commits", "repo, sha", "message"))
def _(t):
    return t.bind("b_commits").select(
        "repo", "sha", F.explode(refs.closing_refs(F.col("message"), F.col("repo"))).alias("number")
    )


@query("sc_01_closing_refs_strict_repo", oracle=_closing("b_commits", "repo, sha", "message", strict=True))
def _(t):
    return t.bind("b_commits").select(
        "repo", "sha", F.explode(refs.closing_refs(F.col("message"), F.col("repo"), True)).alias("number")
    )


@query("sc_02_project_refs", oracle=_project("b_commits", "repo, sha", "message"))
def _(t):
    return t.bind("b_commits").select("repo", "sha", F.explode(refs.project_refs(F.col("message"))).alias("number"))


@query("sc_20_verdict", oracle="select prompt_hash, contains(lower(trim(response)), 'yes') as confirmed from b_judgements")
def _(t):
    return t.bind("b_judgements").select("prompt_hash", m.is_confirmed(F.col("response")).alias("confirmed"))


_QUESTIONS = f"""{_MESSAGE},
questions as (
  select r.repo, r.sha, r.number, md5({PROMPT}) as prompt_hash
  from message_refs r join b_issues i on r.repo = i.repo and r.number = i.number and not i.is_pull_request
  join b_commits c on c.repo = r.repo and c.sha = r.sha
)"""


def _questions(t):
    commits = t.bind("b_commits")
    return m.prompts(m.message_refs(commits), commits, t.bind("b_issues")).drop("prompt")


@query("sc_21_prompts", oracle=f"with {_QUESTIONS} select * from questions")
def _(t):
    return _questions(t)


@query("sc_26_commit_year", oracle="select sha, year(coalesce(authored_at, committed_at)) as commit_year from b_commits")
def _(t):
    return m.commit_year(t.bind("b_commits")).select("sha", "commit_year")


@query("jn_03_commit_files", oracle="""
select c.repo, c.sha, f.status, f.path from b_commits c left join b_commit_files f on f.sha = c.sha""")
def _(t):
    return m.with_files(t.bind("b_commits"), t.bind("b_commit_files")).select("repo", "sha", "status", "path")


@query("jn_04_existing_refs", oracle=f"""with {_MESSAGE}
select repo, sha, number from message_refs r
where exists (select 1 from b_issues i where i.repo = r.repo and i.number = r.number and not i.is_pull_request)""")
def _(t):
    return m.existing(m.message_refs(t.bind("b_commits")), t.bind("b_issues"))


@query("jn_05_pull_refs", oracle=f"""with {_PULL}
select repo, sha, pr_number, number from pull_refs r
where exists (select 1 from b_issues i where i.repo = r.repo and i.number = r.number and not i.is_pull_request)""")
def _(t):
    return m.existing(m.pull_refs(t.bind("b_pulls")), t.bind("b_issues"))


@query("set_02_refs_of_both_sources", oracle=f"with {_ALL} select * from all_refs")
def _(t):
    return m.existing(_found(t), t.bind("b_issues"))


@query("jn_06_refs_with_verdicts", oracle=f"""with {_QUESTIONS}
select q.repo, q.sha, q.number, contains(lower(trim(j.response)), 'yes') as confirmed
from questions q left join b_judgements j using (prompt_hash)""")
def _(t):
    return m.with_verdicts(_questions(t), t.bind("b_judgements")).drop("prompt_hash")


@query("jn_15_to_judge", oracle=f"""with {_ALL}
select repo, sha, number, source_rank, pr_number from asked a
where not exists (select 1 from b_judgements j where j.prompt_hash = a.prompt_hash)""")
def _(t):
    return m.to_judge(_asked(t), t.bind("b_judgements")).drop("prompt", "prompt_hash")


@query("jn_13_push_windows", oracle="""
select repo_id, w.window_end from b_repos
join (select cast(unnest(range(date '2000-01-01', date '2001-07-02', interval 1 day)) as date) as window_end) w
  on cast(pushed_at as date) between greatest(w.window_end - 1, date '2000-01-01') and w.window_end""")
def _(t):
    return m.in_push_windows(t.bind("b_repos"), "2000-01-01", "2001-07-01").select("repo_id", "window_end")


@query("w_01_newest_window_per_repo", oracle="""
select repo_id, full_name, stars, window_end from (
  select *, row_number() over (partition by repo_id order by window_end desc, stars desc) as rn
  from b_repos join (select cast(unnest(range(date '2000-01-01', date '2001-07-02', interval 1 day)) as date) as window_end) w
    on cast(pushed_at as date) between greatest(w.window_end - 1, date '2000-01-01') and w.window_end) where rn = 1""")
def _(t):
    windowed = m.in_push_windows(t.bind("b_repos"), "2000-01-01", "2001-07-01")
    return m.newest_per_repo(windowed).select("repo_id", "full_name", "stars", "window_end")


@query("st_02_repos_by_stars", oracle="select full_name, stars from b_repos where language = 'Java' order by stars desc, full_name")
def _(t):
    return m.by_stars(t.bind("b_repos").where("language = 'Java'")).select("full_name", "stars")


@query("src_06_host_attributes", oracle="""
select r.full_name, r.stars, r.language, count(c.sha) as commits, min(c.committed_at) as first_commit
from b_repos r left join b_commits c on c.repo = r.full_name group by all""")
def _(t):
    commits = t.bind("b_commits").groupBy("repo").agg(
        F.count("sha").alias("commits"), F.min("committed_at").alias("first_commit")
    )
    repos = t.bind("b_repos").select("full_name", "stars", "language")
    joined = repos.join(commits, repos.full_name == commits.repo, "left").drop("repo")
    return joined.fillna(0, ["commits"])


@query("ag_25_linked_pulls", oracle="select distinct repo, sha, pr_number from b_pulls")
def _(t):
    return m.linked_pulls(t.bind("b_pulls"))


@query("ag_27_chosen_issue", oracle=f"""with {_ALL}
select repo, sha, arg_min(number, (source_rank, coalesce(pr_number, 0), number)) as issue_number from confirmed group by all""")
def _(t):
    return m.chosen_issue(_confirmed(t))


@query("ag_28_confirmed_by_message", oracle=f"with {_ALL} select distinct repo, sha from confirmed where source_rank = 0")
def _(t):
    return m.confirmed_by_message(_confirmed(t))


_RELEVANT = f"""with {_ALL}
select repo, sha, pr_number, base_sha, head_sha from b_pulls p
where exists (select 1 from confirmed c where c.source_rank = 1 and c.repo = p.repo and c.sha = p.sha and c.pr_number = p.pr_number)
qualify row_number() over (partition by repo, sha order by pr_number) = 1"""


@query("ag_29_relevant_pull", oracle=_RELEVANT)
def _(t):
    return m.relevant_pull(t.bind("b_pulls"), _confirmed(t))


@query("w_05_first_matching_pull", oracle=f"select repo, sha, pr_number from ({_RELEVANT})")
def _(t):
    return m.relevant_pull(t.bind("b_pulls"), _confirmed(t)).select("repo", "sha", "pr_number")


_CANDIDATES = _ALL + f""",
candidates as (
  select c.repo, c.sha, c.message from b_commits c
  where committed_at >= date '1996-01-01'
    and exists (select 1 from b_repos r where r.full_name = c.repo and r.language = 'Java' and not r.archived and r.stars >= 20
                and r.pushed_at >= date '1996-01-01'
                and exists (select 1 from b_repo_files f where f.repo = r.full_name and f.path = 'mvnw'))
    and not exists (select 1 from b_dataset d where d.repo = c.repo and d.after_commit = c.sha and d.exec_status = 'docker_image_built')
    and (select count(*) from b_commit_files f where f.sha = c.sha) <= 20
    and not exists (select 1 from b_commit_files f where f.sha = c.sha and not {_PLAIN})
)"""


def _host(t):
    return plan.Host(
        t.bind("b_repos"), t.bind("b_repo_files"), t.bind("b_commits"), t.bind("b_commit_files"),
        t.bind("b_issues"), t.bind("b_pulls"),
    )


@query("e1_mined_commits", oracle=f"""with {_CANDIDATES}
select repo, sha, arg_min(number, (source_rank, coalesce(pr_number, 0), number)) as issue_number
from confirmed join candidates using (repo, sha) group by all""")
def _(t):
    known = t.bind("b_dataset").where("exec_status = 'docker_image_built'")
    return plan.mined_commits(_host(t), known, t.bind("b_judgements"), since="1996-01-01")


@query("e1_pending_prompts", oracle=f"""with {_CANDIDATES}
select distinct r.repo, r.sha, r.number from asked r join candidates c using (repo, sha)
where not exists (select 1 from b_judgements j where r.prompt_hash = j.prompt_hash)""")
def _(t):
    known = t.bind("b_dataset").where("exec_status = 'docker_image_built'")
    found = plan.pending_prompts(_host(t), known, t.bind("b_judgements"), since="1996-01-01")
    return found.select("repo", "sha", "number")


@query("e3_answer_rounds", oracle=f"""with {_QUESTIONS},
judged as (select q.*, contains(lower(trim(j.response)), 'yes') as yes from questions q left join b_judgements j using (prompt_hash))
select repo, sha, number, 1 as round, case when substr(prompt_hash, 32, 1) < '8' then yes end as confirmed from judged
union all select repo, sha, number, 2 as round, yes as confirmed from judged""")
def _(t):
    # half of the answers are in the cache; what is pending then is asked, answered and appended
    cache = scratch_path(t.spark, "cache")
    said = staged(t.bind("b_judgements"), "said").select(
        "prompt_hash", F.lit(0).alias("seq"),
        F.struct(F.array(F.struct(F.col("response").alias("content"))).alias("samples")).alias("response"),
    )
    answers.record_answers(said.where(F.substring("prompt_hash", 32, 1) < "8"), cache, 1)
    asked = staged(_questions(t), "questions")
    first, pending = plan.judged(asked, cache, 1)
    answers.record_answers(said.join(pending.select("prompt_hash").distinct(), "prompt_hash", "left_semi"), cache, 1)
    second, _ = plan.judged(asked, cache, 1)
    rounds = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return rounds.select("repo", "sha", "number", "round", "confirmed")
