"""Queries over candidate outcomes, judgements, samples and task texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfmine.functions import links, paths
from perfmine.operators import changes, evaluation as e, measurement, mining, tasks
from perfmine.plans import measurement as plan
from perfmine.queries.changes import _MODULES
from perfmine.queries.measurement import _OUTCOMES, _TOTALS, _tail
from perfmine.queries.registry import query
from perfmine.session import scratch_path
from perfmine.sources import labels, results

_FOLDED = _OUTCOMES + """,
ranked as (
  select *, row_number() over (partition by commit_id order by (compile_error or not build_ok) desc, run_no, version) as rn
  from outcomes
),
first_log as (
  select commit_id, version, compile_error, (compile_error or not build_ok) as failed,
         (select count(*) from outcomes o where o.commit_id = ranked.commit_id and o.run_no between 1 and 2) as logs
  from ranked where rn = 1
),
folded as (
  select c.commit_id, c.patch_applicable,
         case when not patch_applicable then false when failed or logs = 4 then not (failed and compile_error) end as compile_success,
         case when not patch_applicable then false when failed or logs = 4 then not failed end as test_success,
         patch_applicable and case when coalesce(failed, false) then version = 'original' else coalesce(logs, 0) < 4 end as setup_error
  from b_candidates c left join first_log l on l.commit_id = c.commit_id
)"""


def _folded(t):
    return e.fold_outcomes(t.bind("b_candidates"), measurement.log_outcomes(t.bind("b_build_logs")))


@query("ag_22_folded_outcomes", oracle=f"with {_FOLDED} select * from folded")
def _(t):
    return _folded(t)


@query("snk_03_evaluation_json", oracle=f"with {_FOLDED} select commit_id, patch_applicable, compile_success, test_success from folded")
def _(t):
    path = scratch_path(t.spark, "evaluations")
    results.write_evaluations(_folded(t), path)
    return results.read_evaluations(t.spark, path).select("commit_id", "patch_applicable", "compile_success", "test_success")


_RESULTS = f"""with {_TOTALS.strip()},
ended as (
  select commit_id, version, run_no, bool_or(contains(line, 'BUILD SUCCESS')) and not bool_or(contains(line, 'BUILD FAILURE') or contains(line, 'BUILD ERROR')) as good
  from b_run_logs group by all
),
stops as (
  select commit_id, count(*) filter (run_no between 1 and 31) as logs, arg_min(version, run_no * 2 + cast(version <> 'original' as int)) filter (not good) as broken
  from ended group by all
),
states as (
  select s_suppkey as commit_id, s_suppkey % 5 <> 4 as applicable, broken, coalesce(logs, 0) as logs, s_suppkey % 5 <> 4 and broken is null and coalesce(logs, 0) = 62 as passed
  from supplier left join stops on commit_id = s_suppkey
),
vectors as (
  select commit_id, string_agg(cast(cast(round(total_seconds * 1000) as bigint) as varchar), ' ' order by run_no) filter (version = 'original') as original_exec_times,
         string_agg(cast(cast(round(total_seconds * 1000) as bigint) as varchar), ' ' order by run_no) filter (version = 'patched') as patched_exec_times
  from totals group by all
),
sides as (
  select o.commit_id, o.test_class, count(*) filter (p.seconds < 0.95 * o.seconds) as wins, count(*) filter (p.seconds > 0.95 * o.seconds) as losses,
         count(*) filter (o.seconds < 0.95 * p.seconds) as rwins, count(*) filter (o.seconds > 0.95 * p.seconds) as rlosses
  from last_times o join last_times p on o.commit_id = p.commit_id and o.run_no = p.run_no and o.test_class = p.test_class
   and o.version = 'original' and p.version = 'patched'
  where o.run_no > 1 group by all having count(*) = 30 and min(least(o.seconds, p.seconds)) >= 0.01
),
classes as (
  select commit_id, string_agg(test_class, '|' order by test_class) filter ({_tail('wins', 'losses')} < 0.1) as improved,
         string_agg(test_class, '|' order by test_class) filter (not coalesce({_tail('wins', 'losses')} < 0.1, false) and {_tail('rwins', 'rlosses')} < 0.1) as regressed
  from sides group by all
)
select s.commit_id, applicable as patch_applicable,
       case when not applicable then false when broken is not null or passed then true end as compile_success,
       case when not applicable then false when broken is not null or passed then passed end as test_success,
       case when passed then coalesce(improved, '') end as improved, case when passed then coalesce(regressed, '') end as regressed,
       case when passed then original_exec_times end as original_exec_times, case when passed then patched_exec_times end as patched_exec_times,
       applicable and case when broken is not null then broken = 'original' else not passed end as setup_error
from states s left join vectors v using (commit_id) left join classes c using (commit_id)"""


def _results(t):
    candidates = t.table("supplier").select(F.col("s_suppkey").alias("commit_id"), (F.col("s_suppkey") % 5 != 4).alias("patch_applicable"))
    return plan.evaluation_results(candidates, t.bind("b_run_logs"), measurement.DEFAULT)


def _plain(results_):
    cell = F.col("significant_improvements")
    millis = lambda c: F.array_join(F.transform(c, lambda s: F.round(s * 1000).cast("bigint").cast("string")), " ").alias(c)
    return results_.select(
        "commit_id", "patch_applicable", "compile_success", "test_success",
        F.array_join(cell[measurement.IMPROVED], "|").alias("improved"), F.array_join(cell[measurement.REGRESSED], "|").alias("regressed"),
        millis("original_exec_times"), millis("patched_exec_times"), *[c for c in ("setup_error",) if c in results_.columns],
    )


@query("e3_evaluation_results", oracle=_RESULTS)
def _(t):
    return _plain(_results(t))


@query("snk_03_whole_results", oracle=f"select * exclude (setup_error) from ({_RESULTS}) where not setup_error")
def _(t):
    path = scratch_path(t.spark, "results")
    results.write_evaluations(_results(t).where("not setup_error").drop("setup_error"), path)
    return _plain(results.read_evaluations(t.spark, path))


# pull request numbers are those of a repository: 7 numbers occur in several, with several commits each
_MATCHED = """
dataset as (
  select concat('o/r', cast(o_orderkey % 3 as varchar)) as repo, md5(cast(o_orderkey as varchar)) as after_commit, o_orderkey % 499 as pr_number,
         count(*) as n_files, count(distinct l_suppkey % 2) as n_modules
  from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'F' group by o_orderkey
),
judged as (select *, concat('o/r', cast(id % 3 as varchar)) as repo, id % 499 as pull from b_judged_patches),
by_pull as (select repo, pr_number, arg_min(n_files, after_commit) as n_files, arg_min(n_modules, after_commit) as n_modules from dataset group by all),
matched as (
  select j.id, j.judgment, j.pass_tests, coalesce(s.n_files, p.n_files) as n_files, coalesce(s.n_modules, p.n_modules) as n_modules,
         s.after_commit is not null or p.pr_number is not null as matched
  from judged j left join dataset s on s.repo = j.repo and s.after_commit = j.sha
  left join by_pull p on p.repo = j.repo and p.pr_number = j.pull and s.after_commit is null
)"""


def _matched(t):
    orders = t.table("orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    key = F.col("o_orderkey")
    shape = t.table("lineitem").join(orders, F.col("l_orderkey") == key).groupBy(key).agg(
        F.count("*").alias("n_files"), F.countDistinct(F.col("l_suppkey") % 2).alias("n_modules")
    )
    repo = lambda n: F.concat(F.lit("o/r"), (n % 3).cast("string")).alias("repo")
    dataset = shape.select(
        repo(key), F.md5(key.cast("string").cast("binary")).alias("after_commit"), (key % 499).alias("pr_number"), "n_files", "n_modules"
    )
    judged = t.bind("b_judged_patches").select("id", "judgment", "pass_tests", "sha", repo(F.col("id")), (F.col("id") % 499).alias("pr_number"))
    return e.with_dataset(judged, dataset)


@query("jn_12_judged_with_dataset", oracle=f"with {_MATCHED} select * from matched")
def _(t):
    return _matched(t)


@query("jn_12_unmatched_count", oracle=f"with {_MATCHED} select count(*) filter (not matched) as unmatched, count(*) as n from matched")
def _(t):
    return _matched(t).agg(F.count_if(~F.col("matched")).alias("unmatched"), F.count("*").alias("n"))


@query("ag_14_judgement_tally", oracle="""
with spine as (select unnest(['Exact Match', 'Semantic Equivalence', 'Partial Improvement', 'Correct Location', 'Off', 'N/A']) as judgment),
dense as (select s.judgment, count(j.id) as n from spine s left join b_judged_patches j on j.judgment = s.judgment group by all)
select judgment, n from dense union all select 'ALL', cast(sum(n) as bigint) from dense""")
def _(t):
    return e.judgement_tally(t.bind("b_judged_patches"))


_SLICES = """
with member as (
  select *, unnest(list_filter(['all', case when judgment <> 'N/A' then 'generated' end, case when n_files = 1 then 'single_file' end,
    case when n_files > 1 then 'multi_file' end, case when n_modules = 1 then 'single_module' end, case when n_modules > 1 then 'multi_module' end],
    lambda x: x is not null)) as slice from b_judged_patches
),
counts as (
  select slice, count(*) as n, count(*) filter (judgment <> 'N/A') as generated,
         count(*) filter (judgment in ('Exact Match', 'Semantic Equivalence', 'Correct Location')) as location,
         count(*) filter (judgment in ('Exact Match', 'Semantic Equivalence')) as semantic, count(*) filter (pass_tests) as passing
  from member group by slice
)
select slice, n, generated, location, semantic, passing, round(generated * 100.0::double / n, 1) as generated_pct, round(location * 100.0::double / n, 1) as location_pct,
       round(semantic * 100.0::double / n, 1) as semantic_pct, round(passing * 100.0::double / n, 1) as passing_pct from counts"""


@query("ag_15_slice_table", oracle=_SLICES)
def _(t):
    return e.slice_table(t.bind("b_judged_patches"))


@query("ag_16_detector_quality", oracle="""
select tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall
from (select count(*) filter (detected and truth) as tp, count(*) filter (detected and not truth) as fp,
             count(*) filter (not detected and truth) as fn, count(*) filter (not detected and not truth) as tn from b_detection)""")
def _(t):
    quality = e.detector_quality(t.bind("b_detection"))
    return quality.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("ag_17_confirmed_share", oracle="""
select count(*) filter (truth) as confirmed, count(*) as n, round(count(*) filter (truth) / count(*), 6) as share from b_detection where detected""")
def _(t):
    share = e.confirmed_share(t.bind("b_detection").where("detected"), F.col("truth"))
    return share.withColumn("share", F.round("share", 6))


@query("ag_18_flag_share", oracle="select count(*) filter (has_mvnw) as flagged, count(*) as repos from (select distinct full_name, has_mvnw from b_repos)")
def _(t):
    flags = t.bind("b_repos").select(F.col("full_name").alias("repo"), F.col("has_mvnw").alias("flag"))
    return e.flag_share(flags.unionAll(flags))


@query("src_12_flag_list", oracle="select distinct full_name as repo, has_mvnw as flag from b_repos")
def _(t):
    flag = F.when(F.col("has_mvnw"), F.lit("True")).otherwise(F.lit("False"))
    rows = t.bind("b_repos").select(
        F.explode(F.array(
            F.concat_ws(" ", "full_name", flag), F.concat_ws("  ", "full_name", flag), F.concat(F.lit("# "), "full_name", F.lit(" True")),
            F.lit(""), F.concat(F.lit("https://github.com/"), "full_name", F.lit(" fail")),
        )).alias("value")
    )
    path = scratch_path(t.spark, "flags")
    rows.write.text(path)
    return labels.read_flags(t.spark, path)


@query("src_10_judgement_csv", oracle="""
select concat('i', cast(id as varchar)) as issue, coalesce(sha, 'none') as ground_truth_patch, judgment from b_judged_patches""")
def _(t):
    rows = t.bind("b_judged_patches").select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("issue"), F.coalesce("sha", F.lit("none")).alias("ground-truth_patch"),
        F.lit("p,q \"r\"").alias("generated_patch"), "judgment", F.lit(None).cast("string").alias("extra info"),
        F.lit("legend").alias("Exact Match"), F.lit("9").alias("9"),
    )
    path = scratch_path(t.spark, "judgements")
    rows.write.options(header="true", quote='"', escape='"').csv(path)
    return labels.read_patch_judgements(t.spark, path).select("issue", "ground_truth_patch", "judgment")


@query("src_11_test_lists", oracle="""
select concat(replace(n_name, ' ', '_'), '_', cast(n_nationkey as varchar)) as key, count(*) as n_classes, count(distinct c_name) as classes
from customer join nation on c_nationkey = n_nationkey group by all""")
def _(t):
    rows = t.sql("""select concat(replace(n_name, ' ', '_'), '_', cast(n_nationkey as string)) as key, c_name as value
                    from customer join nation on c_nationkey = n_nationkey""")
    path = scratch_path(t.spark, "lists")
    # folders without a partition name, as the lists are laid out by key
    rows.select(F.concat(F.lit("x__"), "key").alias("k"), F.concat(F.lit(" "), "value").alias("value")).write.partitionBy("k").text(path)
    read = labels.read_test_lists(t.spark, path)
    return read.groupBy(F.regexp_replace("key", "^k=x__", "").alias("key")).agg(
        F.count("*").alias("n_classes"), F.countDistinct("test_class").alias("classes")
    )


@query("src_13_commit_codes", oracle="""
select concat('https://github.com/', repo, '/commit/', sha) as url, case when length(message) % 3 = 0 then 'pr' when length(message) % 3 = 1 then 'n' end as code
from b_commits""")
def _(t):
    url = F.concat(F.lit("https://github.com/"), "repo", F.lit("/commit/"), "sha")
    kind = F.length("message") % 3
    line = F.when(kind == 0, F.concat(url, F.lit(",pr"))).when(kind == 1, F.concat(url, F.lit(",n"))).otherwise(url)
    path = scratch_path(t.spark, "codes")
    t.bind("b_commits").select(line.alias("value")).write.text(path)
    return labels.read_commit_codes(t.spark, path)


@query("sc_03_commit_links", oracle="""
select split_part(repo, '/', 1) as owner, split_part(repo, '/', 2) as name, sha from b_commits""")
def _(t):
    link = links.commit_link(F.concat(F.lit("https://github.com/"), "repo", F.lit("/commit/"), "sha"))
    return t.bind("b_commits").select(link.alias("l")).select("l.owner", F.col("l.repo").alias("name"), "l.sha")


@query("sc_03_pull_links", oracle="select repo, pr_number from b_pulls")
def _(t):
    link = links.pull_link(F.concat(F.lit("https://github.com/"), "repo", F.lit("/pull/"), F.col("pr_number").cast("string"), F.lit("/changes")))
    return t.bind("b_pulls").select(link.alias("l")).select("l.*")


# --- texts ---------------------------------------------------------------------------

# in-place Java sources with a module, of commits of any size
_TASKS = _MODULES + """,
chosen as (select c.repo, c.sha, i.number, i.title, i.body from b_commits c
           join (select repo, min(number) as number, arg_min_null(title, number) as title, arg_min_null(body, number) as body from b_issues group by repo) i on i.repo = c.repo),
fitting as (select sha, string_agg(distinct module, ',' order by module) as modules, string_agg(distinct path, chr(10) order by path) as files
            from assigned semi join (select sha, path from b_commit_files where status = 'M' and lower(path) like '%.java'
              and not contains(lower(path), 'test') and not contains(lower(path), 'generated')) q using (sha, path) group by sha)"""


def _task_sql(kind: str) -> str:
    template = tasks.TEMPLATES[kind].replace("'", "''").replace("\n", "' || chr(10) || '")
    expression = f"('{template}')"
    for mark, value in zip(
        tasks.PLACEHOLDERS,
        ("coalesce(title, '')", "coalesce(body, '')", "modules", "files", "split_part(repo, '/', -1)"),
    ):
        expression = f"replace({expression}, '{mark}', {value})"
    return f"with {_TASKS} select sha, {expression} as task from chosen join fitting using (sha)"


def _tasks(t, kind: str):
    files = t.bind("b_commit_files")
    records = files.withColumn("record", paths.change_record(F.col("status"), F.col("path"), F.concat("path", F.lit("2"))))
    sources = changes.java_sources(changes.changed_in_place(records)).select("sha", "path").distinct()
    lists = changes.modules_and_files(changes.nearest_modules(sources, t.bind("b_poms")))
    issue = t.bind("b_issues").groupBy("repo").agg(F.min_by(F.struct("title", "body"), "number").alias("i")).select("repo", "i.*")
    commits = t.bind("b_commits").select("repo", "sha").join(issue, "repo").join(lists, "sha")
    return tasks.task_texts(commits, tasks.TEMPLATES[kind]).select("sha", "task")


@query("sc_22_patch_tasks", oracle=_task_sql("patch"))
def _(t):
    return _tasks(t, "patch")


@query("sc_22_test_tasks", oracle=_task_sql("test"))
def _(t):
    return _tasks(t, "test")


def _patches(files):
    patch = F.when(~F.col("path").endswith(".xml"), F.concat(F.lit("@@ "), "status"))
    return files.select("sha", F.struct("path", "status").alias("position"), "path", patch.alias("patch"))


@query("sc_23_diff_pieces", oracle="""
select sha, path, status, concat('--- ', path, chr(10), '@@ ', status, chr(10)) as piece from b_commit_files where path not like '%.xml'""")
def _(t):
    return tasks.diff_pieces(_patches(t.bind("b_commit_files"))).select("sha", "position.*", "piece")


@query("sc_23_commit_diffs", oracle="""
select sha, string_agg(concat('--- ', path, chr(10), '@@ ', status, chr(10)), '' order by path, status) as diff
from b_commit_files where path not like '%.xml' group by sha""")
def _(t):
    # one cell per commit, as large as the commit; sc_23_diff_pieces has the same as rows
    return tasks.commit_diffs(_patches(t.bind("b_commit_files")))
