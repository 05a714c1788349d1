"""Queries over build logs and paired measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfmine.functions import links
from perfmine.operators import measurement as m
from perfmine.plans import measurement as plan
from perfmine.queries.registry import query
from perfmine.schemas import DATASET
from perfmine.session import scratch_path

# --- shared SQL of the oracles --------------------------------------------------

# units in seconds; only [INFO] lines match
_TIMES = r"""
times as (
  select commit_id, version, run_no, line_no, trim(regexp_extract(line, p, 3)) as test_class,
         case regexp_extract(line, p, 2) when 'ms' then v / 1000 when 's' then v when 'min' then v * 60 else v * 3600 end as seconds
  from (select *, try_cast(regexp_extract(line, p, 1) as double) as v
        from (select *, '\[INFO\] Tests run:.*?Time elapsed:\s+([\d.]+)\s+(ms|s|min|h)\s+-+\s+in\s+(.+)' as p from b_run_logs) a
        where regexp_matches(line, p)) b
),
last_times as (
  select commit_id, version, run_no, test_class, arg_max(seconds, line_no) as seconds
  from times group by all
)"""
_TOTALS = _TIMES + """,
totals as (
  select l.commit_id, l.version, l.run_no, coalesce(sum(seconds), 0.0) as total_seconds
  from (select distinct commit_id, version, run_no from b_run_logs) l
  left join last_times t on l.commit_id = t.commit_id and l.version = t.version and l.run_no = t.run_no
  group by all
),
total_pairs as (
  select o.commit_id, o.run_no, o.total_seconds as o, p.total_seconds as p
  from totals o join totals p on o.commit_id = p.commit_id and o.run_no = p.run_no
   and o.version = 'original' and p.version = 'patched' where o.run_no > 1
)"""
# commits with all 62 logs, all of them successful, from the text of the logs
_MEASURABLE = """,
log_texts as (select commit_id, version, run_no, string_agg(line, chr(10)) as log from b_run_logs group by all),
measurable as (
  select commit_id from log_texts group by all
  having bool_and(contains(log, 'BUILD SUCCESS') and not contains(log, 'BUILD FAILURE') and not contains(log, 'BUILD ERROR'))
     and count(*) filter (run_no between 1 and 31) = 62
)"""
_PAIRS = """
o as (select * from b_runs where version = 'original' and run_no > 1),
p as (select * from b_runs where version = 'patched' and run_no > 1),
pairs as (
  select o.commit_id, o.test_class, o.run_no, o.seconds as o, p.seconds as p
  from o join p on o.commit_id = p.commit_id and o.test_class = p.test_class and o.run_no = p.run_no
),
sides as (
  select commit_id, test_class, count(o) as original_runs, count(p) as patched_runs, min(least(o, p)) as least_seconds,
         sum(o) as so, sum(p) as sp,
         count(*) filter (p < 0.95 * o) as wins, count(*) filter (p > 0.95 * o) as losses,
         count(*) filter (o < 0.95 * p) as reverse_wins, count(*) filter (o > 0.95 * p) as reverse_losses
  from pairs group by all
),
signs as (select * from sides where original_runs = 30 and patched_runs = 30 and least_seconds >= 0.01)"""


def _tail(wins: str, losses: str) -> str:
    n = f"({wins} + {losses})"
    return (
        f"case when {n} > 0 then list_sum(list_transform(range({wins}, {n} + 1), lambda i: "
        f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0)))) end"
    )


_TESTED = _PAIRS + f""",
tested as (
  select *, {_tail('wins', 'losses')} as p_value, {_tail('reverse_wins', 'reverse_losses')} as reverse_p_value from signs
)"""
_VERDICTS = _TESTED + """,
verdicts as (
  select *, case when p_value < 0.1 then 'patched_outperforms_original'
                 when reverse_p_value < 0.1 then 'original_outperforms_patched' end as verdict
  from tested
)"""


def _pairs(t):
    return m.paired(m.without_warmup(t.bind("b_runs")), ["commit_id", "test_class"])


def _tested(t):
    return m.with_p_values(m.class_signs(m.both_sides(_pairs(t))))


@query("ag_07_class_verdicts", oracle=f"with {_VERDICTS} select commit_id, test_class, wins, losses, "
       "round(p_value, 6) as p_value, round(reverse_p_value, 6) as reverse_p_value, verdict from verdicts")
def _(t):
    return m.with_verdict(_tested(t)).select(
        "commit_id", "test_class", "wins", "losses",
        F.round("p_value", 6).alias("p_value"), F.round("reverse_p_value", 6).alias("reverse_p_value"), "verdict",
    )


@query("ag_07_verdict_cells", oracle=f"""with {_VERDICTS}
select commit_id,
       coalesce(string_agg(test_class, '|' order by test_class) filter (verdict = 'original_outperforms_patched'), '') as regressed,
       coalesce(string_agg(test_class, '|' order by test_class) filter (verdict = 'patched_outperforms_original'), '') as improved
from verdicts where verdict is not null group by commit_id""")
def _(t):
    cells = m.verdict_cells(m.with_verdict(_tested(t)))
    cell = F.col("test_class_improvements")
    return cells.select(
        "commit_id",
        F.array_join(cell[m.REGRESSED], "|").alias("regressed"),
        F.array_join(cell[m.IMPROVED], "|").alias("improved"),
    )


@query("ag_06_sign_tail", oracle=f"with {_TESTED} select commit_id, test_class, wins + losses as n, round(p_value, 6) as p_value from tested")
def _(t):
    return _tested(t).select(
        "commit_id", "test_class", (F.col("wins") + F.col("losses")).alias("n"), F.round("p_value", 6).alias("p_value")
    )


@query("ag_05_sign_counts", oracle=f"with {_PAIRS} select commit_id, test_class, wins, losses, reverse_wins, reverse_losses from sides")
def _(t):
    return m.class_sides(m.both_sides(_pairs(t))).select(
        "commit_id", "test_class", "wins", "losses", "reverse_wins", "reverse_losses"
    )


@query("flt_13_warmup_dropped", oracle="select commit_id, test_class, version, run_no, round(seconds, 6) as seconds from b_runs where run_no > 1")
def _(t):
    return m.without_warmup(t.bind("b_runs")).select(
        "commit_id", "test_class", "version", "run_no", F.round("seconds", 6).alias("seconds")
    )


@query("flt_14_complete_classes", oracle=f"with {_PAIRS} select commit_id, test_class, original_runs, patched_runs from sides where original_runs = 30 and patched_runs = 30")
def _(t):
    return m.complete_classes(m.class_sides(m.both_sides(_pairs(t)))).select(
        "commit_id", "test_class", "original_runs", "patched_runs"
    )


@query("flt_15_noise_floor", oracle=f"with {_PAIRS} select commit_id, test_class, round(least_seconds, 6) as least_seconds from sides where least_seconds >= 0.01")
def _(t):
    return m.above_noise(m.class_sides(m.both_sides(_pairs(t)))).select(
        "commit_id", "test_class", F.round("least_seconds", 6).alias("least_seconds")
    )


@query("flt_16_significant", oracle=f"with {_TESTED} select commit_id, test_class, round(p_value, 6) as p_value from tested where p_value < 0.1")
def _(t):
    return m.significant(_tested(t)).select("commit_id", "test_class", F.round("p_value", 6).alias("p_value"))


@query("jn_02_class_pairs", oracle=f"with {_PAIRS} select commit_id, test_class, run_no, round(o, 6) as original, round(p, 6) as patched from pairs")
def _(t):
    return m.both_sides(_pairs(t)).select(
        "commit_id", "test_class", "run_no", F.round("original", 6).alias("original"), F.round("patched", 6).alias("patched")
    )


@query("sc_29_relative_improvement", oracle=f"with {_PAIRS} select commit_id, test_class, round((so - sp) / nullif(so, 0), 6) as improvement from sides")
def _(t):
    from perfmine.functions.stats import relative_improvement

    sides = m.class_sides(m.both_sides(_pairs(t)))
    return sides.select(
        "commit_id", "test_class",
        F.round(relative_improvement(F.col("original_seconds"), F.col("patched_seconds")), 6).alias("improvement"),
    )


@query("ag_03_class_vectors", oracle="""
select commit_id, test_class, version, string_agg(cast(cast(round(seconds * 1000) as bigint) as varchar), ' ' order by run_no) as millis
from b_runs where run_no > 1 group by all""")
def _(t):
    vectors = m.class_vectors(t.bind("b_runs"))
    millis = F.transform("seconds", lambda s: F.round(s * 1000).cast("bigint").cast("string"))
    return vectors.select("commit_id", "test_class", "version", F.array_join(millis, " ").alias("millis"))


# --- log text ---------------------------------------------------------------------


@query("sc_06_test_lines", oracle=f"with {_TIMES} select commit_id, version, run_no, line_no, test_class, round(seconds, 6) as seconds from times")
def _(t):
    return m.test_times(t.bind("b_run_logs")).withColumn("seconds", F.round("seconds", 6))


@query("ag_02_last_line_wins", oracle=f"with {_TIMES} select commit_id, version, run_no, test_class, round(seconds, 6) as seconds from last_times")
def _(t):
    return m.last_time_per_class(m.test_times(t.bind("b_run_logs"))).withColumn("seconds", F.round("seconds", 6))


@query("w_03_last_in_log", oracle=f"""with {_TIMES}
select commit_id, version, run_no, test_class, line_no from times
qualify row_number() over (partition by commit_id, version, run_no, test_class order by line_no desc) = 1""")
def _(t):
    times = m.test_times(t.bind("b_run_logs"))
    return times.groupBy("commit_id", "version", "run_no", "test_class").agg(F.max("line_no").alias("line_no"))


@query("ag_01_run_totals", oracle=f"with {_TOTALS} select commit_id, version, run_no, round(total_seconds, 4) as total_seconds from totals")
def _(t):
    logs = t.bind("b_run_logs")
    times = m.last_time_per_class(m.test_times(logs))
    return m.run_totals(times, logs).withColumn("total_seconds", F.round("total_seconds", 4))


@query("jn_01_run_pairs", oracle=f"with {_TOTALS} select commit_id, run_no, round(o, 4) as original, round(p, 4) as patched from total_pairs")
def _(t):
    logs = t.bind("b_run_logs")
    totals = m.run_totals(m.last_time_per_class(m.test_times(logs)), logs)
    pairs = m.both_sides(m.paired(m.without_warmup(totals), ["commit_id"], "total_seconds"))
    return pairs.select("commit_id", "run_no", F.round("original", 4).alias("original"), F.round("patched", 4).alias("patched"))


_IMPROVEMENT = f"""with {_TOTALS}{_MEASURABLE},
s as (select commit_id, count(*) as runs, sum(o) as so, sum(p) as sp,
             count(*) filter (p < 0.95 * o) as wins, count(*) filter (p > 0.95 * o) as losses
      from total_pairs group by all)
select commit_id, runs, round((so - sp) / nullif(so, 0), 6) as exec_time_improvement, round({_tail('wins', 'losses')}, 6) as p_value from s"""


@query("ag_04_total_improvement", oracle=_IMPROVEMENT)
def _(t):
    logs = t.bind("b_run_logs")
    result = m.total_improvement(m.run_totals(m.last_time_per_class(m.test_times(logs)), logs))
    return result.withColumn("exec_time_improvement", F.round("exec_time_improvement", 6)).withColumn(
        "p_value", F.round("p_value", 6)
    )


@query("e2_commit_improvement", oracle=f"{_IMPROVEMENT} semi join measurable using (commit_id)")
def _(t):
    result = plan.commit_improvement(t.bind("b_run_logs"))
    return result.withColumn("exec_time_improvement", F.round("exec_time_improvement", 6)).withColumn(
        "p_value", F.round("p_value", 6)
    )


@query("src_03_missing_logs", oracle="""
with have as (select distinct commit_id, test_class, version, run_no from b_runs)
select w.commit_id, w.test_class, w.version, w.run_no
from (select c.commit_id, c.test_class, v.version, r.run_no from (select distinct commit_id, test_class from have) c
      cross join (values ('original'), ('patched')) v(version) cross join (select unnest(range(1, 32)) as run_no) r) w
left join have h on w.commit_id = h.commit_id and w.test_class = h.test_class and w.version = h.version and w.run_no = h.run_no
where h.commit_id is null""")
def _(t):
    return m.missing_logs(t.bind("b_runs"), keys=("commit_id", "test_class"))


_OUTCOMES = r"""
texts as (select commit_id, version, run_no, string_agg(line, chr(10) order by line_no) as log from b_build_logs group by all),
outcomes as (
  select commit_id, version, run_no,
         contains(log, 'BUILD SUCCESS') and not contains(log, 'BUILD FAILURE') and not contains(log, 'BUILD ERROR') as build_ok,
         regexp_matches(log, '(?im)^\[ERROR\]\s+Failed to execute goal .*maven-compiler-plugin.*:(compile|testCompile)\b')
         or regexp_matches(log, '(?im)^\[ERROR\]\s+COMPILATION ERROR\s*:?')
         or regexp_matches(log, '(?im)^\[ERROR\]\s+Compilation failure\b')
         or regexp_matches(log, '(?im)^\[ERROR\]\s+Fatal error compiling\b')
         or regexp_matches(log, '(?im)^\[ERROR\]\s+No compiler is provided in this environment\b')
         or (regexp_matches(log, '(?is)Failed to execute goal .*maven-compiler-plugin.*:(compile|testCompile)\b')
             and regexp_matches(log, '(?i)\bCompilation failure\b')) as compile_error
  from texts)"""


@query("flt_10_build_success", oracle=f"with {_OUTCOMES} select commit_id, version, run_no, build_ok from outcomes")
def _(t):
    return m.logs_ok(t.bind("b_build_logs"))


@query("flt_11_compile_error", oracle=f"with {_OUTCOMES} select commit_id, version, run_no, build_ok, compile_error from outcomes")
def _(t):
    return m.log_outcomes(t.bind("b_build_logs"))


@query("flt_12_all_logs_ok", oracle=f"with {_OUTCOMES} select commit_id from outcomes group by all having bool_and(build_ok)")
def _(t):
    return m.fully_successful(m.logs_ok(t.bind("b_build_logs")))


@query("sc_07_total_time", oracle=r"""
with found as (
  select commit_id, version, run_no, arg_min(trim(regexp_extract(line, '(?i)Total time:\s+([^\n\r]+)', 1)), line_no) as total_time
  from b_build_logs where regexp_matches(line, '(?i)Total time:\s+([^\n\r]+)') group by all
)
select commit_id, version, run_no, total_time,
       round(case when contains(lower(total_time), 's') and not contains(lower(total_time), 'min') then try_cast(regexp_extract(total_time, '[\d.]+') as double)
            when contains(lower(total_time), 'min') then cast(split_part(regexp_extract(total_time, '[\d:.]+'), ':', 1) as double) * 60 + cast(split_part(regexp_extract(total_time, '[\d:.]+'), ':', 2) as double)
            when contains(lower(total_time), 'h') then cast(split_part(regexp_extract(total_time, '[\d:.]+'), ':', 1) as double) * 3600 + cast(split_part(regexp_extract(total_time, '[\d:.]+'), ':', 2) as double) * 60 + cast(split_part(regexp_extract(total_time, '[\d:.]+'), ':', 3) as double) end, 6) as seconds
from found""")
def _(t):
    return m.total_times(t.bind("b_build_logs")).withColumn("seconds", F.round("seconds", 6))


@query("e2_measured_commits", oracle=f"""with {_TOTALS}{_MEASURABLE},
sides as (
  select o.commit_id, o.test_class, count(*) as n, min(least(o.seconds, p.seconds)) as least_seconds,
         count(*) filter (p.seconds < 0.95 * o.seconds) as wins, count(*) filter (p.seconds > 0.95 * o.seconds) as losses,
         count(*) filter (o.seconds < 0.95 * p.seconds) as rwins, count(*) filter (o.seconds > 0.95 * p.seconds) as rlosses
  from last_times o join last_times p on o.commit_id = p.commit_id and o.run_no = p.run_no and o.test_class = p.test_class
   and o.version = 'original' and p.version = 'patched'
  where o.run_no > 1 group by all having count(*) = 30 and min(least(o.seconds, p.seconds)) >= 0.01
),
v as (select commit_id, count(*) filter ({_tail('wins', 'losses')} < 0.1) as improved,
             count(*) filter (not coalesce({_tail('wins', 'losses')} < 0.1, false) and {_tail('rwins', 'rlosses')} < 0.1) as regressed
      from sides group by all),
s as (select commit_id, count(*) as runs, sum(o) as so, sum(p) as sp,
             count(*) filter (p < 0.95 * o) as wins, count(*) filter (p > 0.95 * o) as losses
      from total_pairs group by all)
select s.commit_id, runs, round((so - sp) / nullif(so, 0), 6) as exec_time_improvement, round({_tail('wins', 'losses')}, 6) as p_value,
       coalesce(improved, 0) as improved_classes, coalesce(regressed, 0) as regressed_classes
from s left join v on s.commit_id = v.commit_id semi join measurable m on m.commit_id = s.commit_id""")
def _(t):
    result = plan.measured_commits(t.bind("b_run_logs"))
    return result.withColumn("exec_time_improvement", F.round("exec_time_improvement", 6)).withColumn(
        "p_value", F.round("p_value", 6)
    )


_RECORDED = f"""with {_TOTALS}{_MEASURABLE},
sides as (
  select o.commit_id, o.test_class, count(*) filter (p.seconds < 0.95 * o.seconds) as wins, count(*) filter (p.seconds > 0.95 * o.seconds) as losses,
         count(*) filter (o.seconds < 0.95 * p.seconds) as rwins, count(*) filter (o.seconds > 0.95 * p.seconds) as rlosses
  from last_times o join last_times p on o.commit_id = p.commit_id and o.run_no = p.run_no and o.test_class = p.test_class
   and o.version = 'original' and p.version = 'patched'
  where o.run_no > 1 group by all having count(*) = 30 and min(least(o.seconds, p.seconds)) >= 0.01
),
v as (
  select commit_id, string_agg(test_class, '|' order by test_class) filter ({_tail('wins', 'losses')} < 0.1) as improved,
         string_agg(test_class, '|' order by test_class) filter (not coalesce({_tail('wins', 'losses')} < 0.1, false) and {_tail('rwins', 'rlosses')} < 0.1) as regressed
  from sides group by all
),
s as (select commit_id, sum(o) as so, sum(p) as sp, count(*) filter (p < 0.95 * o) as wins, count(*) filter (p > 0.95 * o) as losses
      from total_pairs group by all),
new as (
  select s.commit_id, (so - sp) / nullif(so, 0) as improvement, {_tail('wins', 'losses')} as p_value, coalesce(improved, '') as improved, coalesce(regressed, '') as regressed
  from s left join v using (commit_id) semi join measurable using (commit_id)
),
old as (select distinct l_suppkey % 7 as commit_id from lineitem where l_suppkey % 7 <> 1)
select concat('o/r', cast(commit_id as varchar)) as repo, md5(cast(commit_id as varchar)) as after_commit,
       case when new.commit_id is not null then 'maven_execution_successful' else 'docker_image_built' end as exec_status,
       round(improvement, 6) as exec_time_improvement, round(p_value, 6) as p_value, improved, regressed,
       case when old.commit_id is not null then commit_id + 100 end as pr_number
from old full join new using (commit_id)""".replace("b_run_logs", "b_log_files")


@query("e2_dataset_from_log_files", oracle=_RECORDED)
def _(t):
    """From log files of both name forms to the dataset after the upsert."""
    n = F.col("commit_id")
    sha = F.md5(n.cast("string").cast("binary"))
    run = F.col("run_no").cast("string")
    name = F.when(n % 2 == 0, F.concat("version", F.lit("_repo_mvnw_"), run, F.lit(".log"))).otherwise(
        F.concat(F.lit("mvnw_"), (F.col("run_no") - 1).cast("string"), F.lit("_"), "version", F.lit(".log"))
    )
    path = scratch_path(t.spark, "log-files")
    key = links.path_key(F.concat(F.lit("o/r"), n.cast("string")), sha)
    files = t.bind("b_log_files").select(key.alias("commit"), name.alias("name"), "line_no", F.col("line").alias("value"))
    files.repartition("commit", "name").sortWithinPartitions("commit", "name", "line_no").drop("line_no").write.partitionBy("commit", "name").text(path)

    empty = {f.name: F.lit(None).cast(f.dataType) for f in DATASET}
    known = t.table("lineitem").select((F.col("l_suppkey") % 7).cast("long").alias("commit_id")).distinct().where("commit_id <> 1")
    filled = {
        "repo": F.concat(F.lit("o/r"), n.cast("string")), "after_commit": sha, "exec_status": F.lit("docker_image_built"), "pr_number": n + 100,
    }
    dataset = known.select(*[value.alias(c) for c, value in {**empty, **filled}.items()])
    result = plan.record_measurements(t.spark, path, dataset, F.regexp_extract("file", r"/commit=([^/]*)/", 1))
    cell = F.col("test_class_improvements")
    return result.select(
        "repo", "after_commit", "exec_status", F.round("exec_time_improvement", 6).alias("exec_time_improvement"), F.round("p_value", 6).alias("p_value"),
        F.array_join(cell[m.IMPROVED], "|").alias("improved"), F.array_join(cell[m.REGRESSED], "|").alias("regressed"), "pr_number",
    )
