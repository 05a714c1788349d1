"""Queries over diffs, changed files, modules and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfmine.functions import logtext, paths
from perfmine.operators import changes as c
from perfmine.operators import mining
from perfmine.queries.registry import query
from perfmine.session import scratch_path
from perfmine.sources import coverage as coverage_source
from perfmine.sources import lines as line_source

_STATUS_LINE = "case when status = 'R100' then concat(status, chr(9), path, chr(9), path, '2') when status = 'D' then concat('D', chr(9), path) else concat(status, chr(9), path) end"
_RECORDS = f"""
records as (
  select sha, line, case when line like 'R100%' or line like 'D%' or line like 'M%' then split_part(line, chr(9), 2) end as old_path,
         case when line like 'R100%' then split_part(line, chr(9), 3) when line like 'D%' then null else split_part(line, chr(9), 2) end as new_path
  from (select sha, {_STATUS_LINE} as line from b_commit_files) q
)"""


def _records(t):
    tab, status, path = F.lit("\t"), F.col("status"), F.col("path")
    line = F.when(status == "R100", F.concat(status, tab, path, tab, path, F.lit("2"))).otherwise(F.concat(status, tab, path))
    lines = t.bind("b_commit_files").select("sha", "path", line.alias("line"))
    return lines.withColumn("record", paths.change_record_of_line(F.col("line")))


@query("sc_09_change_records", oracle=f"with {_RECORDS} select sha, old_path, new_path from records")
def _(t):
    return _records(t).select("sha", "record.old_path", "record.new_path")


@query("src_07_name_status_text", oracle=f"with {_RECORDS} select old_path, new_path, count(*) as n from records group by all")
def _(t):
    path = scratch_path(t.spark, "name-status")
    _records(t).select("line").write.text(path)
    record = paths.change_record_of_line(F.col("value")).alias("r")
    return t.spark.read.text(path).select(record).groupBy("r.old_path", "r.new_path").agg(F.count("*").alias("n"))


@query("flt_06_java_sources", oracle="""
select sha, path from b_commit_files
where lower(path) like '%.java' and not contains(lower(path), 'test') and not contains(lower(path), 'generated')""")
def _(t):
    return c.java_sources(t.bind("b_commit_files")).select("sha", "path")


@query("flt_07_java_tests", oracle="""
select sha, path from b_commit_files
where lower(path) like '%.java' and contains(lower(path), '/test/') and not contains(lower(path), 'generated')""")
def _(t):
    return c.java_tests(t.bind("b_commit_files")).select("sha", "path")


@query("flt_08_in_place", oracle=f"with {_RECORDS} select sha, old_path from records where old_path = new_path")
def _(t):
    return c.changed_in_place(_records(t)).select("sha", "record.old_path")


# --- diff text -----------------------------------------------------------------------

_NUMBERED = r"""
kinds as (
  select *, case when regexp_matches(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@') then 'hunk' when line like '@@%' then null
                 when line like '-%' and line not like '---%' then 'removed' when line like '+%' and line not like '+++%' then 'added'
                 when line like ' %' then 'context' end as kind
  from b_diff_lines
),
hunks as (select *, sum(case when kind = 'hunk' then 1 else 0 end) over (partition by patch_id order by seq) as hunk from kinds),
counted as (
  select *, sum(case when kind in ('removed', 'context') then 1 else 0 end) over w as o, sum(case when kind in ('added', 'context') then 1 else 0 end) over w as n,
         coalesce(max(case when kind = 'hunk' then cast(regexp_extract(line, '-(\d+)', 1) as bigint) end) over (partition by patch_id, hunk), 0) as old_start,
         coalesce(max(case when kind = 'hunk' then cast(regexp_extract(line, '\+(\d+)', 1) as bigint) end) over (partition by patch_id, hunk), 0) as new_start
  from hunks window w as (partition by patch_id, hunk order by seq)
),
numbered as (
  select patch_id, seq, case kind when 'removed' then 'original' else 'patched' end as version,
         cast(case kind when 'removed' then old_start + o - 1 else new_start + n - 1 end as bigint) as line_no
  from counted where kind in ('removed', 'added')
)"""


@query("w_04_line_counters", oracle=f"with {_NUMBERED} select patch_id, seq, version, line_no from numbered")
def _(t):
    return c.numbered_lines(t.bind("b_diff_lines"))


@query("sc_10_changed_lines", oracle=f"with {_NUMBERED} select distinct patch_id, version, line_no from numbered")
def _(t):
    return c.numbered_lines(t.bind("b_diff_lines")).select("patch_id", "version", "line_no").distinct()


@query("st_03_sorted_lines", oracle=f"""with {_NUMBERED}
select patch_id, version, min(line_no) as first_line, max(line_no) as last_line, count(distinct line_no) as n_lines from numbered group by all""")
def _(t):
    lines = c.numbered_lines(t.bind("b_diff_lines"))
    return lines.groupBy("patch_id", "version").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.countDistinct("line_no").alias("n_lines")
    )


@query("st_03_line_lists", oracle=f"""with {_NUMBERED}
select patch_id, version, array_to_string(list_sort(list_distinct(list(line_no))), ' ') as line_list from numbered group by all""")
def _(t):
    numbers = F.transform(F.sort_array(F.collect_set("line_no")), lambda n: n.cast("string"))
    return c.numbered_lines(t.bind("b_diff_lines")).groupBy("patch_id", "version").agg(F.array_join(numbers, " ").alias("line_list"))


@query("w_08_current_file", oracle=r"""
select patch_id, seq, last_value(nullif(regexp_extract(line, '^\+\+\+ (?:b/)?([^\t]+)', 1), '') ignore nulls) over (partition by patch_id order by seq) as file
from b_diff_lines""")
def _(t):
    return c.with_current_file(t.bind("b_diff_lines")).select("patch_id", "seq", "file")


@query("src_08_diff_text", oracle=f"with {_NUMBERED} select version, line_no, count(*) as n from numbered group by all")
def _(t):
    path = scratch_path(t.spark, "patches")
    line_source.write_lines(t.bind("b_diff_lines"), path, "patch_id", "seq")
    read = line_source.read_lines(t.spark, path, log=line_source.folder_of())
    read = read.withColumnRenamed("line_no", "seq")
    return c.numbered_lines(read, keys=("log",)).groupBy("version", "line_no").agg(F.count("*").alias("n"))


# --- modules -------------------------------------------------------------------------

_MODULES = """
steps as (
  select sha, path, array_to_string(list_slice(p, 1, d), '/') as dir, d as depth
  from (select sha, path, string_split(path, '/') as p, unnest(range(1, len(string_split(path, '/')))) as d from b_commit_files) q
  union all select sha, path, '.' as dir, 0 as depth from b_commit_files
),
assigned as (
  select sha, path, arg_max(dir, depth) as module from steps join b_poms using (dir) group by all
)"""


def _modules(t):
    return c.nearest_modules(t.bind("b_commit_files").select("sha", "path").distinct(), t.bind("b_poms"))


@query("jn_07_nearest_module", oracle=f"with {_MODULES} select sha, path, module from assigned")
def _(t):
    return _modules(t)


@query("w_07_deepest_ancestor", oracle=f"with {_MODULES} select module, count(*) as n_files from assigned group by all")
def _(t):
    return _modules(t).groupBy("module").agg(F.count("*").alias("n_files"))


@query("ag_24_modules_and_files", oracle=f"""with {_MODULES}
select distinct sha, 'module' as kind, module as name from assigned union all select distinct sha, 'file', path from assigned""")
def _(t):
    return c.module_and_file_rows(_modules(t))


@query("ag_24_lists_within_the_file_limit", oracle=f"""with {_MODULES},
fitting as (select sha from b_commit_files group by sha having count(*) <= 20)
select sha, string_agg(distinct module, '|' order by module) as modules, string_agg(distinct path, '|' order by path) as files
from assigned semi join fitting using (sha) group by sha""")
def _(t):
    # one cell per commit: only for what FLT-04 lets through, as in the mining plan
    small = mining.files_of_small_commits(t.bind("b_commit_files")).select("sha", "path").distinct()
    lists = c.modules_and_files(c.nearest_modules(small, t.bind("b_poms")))
    return lists.select(
        "sha", F.array_join("modified_modules", "|").alias("modules"), F.array_join("changed_files", "|").alias("files")
    )


# --- coverage ------------------------------------------------------------------------

_LINES = """
line_rows as (
  select distinct commit_id, version, test_path, result, file, unnest(range(lo, hi + 1)) as line_no
  from (select *, cast(split_part(p, '-', 1) as bigint) as lo, cast(split_part(p, '-', -1) as bigint) as hi
        from (select *, trim(unnest(string_split(covered_lines, ','))) as p from b_coverage) a where p <> '') b
  where lo <= hi
),
hit as (select l.* from line_rows l semi join b_changed_lines c using (commit_id, version, file, line_no)),
covering as (select distinct commit_id, test_path from hit)"""


@query("sc_08_covered_lines", oracle="""
select commit_id, version, test_path, result, file, covered_lines,
  (select string_agg(distinct x, ' ' order by x) from (
     select unnest(range(cast(split_part(p, '-', 1) as bigint), cast(split_part(p, '-', -1) as bigint) + 1)) as x
     from (select trim(unnest(string_split(covered_lines, ','))) as p) a where p <> '') b) as line_list
from b_coverage""")
def _(t):
    numbers = F.transform(logtext.covered_lines(F.col("covered_lines")), lambda n: n.cast("string"))
    return t.bind("b_coverage").withColumn("line_list", F.array_join(numbers, " "))


@query("jn_08_changed_and_covered", oracle=f"with {_LINES} select commit_id, version, test_path, result, file, cast(line_no as int) as line_no from hit")
def _(t):
    return c.changed_and_covered(t.bind("b_changed_lines"), t.bind("b_coverage")).distinct()


@query("set_04_line_intersection", oracle=f"with {_LINES} select distinct commit_id, version, file, cast(line_no as int) as line_no from hit")
def _(t):
    return c.changed_and_covered(t.bind("b_changed_lines"), t.bind("b_coverage")).select(
        "commit_id", "version", "file", "line_no"
    ).distinct()


@query("ag_23_covering_tests", oracle=f"with {_LINES} select distinct commit_id, version, test_path from hit")
def _(t):
    hits = c.changed_and_covered(t.bind("b_changed_lines"), t.bind("b_coverage"))
    return hits.select("commit_id", "version", "test_path").distinct()


@query("set_03_tests_of_both_versions", oracle=f"with {_LINES} select commit_id, test_path from covering")
def _(t):
    return c.covering_tests(t.bind("b_changed_lines"), t.bind("b_coverage"))


@query("flt_24_failed_tests", oracle="select distinct commit_id, version, test_path from b_coverage where upper(result) <> 'PASSED'")
def _(t):
    return c.failed_tests(t.bind("b_coverage"))


_CHANGED_TESTS = """
changed_tests as (select distinct l_suppkey as commit_id, concat('src/test/java/T', cast(l_partkey % 20 as varchar), '.java') as path
                  from lineitem where l_returnflag = 'R' and l_quantity > 45)"""


@query("flt_25_without_modified_tests", oracle=f"""with {_LINES}, {_CHANGED_TESTS}
select commit_id, test_path from covering t
where not exists (select 1 from changed_tests m where m.commit_id = t.commit_id and m.path = concat(regexp_extract(t.test_path, '^(.*)/[^/]*$', 1), '.java'))""")
def _(t):
    changed = t.table("lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(
        F.col("l_suppkey").alias("commit_id"),
        F.concat(F.lit("src/test/java/T"), (F.col("l_partkey") % 20).cast("string"), F.lit(".java")).alias("path"),
    )
    return c.without_modified_tests(c.covering_tests(t.bind("b_changed_lines"), t.bind("b_coverage")), changed)


_BOTH = _LINES + """,
both_sides as (
  select t.commit_id, t.test_path, o.duration as original, p.duration as patched from covering t
  left join b_test_durations o on o.commit_id = t.commit_id and o.test_path = t.test_path and o.version = 'original'
  left join b_test_durations p on p.commit_id = t.commit_id and p.test_path = t.test_path and p.version = 'patched'
)"""


def _both(t):
    tests = c.covering_tests(t.bind("b_changed_lines"), t.bind("b_coverage"))
    return c.both_durations(tests, t.bind("b_test_durations"))


@query("jn_09_both_durations", oracle=f"with {_BOTH} select * from both_sides")
def _(t):
    return _both(t)


@query("ag_21_total_durations", oracle=f"with {_BOTH} select commit_id, sum(original) as original, sum(patched) as patched from both_sides group by commit_id")
def _(t):
    return c.total_durations(_both(t))




@query("src_04_coverage_reports", oracle="""
select distinct commit_id, version, module,
       concat(case when module = '.' then '' else concat(module, '/') end, 'src/test/java/T', cast(t as varchar), '/m') as test_path,
       'PASSED' as result, cast(q as double) as duration,
       concat(case when module = '.' then '' else concat(module, '/') end, 'src/main/java/', case when pk % 2 = 0 then '' else 'p/q/' end, 'C', cast(pk as varchar), '.java') as file,
       concat(cast(q as varchar), '-', cast(q + 3 as varchar)) as covered_lines
from (select l_suppkey as commit_id, case when l_linestatus = 'O' then 'original' else 'patched' end as version,
             case when l_suppkey % 3 = 0 then '.' else 'm1' end as module, l_orderkey % 20 as t, l_partkey as pk, cast(l_quantity as bigint) as q
      from lineitem) x""")
def _(t):
    line = t.table("lineitem")
    q = F.col("l_quantity").cast("bigint")
    files = F.array(
        F.struct(F.concat(F.lit("C"), F.col("l_partkey").cast("string"), F.lit(".java")).alias("fileName"),
                 F.concat(q.cast("string"), F.lit("-"), (q + 3).cast("string")).alias("coveredLines")),
    )
    path = F.when(F.col("l_partkey") % 2 == 0, F.lit("")).otherwise(F.lit("p/q"))
    test = F.struct(
        F.concat(F.lit("T"), (F.col("l_orderkey") % 20).cast("string"), F.lit("/m")).alias("uniformPath"),
        F.lit("passed").alias("result"), q.cast("double").alias("duration"),
        F.array(F.struct(path.alias("path"), files.alias("files"))).alias("paths"),
    )
    reports = line.select(
        F.col("l_suppkey").alias("commit_id"),
        F.when(F.col("l_linestatus") == "O", F.lit("original")).otherwise(F.lit("patched")).alias("version"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(".")).otherwise(F.lit("m1")).alias("module"),
        F.array(test).alias("tests"),
    )
    folder = scratch_path(t.spark, "coverage")
    coverage_source.write_reports(reports, folder)
    return c.coverage_rows(coverage_source.read_reports(t.spark, folder)).distinct()


# strict: a hunk has as many lines as its header says; its header line may leave out the length of one line
_STRICT = r"""
headed as (
  select *, regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', ['a', 'b', 'c', 'd']) as h, left(line, 1) as k from b_diff_lines
),
spans as (select *, sum(case when h.a <> '' then 1 else 0 end) over (partition by patch_id order by seq) as hunk from headed),
sizes as (
  select *, max(try_cast(h.a as bigint)) over g as old_start, max(try_cast(h.c as bigint)) over g as new_start,
         max(case when h.a <> '' then coalesce(try_cast(h.b as bigint), 1) end) over g as old_lines,
         max(case when h.a <> '' then coalesce(try_cast(h.d as bigint), 1) end) over g as new_lines,
         sum(case when k in ('-', ' ') then 1 else 0 end) over w as o, sum(case when k in ('+', ' ') then 1 else 0 end) over w as n
  from spans window g as (partition by patch_id, hunk), w as (partition by patch_id, hunk order by seq)
),
inner_lines as (
  select *, k in ('-', '+', ' ') and coalesce(o - (case when k in ('-', ' ') then 1 else 0 end) < old_lines or n - (case when k in ('+', ' ') then 1 else 0 end) < new_lines, false) as inside
  from sizes
),
files as (
  select *, last_value(case when not inside then nullif(regexp_extract(line, '^--- (?:a/)?([^\t]+)', 1), '') end ignore nulls) over w as old_file,
         last_value(case when not inside then nullif(regexp_extract(line, '^\+\+\+ (?:b/)?([^\t]+)', 1), '') end ignore nulls) over w as new_file
  from inner_lines window w as (partition by patch_id order by seq)
),
strict_lines as (
  select patch_id, seq, case k when '-' then 'original' else 'patched' end as version,
         case k when '-' then coalesce(nullif(old_file, '/dev/null'), nullif(new_file, '/dev/null')) else coalesce(nullif(new_file, '/dev/null'), nullif(old_file, '/dev/null')) end as file,
         cast(case k when '-' then old_start + o - 1 else new_start + n - 1 end as bigint) as line_no
  from files where inside and k in ('-', '+')
)"""


@query("sc_10_strict_lines", oracle=f"with {_STRICT} select patch_id, seq, version, file, line_no from strict_lines")
def _(t):
    return c.changed_lines_by_file(t.bind("b_diff_lines"))


@query("e4_durations_from_diffs", oracle=f"""with {_STRICT},
parts as (select commit_id, version, test_path, file, trim(unnest(string_split(covered_lines, ','))) as p from b_diff_coverage),
ranges as (select *, cast(split_part(p, '-', 1) as bigint) as low, cast(split_part(p, '-', -1) as bigint) as high from parts where p <> ''),
tests as (
  select distinct commit_id, test_path from ranges r
  join (select distinct patch_id, version, file, line_no from strict_lines) s
    on s.patch_id = r.commit_id and s.version = r.version and s.file = r.file and s.line_no between low and high
)
select t.commit_id, sum(o.duration) as original, sum(p.duration) as patched from tests t
left join b_test_durations o on o.commit_id = t.commit_id and o.test_path = t.test_path and o.version = 'original'
left join b_test_durations p on p.commit_id = t.commit_id and p.test_path = t.test_path and p.version = 'patched' group by t.commit_id""")
def _(t):
    """From diff text and coverage to the time of the tests that cover a change."""
    changed = c.changed_lines_by_file(t.bind("b_diff_lines")).withColumnRenamed("patch_id", "commit_id")
    tests = c.covering_tests(changed, t.bind("b_diff_coverage"))
    return c.total_durations(c.both_durations(tests, t.bind("b_test_durations")))


@query("sc_27_covered_paths", oracle="""
select distinct commit_id, concat('mod', cast(commit_id % 2 as varchar), '/src/main/java/', file, '.java') as path from b_coverage where commit_id % 2 = 1
union all select distinct commit_id, concat('src/main/java/', file, '.java') as path from b_coverage where commit_id % 2 = 0""")
def _(t):
    module = F.when(F.col("commit_id") % 2 == 0, F.lit(".")).otherwise(F.lit("mod1"))
    name = F.concat("file", F.lit(".java"))
    return t.bind("b_coverage").select(
        "commit_id", paths.covered_path(module, "src/main/java/", F.lit(""), name).alias("path")
    ).distinct()


