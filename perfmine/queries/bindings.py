"""SQL that shapes the driver tables into this package's inputs.

Every block is valid in Spark SQL and in DuckDB, so a query and its oracle
start from the same rows. No block needs a window, an order over a whole table
or a row cap: line positions are keys of the data, and lines that fall on one
position are merged by an aggregate that combines before the shuffle.
"""

from __future__ import annotations

# owner/name of the repository of a customer
_REPO = ("concat(replace(r_name, ' ', '-'), '/', replace(n_name, ' ', '_'), '-', cast(c_custkey as string))")
_GEO = "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_VERSION = "case when l_linestatus = 'O' then 'original' else 'patched' end"

_COMMITS = f"""
select {_REPO} as repo, md5(cast(o_orderkey as string)) as sha, o_orderdate as committed_at,
       case when o_orderstatus = 'P' then null else o_orderdate end as authored_at,
       case o_orderpriority
         when '1-URGENT' then concat('Fixes #', cast(o_orderkey % 11 + 1 as string), ', GH-', cast(o_orderkey % 7 as string), ' and bug #', cast(o_orderkey % 5 + 1 as string))
         when '2-HIGH' then concat('Close: GH-', cast(o_orderkey % 11 + 1 as string), ' and #', cast(o_orderkey % 13 as string), '; prefix #3')
         when '3-MEDIUM' then concat('HAL-', cast(o_orderkey % 11 + 1 as string), ': tune path, see [abc-', cast(o_orderkey % 3 + 1 as string), '] and utf-8, too')
         when '5-LOW' then concat('Resolves https://github.com/', upper({_REPO}), '/issues/', cast(o_orderkey % 11 + 1 as string), ' or other/repo#', cast(o_orderkey % 4 + 1 as string))
         else concat('Merge other/repo#', cast(o_orderkey % 11 + 1 as string), ' hotfix #2') end as message
from orders join customer on o_custkey = c_custkey {_GEO}"""
_ISSUES = f"""
select {_REPO} as repo, o_orderkey % 9 + 1 as number, max(o_totalprice) > 400000 as is_pull_request,
       min(o_orderpriority) as title, case when min(o_orderstatus) = 'F' then null else concat('about ', min(o_orderstatus)) end as body
from orders join customer on o_custkey = c_custkey {_GEO}
group by 1, 2"""
#: The question about commit c and issue i.
PROMPT = """concat('Repository: ', c.repo, chr(10), 'Issue title: ', coalesce(i.title, ''), chr(10), 'Issue text: ', coalesce(i.body, ''),
  chr(10), 'Commit message: ', coalesce(c.message, ''), chr(10),
  'Does the commit fix an issue about execution time? Answer yes or no; if unsure, no.')"""

BINDINGS: dict[str, str] = {
    "b_repos": f"""
select c_custkey as repo_id, {_REPO} as full_name,
       cast(10 + floor(c_acctbal * c_acctbal / 1000) as bigint) as stars,
       case when c_mktsegment = 'BUILDING' then 'Kotlin' else 'Java' end as language,
       n_nationkey % 7 = 6 as archived, n_nationkey % 3 <> 2 as has_mvnw, p.pushed_at
from customer {_GEO}
join (select o_custkey, max(o_orderdate) as pushed_at from orders group by o_custkey) p on p.o_custkey = c_custkey""",
    "b_repo_files": f"""
select {_REPO} as repo, case when n_nationkey % 3 <> 2 then 'mvnw' else 'gradlew' end as path
from customer {_GEO}
union all
select {_REPO} as repo, 'sub/mvnw' as path from customer {_GEO}""",
    "b_commits": _COMMITS,
    "b_commit_files": """
select distinct md5(cast(l_orderkey as string)) as sha,
       case when l_linenumber = 2 then 'R100' when l_linenumber = 3 then 'D' when l_linenumber = 1 then 'A' else 'M' end as status,
       concat('mod', cast(l_suppkey % 7 as string), '/src/', case when l_returnflag = 'R' then 'test' else 'main' end,
              case when l_tax < 0.01 then '/generated' else '' end,
              '/java/p', cast(l_partkey % 50 as string), '/C', cast(l_partkey as string),
              case when l_linenumber = 7 then '.xml' else '.java' end) as path
from lineitem""",
    "b_issues": _ISSUES,
    "b_pulls": f"""
select {_REPO} as repo, md5(cast(o_orderkey as string)) as sha, o_orderkey * 2 as pr_number,
       md5(concat('b', cast(o_orderkey as string))) as base_sha, md5(cast(o_orderkey as string)) as head_sha,
       concat('Resolves #', cast(o_orderkey % 9 + 1 as string)) as title, 'body' as body
from orders join customer on o_custkey = c_custkey {_GEO}
where o_orderstatus <> 'F'
union all
select {_REPO} as repo, md5(cast(o_orderkey as string)) as sha, o_orderkey * 2 + 1 as pr_number,
       md5(concat('b', cast(o_orderkey as string))) as base_sha, md5(cast(o_orderkey as string)) as head_sha,
       'chore' as title, concat('closes #', cast(o_orderkey % 8 + 1 as string)) as body
from orders join customer on o_custkey = c_custkey {_GEO}
where o_orderstatus = 'P'""",
    # answers by question: they differ between commits that name one issue, and every fourth is missing
    "b_judgements": f"""
select md5({PROMPT}) as prompt_hash,
       min(case when (o_orderkey + i.number) % 3 = 0 then 'Yes' when (o_orderkey + i.number) % 3 = 1 then ' no' else 'no.' end) as response
from (select o_orderkey, c.repo, c.message from orders join ({_COMMITS}) c on c.sha = md5(cast(o_orderkey as string))) c
join ({_ISSUES}) i on i.repo = c.repo
where (o_orderkey + i.number) % 4 <> 0 and not i.is_pull_request group by 1""",
    "b_runs": f"""
select l_suppkey as commit_id, concat('org.x.T', cast(l_partkey % 2 as string)) as test_class,
       {_VERSION} as version, l_orderkey % 31 + 1 as run_no,
       cast(sum(cast(l_quantity as bigint)) as double) / 1000 as seconds
from lineitem group by 1, 2, 3, 4""",
    # one log per (commit, version, run); units rotate; a class can come twice
    "b_run_logs": f"""
select commit_id, version, run_no, line_no,
       concat(case when pk % 11 = 0 then '[WARNING]' else '[INFO]' end,
              ' Tests run: 3, Failures: 0, Errors: 0, Skipped: 0, Time elapsed: ', cast(q as string), case when pk % 4 = 0 and q > 1 then '000.5 ' else '.5 ' end,
              case when pk % 4 = 0 then 'ms' when pk % 4 = 1 then 's' when pk % 4 = 2 then 'min' else 'h' end,
              case when q % 2 = 0 then ' - in ' else ' -- in ' end,
              'org.x.T', cast(pk % 2 as string), case when q % 5 = 0 then '  ' else '' end) as line
from (select l_suppkey as commit_id, {_VERSION} as version, l_orderkey % 31 + 1 as run_no,
             l_orderkey * 8 + l_linenumber as line_no, min(l_partkey) as pk, cast(min(l_quantity) as bigint) as q
      from lineitem group by 1, 2, 3, 4) t
union all
select l_suppkey as commit_id, {_VERSION} as version, l_orderkey % 31 + 1 as run_no, max(l_orderkey) * 8 + 9 as line_no,
       case when l_suppkey % 7 = 3 and l_orderkey % 31 = 5 then '[INFO] BUILD FAILURE' else '[INFO] BUILD SUCCESS' end as line
from lineitem group by l_suppkey, {_VERSION}, l_orderkey % 31""",
    # logs of few commits, as files: commits 0 and 2 get faster, 4 slower, 3 has a failed log, 5 lacks one
    "b_log_files": f"""
select commit_id, version, run_no, line_no, line from (
select commit_id, version, run_no, line_no,
       concat('[INFO] Tests run: 3, Failures: 0, Errors: 0, Skipped: 0, Time elapsed: ',
              cast(q + case when commit_id in (0, 2) and version = 'original' or commit_id = 4 and version = 'patched' then 60 else 0 end as string),
              '.5 s -- in org.x.T', cast(pk % 5 as string)) as line
from (select l_suppkey % 7 as commit_id, {_VERSION} as version, l_orderkey % 31 + 1 as run_no,
             l_orderkey * 8 + l_linenumber as line_no, min(l_partkey) as pk, cast(min(l_quantity) as bigint) as q
      from lineitem group by 1, 2, 3, 4) t
union all
select l_suppkey % 7 as commit_id, {_VERSION} as version, l_orderkey % 31 + 1 as run_no, max(l_orderkey) * 8 + 9 as line_no,
       case when l_suppkey % 7 = 3 and l_orderkey % 31 = 5 and {_VERSION} = 'patched' then '[INFO] BUILD FAILURE' else '[INFO] BUILD SUCCESS' end as line
from lineitem group by l_suppkey % 7, {_VERSION}, l_orderkey % 31) a
where not (commit_id = 5 and version = 'patched' and run_no = 9)""",
    # build output with successes and all kinds of failure
    "b_build_logs": f"""
select commit_id, version, run_no, line_no,
       case when commit_id % 4 = 0 then '[INFO] BUILD SUCCESS'
            when pk = 0 then '[INFO] BUILD FAILURE'
            when pk = 1 then '[ERROR] COMPILATION ERROR : '
            when pk = 2 then '[ERROR]  Failed to execute goal org.apache.maven.plugins:maven-compiler-plugin:3.8:compile (default)'
            when pk = 3 then 'Failed to execute goal x'
            when pk = 4 then 'in maven-compiler-plugin y'
            when pk = 5 then 'of :z:testCompile done'
            when pk = 6 then 'note: Compilation failure here'
            when pk = 7 then '[error] fatal error compiling'
            when pk = 8 then 'BUILD ERROR'
            when pk = 9 then concat('[INFO] Total time:  ', cast(q as string), '.25 s')
            when pk = 10 then concat('[INFO] Total time:  0', cast(q % 10 as string), ':', cast(q as string), ' min')
            when pk = 11 then concat('[INFO] total time: 1:', cast(q as string), ':07 h')
            when pk = 12 then 'Total time: 9 fortnights'
            when pk in (13, 16) then concat('[ERROR]', chr(9), ' ')
            when pk in (14, 17) then '  COMPILATION ERROR : x'
            when pk = 15 then ' '
            else '[INFO] BUILD SUCCESS' end as line
from (select l_orderkey as commit_id, {_VERSION} as version, cast(l_linenumber % 2 + 1 as bigint) as run_no,
             cast(l_linenumber as bigint) as line_no, min(l_partkey % 20) as pk, cast(min(l_quantity) as bigint) as q
      from lineitem group by 1, 2, 3, 4) t""",
    "b_candidates": """
select o_orderkey as commit_id, o_orderpriority <> '5-LOW' as patch_applicable from orders""",
    "b_dataset": f"""
select {_REPO} as repo, md5(cast(o_orderkey as string)) as after_commit,
       case when c_mktsegment = 'MACHINERY' then null else o_orderkey % 11 + 1 end as issue_number,
       case o_orderstatus when 'F' then 'maven_execution_successful' when 'O' then 'docker_image_built' end as exec_status,
       cast(year(o_orderdate) + 18 as int) as commit_year,
       case when n_nationkey = 3 then null else cast(10 + floor(c_acctbal * c_acctbal / 1000) as bigint) end as repo_stars
from orders join customer on o_custkey = c_custkey {_GEO}""",
    "b_app_log": """
select user_id % 3 as file_no, event_id as line_no,
       concat(lpad(cast(hour(ts) as string), 2, '0'), ':', lpad(cast(minute(ts) as string), 2, '0'), ':',
              lpad(cast(second(ts) as string), 2, '0'), ',', cast(event_id % 1000 as string),
              ' root INFO r/r - ', cast(user_id * 64 + day(ts) as string), ' - ',
              case when event_type = 'purchase' then 'Analysis Result - {}' else 'Running analysis' end) as line
from events""",
    # older layout: INFO line, continuation lines, commit link line
    "b_found_log": """
select user_id % 3 as file_no, event_id as line_no,
       case event_type
         when 'signup' then concat('12:00:00,1 root INFO Commit - is fast, user ', cast(user_id as string))
         when 'purchase' then concat('Found performance commit: https://github.com/o', cast(user_id % 9 as string), '/r', cast(user_id % 5 as string), '/commit/', md5(cast(user_id as string)))
         when 'error' then concat('part - of, ', cast(user_id as string), ' -')
         else concat(chr(9), 'more text, ', cast(user_id as string), ' ', chr(9)) end as line
from events""",
    "b_coverage": f"""
select distinct l_suppkey as commit_id, {_VERSION} as version,
       concat('src/test/java/T', cast(l_orderkey % 20 as string), '/m') as test_path,
       case when l_tax > 0.079 and l_discount > 0.09 then 'FAILED' else 'PASSED' end as result,
       concat('C', cast(l_partkey as string)) as file,
       concat(cast(cast(l_quantity as bigint) as string), '-', cast(cast(l_quantity as bigint) + 3 as string), ', ,', cast(cast(l_quantity as bigint) + 7 as string),
              case when l_linenumber = 1 then ',9-5' else '' end) as covered_lines
from lineitem""",
    "b_test_durations": f"""
select l_suppkey as commit_id, {_VERSION} as version,
       concat('src/test/java/T', cast(l_orderkey % 20 as string), '/m') as test_path, sum(l_quantity) as duration
from lineitem group by 1, 2, 3""",
    "b_changed_lines": f"""
select distinct l_suppkey as commit_id, {_VERSION} as version, concat('C', cast(l_partkey as string)) as file,
       cast(l_quantity as bigint) + l_linenumber as line_no
from lineitem""",
    # one patch per supplier, one hunk per order; position = order and line number
    "b_diff_lines": """
select patch_id, seq,
       case when ln <= 2 then concat('@@ -', cast(pk % 100 + 1 as string), case when pk % 2 = 0 then ',9' else '' end, ' +', cast(pk % 90 + 1 as string), ',9 @@ void f()')
            when ln = 6 and f = 'A' then concat('+++ b/x', cast(pk % 7 as string))
            when ln = 6 then 'diff --git a/x b/x'
            when f = 'A' then '+added' when f = 'R' then '-removed' else ' context' end as line
from (select l_suppkey as patch_id, l_orderkey * 8 + l_linenumber as seq, min(l_linenumber) as ln,
             min(l_partkey) as pk, min(l_returnflag) as f
      from lineitem group by 1, 2) t""",
    # coverage of the files that the diffs name
    "b_diff_coverage": f"""
select distinct l_suppkey as commit_id, {_VERSION} as version, concat('src/test/java/T', cast(l_orderkey % 20 as string), '/m') as test_path,
       'PASSED' as result, concat('x', cast(l_partkey % 7 as string)) as file,
       concat(cast(l_partkey % 100 + 1 as string), '-', cast(l_partkey % 100 + l_linenumber as string),
              case when l_partkey % 997 = 0 then ',200-2000000000' else '' end) as covered_lines
from lineitem""",
    "b_poms": """
select distinct concat('mod', cast(s_suppkey % 5 as string)) as dir from supplier
union all select distinct concat('mod', cast(s_suppkey % 5 as string), '/src/main') as dir from supplier where s_acctbal < 0
union all select min(case when s_suppkey >= 0 then '.' end) as dir from supplier""",
    "b_judged_patches": """
select doc_id as id, case doc_id % 5 when 0 then 'Exact Match' when 1 then 'Semantic Equivalence' when 2 then 'Correct Location' when 3 then 'Off' else 'N/A' end as judgment,
       doc_id % 15 = 0 as pass_tests, n_chars % 4 + 1 as n_files, n_chars % 2 + 1 as n_modules,
       case when lang = 'de' then null else md5(cast(doc_id as string)) end as sha, doc_id * 2 as pr_number
from documents""",
    "b_detection": """
select doc_id as id, quality = 1 as detected, toxic = 0 as truth from labels""",
    "b_images": """
select concat(case when l_suppkey % 2 = 0 then 'ghcr.io/x/' else 'local/' end, cast(l_suppkey as string)) as repository,
       l_partkey as image_id, cast((l_partkey * 7919 % 2003) * 1048576 + 12345 as bigint) as size_bytes
from lineitem""",
    "b_pressure": """
select event_id as seq, ts, case when event_id % 2 = 0 then '/proc/pressure/cpu' else '/proc/pressure/memory' end as file,
       concat(case when event_type = 'error' then 'full' else 'some' end, ' avg10=', cast(event_id % 23 as string), '.50 avg60=', cast(event_id % 17 as string), '.25 avg300=', cast(event_id % 11 as string), '.00 total=', cast(event_id as string)) as line
from events""",
    "b_build_files": """
select c_custkey as repo_id, 'pom.xml' as path,
       case when c_nationkey % 4 = 0 then '<project><properties><java.version>1.8</java.version></properties></project>'
            when c_nationkey % 4 = 1 then concat('<project><properties><v>', cast(c_custkey % 9 + 9 as string), '</v><java.version>$', '{v}</java.version></properties></project>')
            when c_nationkey % 4 = 2 then '<project><build><plugins><plugin><artifactId>maven-compiler-plugin</artifactId><configuration><target>13</target></configuration></plugin></plugins></build></project>'
            else '<project><name>x</name>' end as content
from customer where c_custkey % 10 <> 7
union all
select c_custkey as repo_id, '.mvn/jvm.config' as path, '-Xmx1g --target 11 --release=21' as content from customer where c_mktsegment = 'BUILDING' and c_custkey % 20 <> 7
union all
select c_custkey as repo_id, '.java-version' as path, 'temurin-17.0.9' as content from customer where c_mktsegment = 'MACHINERY'
union all
select c_custkey as repo_id, '.sdkmanrc' as path, concat('# sdk', chr(10), 'java=', case when c_custkey % 2 = 0 then concat(chr(9), '1.8') else '19.0.1-tem' end) as content from customer where c_mktsegment = 'FURNITURE'""",
}

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def tables_of(sql: str) -> list[str]:
    """Driver tables a block reads."""
    words = set(sql.replace("\n", " ").replace("(", " ").replace(")", " ").split())
    return [t for t in TABLES if t in words]
