"""Queries of the reports: counts, buckets, summaries, logs and pressure."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfmine.functions import links, logtext
from perfmine.operators import applog, pressure
from perfmine.operators import reports as r
from perfmine.queries.registry import query
from perfmine.session import scratch_path, staged
from perfmine.sources import labels, results
from perfmine.sources import lines as line_source

_OK = "coalesce(exec_status = 'maven_execution_successful', false)"
_SUMMARY = f"""
summary as (select repo, count(*) as total_items, count(*) filter ({_OK}) as successful
            from (select case when repo_stars is null then null else repo end as repo, exec_status from b_dataset) d group by repo)"""


def _dataset(t):
    """The dataset with one group of rows without a repository."""
    return t.bind("b_dataset").withColumn("repo", F.when(F.col("repo_stars").isNotNull(), F.col("repo")))


@query("ag_08_repo_summary", oracle=f"with {_SUMMARY} select * from summary")
def _(t):
    return r.repo_summary(_dataset(t))


@query("flt_19_major_repos", oracle=f"""with {_SUMMARY}
select repo, total_items, successful, case when repo is null then 'Unknown' else split_part(repo, '/', 2) end as label from summary where total_items >= 10""")
def _(t):
    return r.major_repos(r.repo_summary(_dataset(t)))


@query("st_01_repos_by_total", oracle=f"with {_SUMMARY} select repo, total_items from summary where total_items >= 10 order by total_items desc, repo")
def _(t):
    return r.major_repos(r.repo_summary(_dataset(t))).select("repo", "total_items")


@query("ag_26_grand_totals", oracle=f"""with {_SUMMARY}
select cast(coalesce(sum(total_items), 0) as bigint) as total_items, cast(coalesce(sum(successful), 0) as bigint) as successful from summary where total_items >= 10""")
def _(t):
    return r.grand_totals(r.major_repos(r.repo_summary(_dataset(t))))


@query("sc_04_short_labels", oracle="""
select distinct repo, case when repo is null then 'Unknown' when lower(repo) = 'others' then 'Others' when contains(repo, '/') then substr(repo, instr(repo, '/') + 1) else repo end as label
from (select case when repo_stars is null then null when repo_stars > 90000 then 'OTHERS' when repo_stars > 80000 then 'plain' else concat(repo, '/x') end as repo from b_dataset)""")
def _(t):
    stars = F.col("repo_stars")
    repo = F.when(stars > 90000, F.lit("OTHERS")).when(stars > 80000, F.lit("plain")).when(stars.isNotNull(), F.concat("repo", F.lit("/x")))
    rows = t.bind("b_dataset").select(repo.alias("repo")).distinct()
    return rows.withColumn("label", links.short_label(F.col("repo")))


@query("ag_09_distinct_repos", oracle=f"""
select count(distinct repo) as repos, count(distinct case when {_OK} then repo end) as successful_repos
from (select case when repo_stars is null then null else repo end as repo, exec_status from b_dataset)""")
def _(t):
    return r.repo_counts(_dataset(t))


_YEARS = f"""
select y.commit_year, count(*) filter (d.commit_year is not null and not {_OK}) as not_successful, count(*) filter (d.commit_year is not null and {_OK}) as successful
from (select unnest(range(2012, 2026)) as commit_year) y left join b_dataset d on d.commit_year = y.commit_year group by y.commit_year"""


@query("ag_11_dense_years", oracle=f"select cast(commit_year as int) as commit_year, not_successful, successful from ({_YEARS})")
def _(t):
    return r.by_year(t.bind("b_dataset"), (2012, 2025))


@query("ag_10_counts_by_success", oracle=f"""
select commit_year, count(*) filter (not {_OK}) as not_successful, count(*) filter ({_OK}) as successful from b_dataset
where commit_year between 2015 and 2017 group by commit_year""")
def _(t):
    return r.by_year(t.bind("b_dataset"), (2015, 2017))


_BUCKET = """case when repo_stars between 20 and 49 then '20-49' when repo_stars between 50 and 99 then '50-99' when repo_stars between 100 and 249 then '100-249'
  when repo_stars between 250 and 499 then '250-499' when repo_stars between 500 and 999 then '500-999' when repo_stars between 1000 and 4999 then '1k-4.9k'
  when repo_stars between 5000 and 19999 then '5k-19.9k' when repo_stars between 20000 and 99999 then '20k-99.9k' end"""


@query("ag_11_dense_star_buckets", oracle=f"""
select s.star_bucket, count(*) filter (b is not null and not {_OK}) as not_successful, count(*) filter (b is not null and {_OK}) as successful
from (select unnest(['20-49', '50-99', '100-249', '250-499', '500-999', '1k-4.9k', '5k-19.9k', '20k-99.9k']) as star_bucket) s
left join (select {_BUCKET} as b, exec_status from b_dataset) d on d.b = s.star_bucket group by s.star_bucket""")
def _(t):
    return r.by_stars(t.bind("b_dataset"))


@query("sc_25_star_buckets", oracle=f"select repo_stars, {_BUCKET} as star_bucket, count(*) as n from b_dataset group by all")
def _(t):
    rows = t.bind("b_dataset").withColumn("star_bucket", r.star_bucket(F.col("repo_stars")))
    return rows.groupBy("repo_stars", "star_bucket").agg(F.count("*").alias("n"))


@query("flt_18_year_and_stars", oracle="""
select after_commit from b_dataset where commit_year between 2015 and 2018 and repo_stars is not null and repo_stars between 20 and 99999""")
def _(t):
    return r.in_star_range(t.bind("b_dataset").where(F.col("commit_year").between(2015, 2018))).select("after_commit")


@query("jn_11_years_and_stars", oracle="""
select case when d.after_commit like '0%' then concat(d.repo, chr(9)) else d.repo end as repo, d.after_commit, y.commit_year, s.stars as repo_stars from b_dataset d
left join (select repo, after_commit, commit_year from b_dataset where exec_status is not null) y on y.repo = d.repo and y.after_commit = d.after_commit
left join (select full_name, stars from b_repos where not archived) s on s.full_name = d.repo""")
def _(t):
    data = t.bind("b_dataset")
    years = data.where("exec_status is not null").select(links.commit_key(F.col("repo"), F.col("after_commit")).alias("commit_key"), "commit_year")
    stars = t.bind("b_repos").where("not archived").select(F.col("full_name").alias("repo"), "stars")
    # some names end in a tab
    repo = F.when(F.col("after_commit").startswith("0"), F.concat("repo", F.lit("\t"))).otherwise(F.col("repo"))
    return r.with_years_and_stars(data.select(repo.alias("repo"), "after_commit"), years, stars)


@query("src_17_year_star_cache", oracle="""
select concat(repo, '@', after_commit) as commit_key, commit_year, stars from b_dataset join (select full_name, stars from b_repos) on full_name = repo""")
def _(t):
    stars = t.bind("b_repos").select(F.col("full_name").alias("repo"), "stars")
    key = links.commit_key(F.col("repo"), F.col("after_commit"))
    rows = t.bind("b_dataset").join(stars, "repo").select(
        F.create_map(key, "commit_year").alias("commit_year_by_repo_sha"), F.create_map("repo", "stars").alias("repo_stars")
    )
    path = scratch_path(t.spark, "cache")
    rows.write.json(path)
    years, stars = labels.read_year_star_cache(t.spark, path, multi_line=False)
    repo = F.regexp_extract("commit_key", "^(.*)@", 1)
    return years.withColumn("repo", repo).join(stars.distinct(), "repo").select("commit_key", "commit_year", "stars")


@query("ag_13_length_stats", oracle=f"""
with sizes as (select f.sha, count(*) as files, count(distinct split_part(path, '/', 1)) as modules from b_commit_files f group by f.sha),
rows_ as (select d.exec_status, s.* from b_dataset d left join sizes s on s.sha = d.after_commit),
long as (select exec_status, 'changed_files' as list, files as length from rows_ union all select exec_status, 'modified_modules', modules from rows_),
pop as (select 'all' as population, * from long union all select 'successful', * from long where {_OK})
select population, list, min(length) as min, max(length) as max, quantile_cont(cast(length as double), 0.5) as median from pop where length is not null group by all""")
def _(t):
    sizes = t.bind("b_commit_files").groupBy(F.col("sha").alias("after_commit")).agg(
        F.count("*").alias("files"), F.countDistinct(F.split("path", "/")[0]).alias("modules")
    )
    data = t.bind("b_dataset").join(sizes, "after_commit", "left")
    return r.length_stats(data, {"changed_files": F.col("files"), "modified_modules": F.col("modules")})


# --- images --------------------------------------------------------------------------


@query("flt_26_registry_images", oracle="select distinct repository, image_id from b_images where repository like 'ghcr%'")
def _(t):
    return t.bind("b_images").where(F.col("repository").startswith("ghcr")).select("repository", "image_id").distinct()


@query("set_05_images_once", oracle="select image_id, min(size_bytes) as size_bytes from b_images where repository like 'ghcr%' group by image_id")
def _(t):
    return r.registry_images(t.bind("b_images"))


@query("sc_18_mebibytes", oracle="select image_id, round(min(size_bytes) / 1048576.0::double, 6) as mib from b_images where repository like 'ghcr%' group by image_id")
def _(t):
    return r.with_mib(r.registry_images(t.bind("b_images"))).select("image_id", F.round("mib", 6).alias("mib"))


def _five(source: str, value: str) -> str:
    q = f"quantile_cont(cast({value} as double), "
    return (
        f"select count(*) as n, round(min({value}), 6) as min, round({q}0.25), 6) as q1, round({q}0.5), 6) as median, "
        f"round({q}0.75), 6) as q3, round(max({value}), 6) as max from {source}"
    )


def _rounded(summary):
    return summary.select("n", *[F.round(c, 6).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query("ag_12_image_summary", oracle=_five(
    "(select min(size_bytes) / 1048576.0::double as mib from b_images where repository like 'ghcr%' group by image_id)", "mib"))
def _(t):
    return _rounded(r.five_numbers(r.with_mib(r.registry_images(t.bind("b_images"))), "mib"))


@query("src_14_image_lines", oracle="select repository, image_id, count(*) as n from b_images group by all")
def _(t):
    lines = t.bind("b_images").select(F.concat_ws("\t", "repository", F.col("image_id").cast("string")).alias("line"))
    parsed = labels.parse_image_lines(lines.unionAll(lines.select(F.lit("no tab").alias("line"))))
    return parsed.groupBy("repository", "image_id").agg(F.count("*").alias("n"))


# --- application logs ----------------------------------------------------------------

_TIMES = """
words as (select file_no, line_no, string_split(trim(line), ' ') as w, contains(line, 'Analysis Result') as is_result from b_app_log),
times as (
  select w[6] as commit, arg_min(w[1], (file_no, line_no)) as start, arg_min(w[1], (file_no, line_no)) filter (is_result) as "end" from words group by w[6]
),
seconds as (
  select *, case when e < s then e - s + 86400 else e - s end as seconds from (
    select *, cast(start[1:2] as double) * 3600 + cast(start[4:5] as double) * 60 + cast(start[7:8] as double) + cast('0.' || start[10:] as double) as s,
              cast("end"[1:2] as double) * 3600 + cast("end"[4:5] as double) * 60 + cast("end"[7:8] as double) + cast('0.' || "end"[10:] as double) as e
    from times where "end" is not null) q
)"""


@query("ag_19_commit_times", oracle=f'with {_TIMES} select commit, start, "end" from times')
def _(t):
    return applog.commit_times(t.bind("b_app_log"))


@query("sc_17_clock_differences", oracle=f"with {_TIMES} select commit, round(seconds, 4) as seconds from seconds")
def _(t):
    times = applog.durations(applog.commit_times(t.bind("b_app_log")), limit=1e9)
    return times.select("commit", F.round("seconds", 4).alias("seconds"))


@query("flt_20_short_durations", oracle=f"with {_TIMES} select commit, round(seconds, 4) as seconds from seconds where seconds <= 10000")
def _(t):
    return applog.durations(applog.commit_times(t.bind("b_app_log"))).select("commit", F.round("seconds", 4).alias("seconds"))


@query("ag_12_duration_summary", oracle=f"with {_TIMES}, kept as (select round(seconds, 4) as seconds from seconds where seconds <= 10000) " + _five("kept", "seconds"))
def _(t):
    rows = applog.durations(applog.commit_times(t.bind("b_app_log"))).withColumn("seconds", F.round("seconds", 4))
    return _rounded(r.five_numbers(rows, "seconds"))


@query("src_05_log_lines", oracle="""
select cast(file_no as varchar) as log, row_number() over (partition by file_no order by line_no) as line_no, line from b_app_log""")
def _(t):
    path = scratch_path(t.spark, "app-log")
    line_source.write_lines(t.bind("b_app_log"), path, "file_no", "line_no")
    return line_source.read_lines(t.spark, path, log=line_source.folder_of())


# the log read line by line, as a state machine: the running text of each file
_FOUND = r"""
recursive ordered as (
  select file_no, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') as l, row_number() over (partition by file_no order by line_no) as rn,
         contains(line, 'root INFO') as is_info, not contains(line, 'root INFO') and contains(line, 'https://') and contains(line, '/commit/') as is_link
  from b_found_log
),
run as (
  select file_no, cast(0 as bigint) as rn, cast(null as bigint) as line_no, '' as msg, false as is_link, '' as l from (select distinct file_no from ordered)
  union all
  select o.file_no, o.rn, o.line_no,
         case when o.is_info then split_part(o.l, 'root INFO ', 2)
              when o.is_link then case when contains(replace(r.msg, ',', ' '), '- ') then substr(replace(r.msg, ',', ' '), instr(replace(r.msg, ',', ' '), '- ') + 2) else '' end
              else r.msg || ' ' || o.l end,
         o.is_link, o.l
  from run r join ordered o on o.file_no = r.file_no and o.rn = r.rn + 1
),
found as (
  select file_no, line_no, split_part(url, '/', 4) as owner, split_part(url, '/', 5) as repo, split_part(url, '/', 7) as commit_hash, url, message
  from (select *, split_part(l, 'Found performance commit: ', -1) as url, msg as message from run where is_link) q
)"""


@query("w_02_running_text", oracle=f"with {_FOUND} select * from found")
def _(t):
    return applog.found_commits(t.bind("b_found_log"))


@query("sc_28_clean_messages", oracle="""
select line_no, case when contains(replace(line, ',', ' '), '- ') then substr(replace(line, ',', ' '), instr(replace(line, ',', ' '), '- ') + 2) else '' end as message from b_found_log""")
def _(t):
    return t.bind("b_found_log").select("line_no", logtext.clean_message(F.col("line")).alias("message"))


@query("set_01_found_union", oracle=f"with {_FOUND} select distinct owner, repo, commit_hash, url, message from found")
def _(t):
    found = staged(applog.found_commits(t.bind("b_found_log")), "found")
    first = F.col("file_no") == 0
    return applog.distinct_found(found.where(first), found.where(~first))


@query("snk_04_found_csv", oracle=f"with {_FOUND} select distinct owner, repo, commit_hash, url, message from found")
def _(t):
    path = scratch_path(t.spark, "found")
    results.write_found_commits(applog.found_commits(t.bind("b_found_log")).select(applog.FOUND_COLUMNS), path)
    return results.read_found_commits(t.spark, path)


@query("ag_20_found_counts", oracle=f"with {_FOUND} select count(distinct owner || '/' || repo) as repos, count(distinct owner) as owners from found")
def _(t):
    return applog.found_counts(applog.found_commits(t.bind("b_found_log")))


# --- pressure ------------------------------------------------------------------------

_PRESSURE = r"""
parsed as (
  select seq, file, cast(regexp_extract(line, 'avg10=([\d.]+)', 1) as double) as avg10, cast(regexp_extract(line, 'avg60=([\d.]+)', 1) as double) as avg60,
         cast(regexp_extract(line, 'avg300=([\d.]+)', 1) as double) as avg300 from b_pressure where line like 'some%'
)"""


@query("sc_16_pressure_values", oracle=f"with {_PRESSURE} select seq, avg10, avg60, avg300 from parsed")
def _(t):
    values = F.col("pressure")
    return pressure.samples(t.bind("b_pressure")).select("seq", *[values[k].alias(k) for k in logtext.PRESSURE_FIELDS])


@query("src_18_pressure_lines", oracle=f"with {_PRESSURE} select file, count(*) as n, round(sum(avg10), 2) as avg10 from parsed group by file")
def _(t):
    path = scratch_path(t.spark, "pressure")
    t.bind("b_pressure").select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    lines = t.spark.read.schema("value string, file string").text(path).withColumnRenamed("value", "line")
    return pressure.samples(lines).groupBy("file").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("pressure")["avg10"]), 2).alias("avg10")
    )


@query("flt_22_pressure_exceeded", oracle=f"""with {_PRESSURE}
select seq, file, metric, value from (
  select seq, file, 'avg10' as metric, avg10 as value from parsed union all select seq, file, 'avg60', avg60 from parsed
  union all select seq, file, 'avg300', avg300 from parsed) where value > 10.0""")
def _(t):
    return pressure.exceeded(pressure.samples(t.bind("b_pressure")))


@query("ag_30_largest_pressure", oracle=f"with {_PRESSURE} select seq, greatest(avg10, avg60, avg300) as largest from parsed")
def _(t):
    return pressure.with_largest(pressure.samples(t.bind("b_pressure"))).select("seq", "largest")


@query("w_06_every_twelfth", oracle=f"with {_PRESSURE} select seq, greatest(avg10, avg60, avg300) as largest from parsed where seq % 12 = 0")
def _(t):
    return pressure.with_largest(pressure.every_nth(pressure.samples(t.bind("b_pressure")))).select("seq", "largest")
