"""Queries over the commit dataset and its sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfmine.functions import cells, links
from perfmine.operators import dataset as d
from perfmine.operators import mining
from perfmine.queries.registry import query
from perfmine.session import scratch_path
from perfmine.sources import answers
from perfmine.sources import dataset as source

_LIST = T.ArrayType(T.StringType())

# a full dataset with nested cells; one cell in eleven has no list
_FULL = """
select repo, after_commit, issue_number, exec_status, cast(commit_year as double) / 7 as exec_time_improvement,
       case when exec_status is null then null else cast(0.25 as double) end as p_value, issue_number as pr_number,
       concat('say "', after_commit, '", ', repo) as note from b_dataset"""


def full_dataset(t):
    note = F.col("note")
    rows = t.bind("b_dataset").withColumn("note", F.concat(F.lit('say "'), F.col("after_commit"), F.lit('", '), F.col("repo")))
    return rows.select(
        "repo", "after_commit", "issue_number", "exec_status",
        (F.col("commit_year").cast("double") / 7).alias("exec_time_improvement"),
        F.when(F.col("exec_status").isNotNull(), F.lit(0.25)).alias("p_value"),
        F.create_map(F.lit("up"), F.array(note, F.lit("x\\y"))).alias("test_class_improvements"),
        F.lit(None).cast("string").alias("before_commit"),
        F.col("issue_number").alias("pr_number"),
        F.lit(None).cast("string").alias("is_improvement_per_manual_analysis"),
        F.when(F.col("exec_status").isNotNull(), F.array(note, F.lit("mod\nb"))).alias("modified_modules"),
        F.slice(F.array(F.lit("a"), F.lit("b,c")), 1, F.coalesce(F.col("issue_number") % 3, F.lit(0)).cast("int")).alias("changed_files"),
    )


@query("src_01_dataset_csv", oracle=f"""
select repo, after_commit, issue_number, exec_status, round(exec_time_improvement, 6) as exec_time_improvement, p_value,
       note || '|x\\y' as classes, pr_number,
       case when exec_status is not null then note || '|mod' || chr(10) || 'b' end as modules,
       case coalesce(issue_number % 3, 0) when 0 then '' when 1 then 'a' else 'a|b,c' end as files
from ({_FULL})""")
def _(t):
    path = scratch_path(t.spark, "dataset-csv")
    source.write_dataset_csv(full_dataset(t), path)
    return source.read_dataset_csv(t.spark, path).select(
        "repo", "after_commit", "issue_number", "exec_status",
        F.round("exec_time_improvement", 6).alias("exec_time_improvement"), "p_value",
        F.array_join(F.col("test_class_improvements")["up"], "|").alias("classes"), "pr_number",
        F.array_join("modified_modules", "|").alias("modules"), F.array_join("changed_files", "|").alias("files"),
    )


@query("snk_02_published_dataset", oracle="""
select repo, after_commit, issue_number, exec_status from b_dataset where exec_status = 'docker_image_built'""")
def _(t):
    path = scratch_path(t.spark, "dataset-store")
    source.save_dataset(full_dataset(t), path)
    source.save_dataset(d.with_status(source.load_dataset(t.spark, path), "docker_image_built"), path)
    return source.load_dataset(t.spark, path).select("repo", "after_commit", "issue_number", "exec_status")


@query("snk_06_empty_then_filled", oracle="select repo, after_commit, exec_status from b_dataset")
def _(t):
    rows = full_dataset(t)
    return d.upsert(source.empty_dataset(t.spark), rows).select("repo", "after_commit", "exec_status")


@query("src_02_tolerant_cells", oracle="""
select p_partkey, case when p_partkey % 16 in (5, 6, 11, 12, 13, 14) then null when p_partkey % 16 in (7, 9, 15) then concat('n', cast(p_size as varchar))
                  else concat('n', cast(p_size as varchar), '|b c') end as items
from part""")
def _(t):
    n = F.concat(F.lit("n"), F.col("p_size").cast("string"))
    kind = F.col("p_partkey") % 16

    def text(template: str):
        left, right = template.split("@")
        return F.concat(F.lit(left), n, F.lit(right))

    cell = (
        F.when(kind == 0, text('["@","b c"]'))
        .when(kind == 1, text('"[""@"",""b c""]"'))
        .when(kind == 2, text("['@', 'b c']"))
        .when(kind == 3, text('"[\\"@\\", \\"b c\\"]"'))
        .when(kind == 4, text('["@","b c"]"'))
        .when(kind == 5, text("not @ json"))
        .when(kind == 6, text('{"k": "@"}'))
        .when(kind == 7, text("['@', None]"))
        .when(kind == 9, text('[""@"", None]'))
        .when(kind == 10, text('[\\"@\\", \\"b c\\"]'))
        .when(kind == 11, text('["@"] junk'))
        .when(kind == 12, text('["@"]["b"]'))
        .when(kind == 13, text("[b'@']"))
        .when(kind == 14, text("['@', {1, 2}]"))
        .when(kind == 15, text("['@', None,]"))
        .otherwise(text("  '[\"@\", \"b c\"]' "))
    )
    # one file of a few row groups would be read, and its cells decoded, by as few tasks
    rows = t.table("part").select("p_partkey", cell.alias("cell")).hint("repartition")
    return rows.select("p_partkey", F.array_join(cells.decode_cell(F.col("cell"), _LIST), "|").alias("items"))


_UPDATES = """
updates as (
  select repo, after_commit, case when issue_number % 2 = 0 then issue_number + 100 end as issue_number,
         'maven_execution_successful' as exec_status, commit_year as seq from b_dataset where exec_status = 'docker_image_built'
  union all
  select concat(repo, '-new'), after_commit, issue_number, null, commit_year + 1 from b_dataset where repo_stars > 50000
)"""


def _updates(t):
    base = t.bind("b_dataset")
    changed = base.where("exec_status = 'docker_image_built'").select(
        "repo", "after_commit", F.when(F.col("issue_number") % 2 == 0, F.col("issue_number") + 100).alias("issue_number"),
        F.lit("maven_execution_successful").alias("exec_status"), F.col("commit_year").alias("seq"),
    )
    added = base.where("repo_stars > 50000").select(
        F.concat("repo", F.lit("-new")).alias("repo"), "after_commit", "issue_number",
        F.lit(None).cast("string").alias("exec_status"), (F.col("commit_year") + 1).alias("seq"),
    )
    return d.newest_values(changed.unionByName(added), "seq")


_COLUMNS = ("repo", "after_commit", "issue_number", "exec_status")


@query("snk_01_upsert", oracle=f"""with {_UPDATES}
select o.repo, o.after_commit, coalesce(u.issue_number, o.issue_number) as issue_number, coalesce(u.exec_status, o.exec_status) as exec_status
from b_dataset o left join updates u on o.repo = u.repo and o.after_commit = u.after_commit
union all
select repo, after_commit, issue_number, exec_status from updates u
where not exists (select 1 from b_dataset o where o.repo = u.repo and o.after_commit = u.after_commit)""")
def _(t):
    return d.upsert(t.bind("b_dataset").select(*_COLUMNS), _updates(t))


@query("jn_10_upsert_match", oracle=f"""with {_UPDATES}
select count(*) filter (o.repo is not null and u.repo is not null) as matched,
       count(*) filter (u.repo is null) as only_old, count(*) filter (o.repo is null) as only_new
from b_dataset o full join updates u on o.repo = u.repo and o.after_commit = u.after_commit""")
def _(t):
    old = t.bind("b_dataset").select("repo", "after_commit", F.lit(1).alias("o"), F.lit(None).cast("int").alias("n"))
    new = _updates(t).select("repo", "after_commit", F.lit(1).alias("n"))
    return d.upsert(old, new).agg(
        F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("matched"),
        F.count_if(F.col("n").isNull()).alias("only_old"),
        F.count_if(F.col("o").isNull()).alias("only_new"),
    )


@query("flt_17_status", oracle="select repo, after_commit from b_dataset where exec_status = 'maven_execution_successful'")
def _(t):
    return d.with_status(t.bind("b_dataset")).select("repo", "after_commit")


@query("src_15_inline_lookup", oracle="""
select repo, after_commit, case exec_status when 'docker_image_built' then 1 when 'maven_execution_successful' then 2 end as rank
from b_dataset where exec_status is not null""")
def _(t):
    return t.bind("b_dataset").join(d.status_ranks(t.spark), "exec_status").select("repo", "after_commit", "rank")


@query("sc_05_path_keys", oracle="""
select concat(replace(repo, '/', '__'), '_', sha) as path_key, repo, sha from b_commits""")
def _(t):
    keyed = t.bind("b_commits").select(links.path_key(F.col("repo"), F.col("sha")).alias("path_key"))
    return keyed.select("path_key", links.decode_path_key(F.col("path_key")).alias("_d")).select("path_key", "_d.*")


@query("sc_30_commit_keys", oracle="select concat(trim(repo), '@', trim(after_commit)) as commit_key from b_dataset")
def _(t):
    return t.bind("b_dataset").select(links.commit_key(F.concat(F.lit(" "), "repo"), F.col("after_commit")).alias("commit_key"))


@query("sc_31_numeric_cells", oracle="""
select p_partkey, case p_partkey % 5 when 0 then p_partkey when 1 then p_partkey when 2 then null when 3 then -p_partkey end as number from part""")
def _(t):
    kind, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    cell = (
        F.when(kind == 0, key).when(kind == 1, F.concat(key, F.lit(".0"))).when(kind == 2, F.concat(key, F.lit("x")))
        .when(kind == 3, F.concat(F.lit("-"), key)).otherwise(F.lit("98765432109876543210"))
    )
    return t.table("part").select("p_partkey", cells.whole_number(cell).alias("number"))


@query("sc_24_list_lengths", oracle="""
select repo, after_commit, case when exec_status is not null then 2 end as modules, coalesce(issue_number % 3, 0) as files from b_dataset""")
def _(t):
    return full_dataset(t).select(
        "repo", "after_commit", d.list_length("modified_modules").alias("modules"), d.list_length("changed_files").alias("files")
    )


@query("flt_23_empty_lists", oracle="select after_commit from b_dataset where coalesce(issue_number % 3, 0) = 0")
def _(t):
    return d.with_empty_list(full_dataset(t), "changed_files").select("after_commit")


# --- the cache of answers ----------------------------------------------------------


def _invocations(t):
    """Each order asks about its repository; customers repeat a question."""
    return t.table("orders").select(
        F.md5(F.concat(F.lit("q"), (F.col("o_custkey") * 8 + F.year("o_orderdate") % 8).cast("string")).cast("binary")).alias("prompt_hash"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("answer"),
    )


_INVOCATIONS = """
fresh as (select md5(concat('q', cast(o_custkey * 8 + year(o_orderdate) % 8 as varchar))) as prompt_hash, o_orderkey as seq, o_orderstatus as answer from orders),
cached as (select prompt_hash, 0 as version from fresh where answer = 'F' group by prompt_hash)"""


def _cached(t):
    return _invocations(t).where("answer = 'F'").select("prompt_hash", F.lit(0).cast("bigint").alias("version")).distinct()


@query("snk_05_cache_append", oracle=f"""with {_INVOCATIONS}
select prompt_hash, 0 as version, arg_min(answer, seq) as answer, min(seq) as seq
from fresh f where not exists (select 1 from cached c where c.prompt_hash = f.prompt_hash) group by prompt_hash""")
def _(t):
    return answers.new_entries(_cached(t), _invocations(t)).select("prompt_hash", "version", "answer", "seq")


@query("snk_05_cache_versions", oracle=f"""with {_INVOCATIONS}
select f.prompt_hash, seq, row_number() over (partition by f.prompt_hash order by seq) - 1 + (case when c.prompt_hash is null then 0 else 1 end) as version
from fresh f left join cached c on c.prompt_hash = f.prompt_hash""")
def _(t):
    return answers.new_entries(_cached(t), _invocations(t), read_from_cache=False).select("prompt_hash", "seq", "version")


@query("src_09_first_answers", oracle="""
select prompt_hash, arg_min(answer, seq) as response
from (select md5(concat('q', cast(o_custkey * 8 + year(o_orderdate) % 8 as varchar))) as prompt_hash, o_orderkey as seq, o_orderstatus as answer from orders)
group by prompt_hash""")
def _(t):
    entries = answers.new_entries(_cached(t).where("false"), _invocations(t), read_from_cache=False)
    path = scratch_path(t.spark, "answers")
    answers.append_entries(
        entries.select(
            "prompt_hash", "version",
            F.struct(F.array(F.struct(F.col("answer").alias("content")), F.struct(F.lit("second").alias("content"))).alias("samples")).alias("response"),
        ),
        path,
        digits=1,
    )
    return answers.first_answers(t.spark.read.parquet(path))


@query("st_05_first_element", oracle="""
select repo, sha, arg_min(path, path) as first_path from b_commits join b_commit_files using (sha) group by all""")
def _(t):
    joined = mining.with_files(t.bind("b_commits"), t.bind("b_commit_files")).where("path is not null")
    return joined.groupBy("repo", "sha").agg(F.min("path").alias("first_path"))
