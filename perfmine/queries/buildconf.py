"""Queries over build configuration files."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfmine.operators import buildconf as b
from perfmine.queries.registry import query

_PARSED = r"""
pom as (
  select repo_id, content, content like '%</project>' as well_formed,
         regexp_extract(content, '<java\.version>(.*?)</java\.version>', 1) as declared,
         regexp_extract(content, '<v>(.*?)</v>', 1) as v,
         regexp_extract(content, '<target>(.*?)</target>', 1) as target
  from b_build_files where path = 'pom.xml'
),
from_pom as (
  select repo_id, case when not well_formed or declared = '' then null when declared = '1.8' then '8' else v end as declared,
         case when well_formed then nullif(target, '') end as plugin from pom
)"""


@query("sc_13_java_versions", oracle=f"""with {_PARSED}
select r.repo_id, case when j.repo_id is not null then '21' when p.declared is not null then p.declared when p.plugin is not null then p.plugin
                       when f.repo_id is not null then '17' when s.repo_id is not null then case when r.repo_id % 2 = 0 then '8' else '19' end else '24' end as java_version
from (select distinct c_custkey as repo_id from customer) r left join from_pom p on p.repo_id = r.repo_id left join b_build_files j on j.repo_id = r.repo_id and j.path = '.mvn/jvm.config'
left join b_build_files f on f.repo_id = r.repo_id and f.path = '.java-version'
left join b_build_files s on s.repo_id = r.repo_id and s.path = '.sdkmanrc'""")
def _(t):
    return b.java_versions(t.table("customer").select(F.col("c_custkey").alias("repo_id")), t.bind("b_build_files"))


def _poms(t):
    pom = t.bind("b_build_files").where("path = 'pom.xml'").withColumn("pom", b.pom_fields(F.col("content")))
    return pom.withColumn("props", b.properties_of(F.col("pom")))


@query("sc_14_pom_fields", oracle=r"""
select repo_id, case when content like '%</project>' then nullif(regexp_extract(content, '<java\.version>(.*?)</java\.version>', 1), '') end as declared,
       case when content like '%</project>' then nullif(regexp_extract(content, '<target>(.*?)</target>', 1), '') end as target
from b_build_files where path = 'pom.xml'""")
def _(t):
    plugin = F.get(F.col("pom")["build"]["plugins"]["plugin"], F.lit(0))
    return _poms(t).select(
        "repo_id", F.element_at("props", "java.version").alias("declared"), plugin["configuration"]["target"].alias("target")
    )


@query("sc_12_expanded_properties", oracle=r"""
select repo_id, replace(regexp_extract(content, '<java\.version>(.*?)</java\.version>', 1), chr(36) || '{v}', regexp_extract(content, '<v>(.*?)</v>', 1)) as expanded
from b_build_files where path = 'pom.xml' and content like '%<java.version>%'""")
def _(t):
    value = F.element_at("props", "java.version")
    return _poms(t).where(value.isNotNull()).select("repo_id", b.expand(value, F.col("props")).alias("expanded"))


@query("sc_11_major_versions", oracle=r"""
select repo_id, path, case when regexp_matches(content, '^1\.[0-9]') then regexp_extract(content, '^1\.([0-9]+)', 1) else nullif(regexp_extract(content, '[0-9]+'), '') end as major
from b_build_files where path <> 'pom.xml'""")
def _(t):
    files = t.bind("b_build_files").where("path <> 'pom.xml'")
    return files.select("repo_id", "path", b.major_version(F.col("content")).alias("major"))


@query("src_16_build_files", oracle="select path, count(*) as n, sum(length(content)) as chars from b_build_files group by path")
def _(t):
    return t.bind("b_build_files").groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
