"""The Java version a repository is built with, from its configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfmine.functions.text import stripped

# Files, keys and the default, in order of precedence.
JVM_CONFIG, POM, JAVA_VERSION, SDKMANRC = ".mvn/jvm.config", "pom.xml", ".java-version", ".sdkmanrc"
JVM_FLAGS = ("release", "target", "source")
POM_KEYS = ("maven.compiler.release", "maven.compiler.target", "maven.compiler.source", "java.version")
PLUGIN, PLUGIN_GROUP, PLUGIN_KEYS = "maven-compiler-plugin", "org.apache.maven.plugins", ("release", "target", "source")
DEFAULT_VERSION = "24"

POM_SCHEMA = (
    "struct<properties: map<string, string>, build: struct<plugins: struct<plugin: array<struct<artifactId: string, "
    "groupId: string, configuration: struct<release: string, target: string, source: string>>>>>>"
)
PLACEHOLDER = r"\$\{([^}]+)\}"


def major_version(text: Column) -> Column:
    """SC-11: ``1.8`` is 8, otherwise the first digits; null without any."""
    text = stripped(text)
    second = F.get(F.split(text, r"\."), F.lit(1))
    first = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))
    return F.when(text.startswith("1.") & second.rlike(r"^\d+$"), second).otherwise(first)


def expand(value: Column, properties: Column) -> Column:
    """SC-12: replace every ``${name}`` once; an unknown name stays."""
    names = F.regexp_extract_all(value, F.lit(PLACEHOLDER), F.lit(1))
    texts = F.split(value, PLACEHOLDER, -1)

    def piece(text: Column, i: Column) -> Column:
        name = F.get(names, i)
        known = F.coalesce(F.element_at(properties, name), F.concat(F.lit("${"), name, F.lit("}")))
        return F.concat(text, F.when(name.isNull(), F.lit("")).otherwise(known))

    return F.array_join(F.transform(texts, piece), "")


def pom_fields(content: Column) -> Column:
    """SC-14: properties and build plugins of a build file; null fields if it is malformed."""
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "rowTag": "project"}
    return F.from_xml(content, POM_SCHEMA, options)


def properties_of(pom: Column) -> Column:
    """Trimmed properties that have text."""
    trimmed = F.transform_values(pom["properties"], lambda _, v: stripped(v))
    kept = F.map_filter(trimmed, lambda _, v: v.isNotNull() & (v != ""))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def _first(values: list[Column]) -> Column:
    return F.coalesce(*values)


def version_of_properties(properties: Column) -> Column:
    return _first([major_version(expand(F.element_at(properties, key), properties)) for key in POM_KEYS])


def version_of_plugin(pom: Column, properties: Column) -> Column:
    """The first compiler plugin setting that gives a version."""
    plugins = F.filter(
        pom["build"]["plugins"]["plugin"],
        lambda p: (stripped(p["artifactId"]) == PLUGIN)
        & stripped(F.coalesce(p["groupId"], F.lit(PLUGIN_GROUP))).endswith("maven.plugins"),
    )
    found = F.transform(
        plugins,
        lambda p: _first([major_version(expand(stripped(p["configuration"][key]), properties)) for key in PLUGIN_KEYS]),
    )
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def version_of_jvm_config(content: Column) -> Column:
    return _first(
        [
            F.nullif(F.regexp_extract(content, "--" + flag + r"(?:\s+|=)(\d+)", 1), F.lit(""))
            for flag in JVM_FLAGS
        ]
    )


def version_of_java_version(content: Column) -> Column:
    return major_version(F.nullif(F.regexp_extract(content, r"^\s*(\S+)", 1), F.lit("")))


def version_of_sdkmanrc(content: Column) -> Column:
    return major_version(F.nullif(F.regexp_extract(content, r"(?m)^[^\S\n]*java=([^\n]*)", 1), F.lit("")))


def java_versions(repos: DataFrame, files: DataFrame, key: str = "repo_id") -> DataFrame:
    """SC-13: one version per repository of ``repos``, the default where no file names one.

    Every file is reduced to its few candidate versions before the shuffle; the
    texts themselves do not travel.
    """
    path, content = F.col("path"), F.col("content")
    known = files.where(path.isin(JVM_CONFIG, POM, JAVA_VERSION, SDKMANRC))
    parsed = known.withColumn("_pom", F.when(path == POM, pom_fields(content))).withColumn(
        "_props", properties_of(F.col("_pom"))
    )
    candidates = parsed.select(
        key,
        F.when(path == JVM_CONFIG, version_of_jvm_config(content)).alias("c0"),
        version_of_properties(F.col("_props")).alias("c1"),
        version_of_plugin(F.col("_pom"), F.col("_props")).alias("c2"),
        F.when(path == JAVA_VERSION, version_of_java_version(content)).alias("c3"),
        F.when(path == SDKMANRC, version_of_sdkmanrc(content)).alias("c4"),
    )
    best = candidates.groupBy(key).agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(5)])
    all_repos = repos.select(key).distinct().join(best, key, "left")
    return all_repos.select(key, F.coalesce(*[F.col(f"c{i}") for i in range(5)], F.lit(DEFAULT_VERSION)).alias("java_version"))
