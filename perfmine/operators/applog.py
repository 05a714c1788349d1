"""Application logs: found commits with their running text, and analysis times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.functions import links, logtext, scan
from perfmine.functions.text import stripped
from perfmine.session import staged

# The marks of the log format.
INFO_MARK, INFO_SPLIT = "root INFO", "root INFO "
FOUND_MARK = "Found performance commit: "
RESULT_MARK = "Analysis Result"
MAX_SECONDS = 10_000.0
_SPAN = 1024


def found_commits(lines: DataFrame, keys=("file_no",), position: str = "line_no") -> DataFrame:
    """W-02: commit links of a log, each with the running text at that point.

    An INFO line starts a text, a plain line is appended to it, and a commit
    link emits it: commas become blanks and all up to the first ``- `` is cut
    off (the whole text, if there is none). The cut text goes on running.

    As data flow: of the text since the INFO line, the k-th link has cut off
    ``c(k) = min(c(k-1) + 1, M(k))`` of the ``M(k)`` separators begun so far, so
    ``c(k) = k + min(0, min over j<=k of (M(j) - j))``: sums and a minimum, which
    are chunked scans. Only the lines a link still shows are joined to it.
    """
    keys = list(keys)
    text = stripped(F.col("line"))
    is_info = F.contains(text, F.lit(INFO_MARK))
    is_link = ~is_info & F.contains(text, F.lit("https://")) & F.contains(text, F.lit("/commit/"))
    piece = F.when(is_info, F.coalesce(F.get(F.split(text, INFO_SPLIT), F.lit(1)), F.lit(""))).when(
        ~is_link, F.concat(F.lit(" "), text)
    )
    rows = lines.select(
        *keys,
        position,
        is_info.alias("_info"),
        is_link.alias("_link"),
        F.when(is_link, F.element_at(F.split(text, FOUND_MARK), -1)).alias("url"),
        F.replace(piece, F.lit(","), F.lit(" ")).alias("_piece"),
    )
    rows = scan.running(rows, keys, position, lasts={"_segment": F.when(F.col("_info"), F.col(position))})
    # staged before and after the scans by segment, which read their input several times
    rows = staged(rows.withColumn("_segment", F.coalesce("_segment", F.lit(-1))), "log-segments")
    segment = [*keys, "_segment"]
    # separators that begin in a piece; a closing dash is completed by the next piece's blank
    begun = F.coalesce(F.regexp_count("_piece", F.lit(r"-(?: |$)")), F.lit(0)).cast("bigint")
    one = F.when(F.col("_link"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rows = scan.running(
        rows.withColumn("_own", begun),
        segment,
        position,
        sums={"_m": F.col("_own"), "_k": one},
        lasts={"_dash": F.when(~F.col("_link"), F.col("_piece").endswith("-"))},
        keep_chunk=True,
    )
    rows = scan.running(
        rows, segment, position, mins={"_gap": F.when(F.col("_link"), F.col("_m") - F.col("_k"))}, exclusive=True
    )
    rows = staged(rows, "log-texts")
    zero = F.lit(0).cast("bigint")
    cut = F.col("_k") - 1 + F.least(zero, F.coalesce("_gap", zero))
    complete = F.col("_m") - F.when(F.coalesce("_dash", F.lit(False)), 1).otherwise(0)
    found = rows.where("_link").select(
        *segment, position, "url", (cut + 1).alias("_nth"), (complete >= cut + 1).alias("_shows")
    )
    pieces = rows.where(~F.col("_link")).select(
        *segment, F.col(position).alias("_at"), "_piece", (F.col("_m") - F.col("_own")).alias("_earlier"), "_own"
    )
    # where the separator lies after which the text of a link begins
    separators = pieces.where("_own > 0").select(
        *segment, F.col("_at").alias("_from"), "_earlier",
        F.explode(F.sequence(F.col("_earlier") + 1, F.col("_earlier") + F.col("_own"))).alias("_nth"),
    )
    starts = (
        found.where("_shows").join(separators, [*segment, "_nth"])
        .withColumn("_skip", F.col("_nth") - F.col("_earlier"))
        .withColumn("_span", F.explode(F.sequence(_span(F.col("_from")), _span(F.col(position)))))
        .drop("_earlier")
    )
    shown = starts.join(pieces.withColumn("_span", _span(F.col("_at"))).drop("_earlier", "_own"), [*segment, "_span"]).where(
        (F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col(position))
    )
    texts = shown.groupBy(*segment, position, "_skip").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda p: p["_piece"]), "").alias("_t")
    )
    parts = F.split("_t", "- ")
    messages = texts.select(
        *segment, position,
        F.array_join(F.slice(parts, F.col("_skip") + 1, F.size(parts)), "- ").alias("message"),
    )
    link = links.commit_link(F.col("url"))
    return found.join(messages, [*segment, position], "left").select(
        *keys, position, link["owner"].alias("owner"), link["repo"].alias("repo"), link["sha"].alias("commit_hash"),
        "url", F.coalesce("message", F.lit("")).alias("message"),
    )


def _span(position):
    return F.floor(position / F.lit(_SPAN))


FOUND_COLUMNS = ["owner", "repo", "commit_hash", "url", "message"]


def distinct_found(*logs: DataFrame) -> DataFrame:
    """SET-01: the distinct found rows of several logs."""
    rows = logs[0].select(FOUND_COLUMNS)
    for log in logs[1:]:
        rows = rows.union(log.select(FOUND_COLUMNS))
    return rows.distinct()


def found_counts(found: DataFrame) -> DataFrame:
    """AG-20: distinct repositories and owners."""
    names = found.select("owner", F.concat_ws("/", "owner", "repo").alias("full")).distinct()
    return names.agg(F.countDistinct("full").alias("repos"), F.countDistinct("owner").alias("owners"))


def commit_times(lines: DataFrame) -> DataFrame:
    """AG-19: first time and first result time per commit, over the files in order."""
    words = F.split(stripped(F.col("line")), " ")
    at = F.struct("file_no", "line_no")
    rows = lines.select(
        "file_no", "line_no", F.get(words, F.lit(5)).alias("commit"), F.get(words, F.lit(0)).alias("time"),
        F.contains("line", F.lit(RESULT_MARK)).alias("is_result"),
    ).where(F.col("commit").isNotNull())
    return rows.groupBy("commit").agg(
        F.min_by("time", at).alias("start"), F.min_by("time", F.when(F.col("is_result"), at)).alias("end")
    )


def durations(times: DataFrame, limit: float = MAX_SECONDS) -> DataFrame:
    """SC-17 / FLT-20: seconds from start to result; longer than ``limit`` is dropped."""
    seconds = logtext.clock_difference(F.col("start"), F.col("end"))
    return times.where(F.col("end").isNotNull()).withColumn("seconds", seconds).where(F.col("seconds") <= limit)
