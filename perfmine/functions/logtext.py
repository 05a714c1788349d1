"""Column expressions over build-log, application-log and coverage text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perfmine.functions.text import stripped

# The formats of the build tool's output.
TEST_LINE = r"\[INFO\] Tests run:.*?Time elapsed:\s+([\d.]+)\s+(ms|s|min|h)\s+-+\s+in\s+(.+)"
UNIT_SECONDS = {"ms": 0.001, "s": 1.0, "min": 60.0, "h": 3600.0}
SUCCESS_TEXT = "BUILD SUCCESS"
FAILURE_TEXTS = ("BUILD FAILURE", "BUILD ERROR")
COMPILE_ERROR_LINES = (
    r"(?im)^\[ERROR\]\s+Failed to execute goal .*maven-compiler-plugin.*:(compile|testCompile)\b",
    r"(?im)^\[ERROR\]\s+COMPILATION ERROR\s*:?",
    r"(?im)^\[ERROR\]\s+Compilation failure\b",
    r"(?im)^\[ERROR\]\s+Fatal error compiling\b",
    r"(?im)^\[ERROR\]\s+No compiler is provided in this environment\b",
)
GOAL_FAILED = r"(?is)Failed to execute goal .*maven-compiler-plugin.*:(compile|testCompile)\b"
COMPILATION_FAILURE = r"(?i)\bCompilation failure\b"
# The mark in front of an error message, and a line that is nothing but the mark.
ERROR_MARK = r"^\[ERROR\]\s+"
BARE_ERROR = r"(?i)^\[ERROR\]\s*$"
TOTAL_TIME = r"(?i)Total time:\s+([^\n\r]+)"


def test_class(line: Column) -> Column:
    return F.nullif(stripped(F.regexp_extract(line, TEST_LINE, 3)), F.lit(""))


def test_seconds(line: Column) -> Column:
    """Seconds of a test line. Milliseconds are divided, as exact doubles need."""
    value = F.regexp_extract(line, TEST_LINE, 1).try_cast("double")
    unit = F.regexp_extract(line, TEST_LINE, 2)
    return (
        F.when(unit == "ms", value / 1000)
        .when(unit == "s", value)
        .when(unit == "min", value * UNIT_SECONDS["min"])
        .when(unit == "h", value * UNIT_SECONDS["h"])
    )


def total_time_text(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, TOTAL_TIME, 1)), F.lit(""))


def total_time_seconds(value: Column) -> Column:
    """``1.2 s``, ``m:s min``, ``m min`` or ``h[:m[:s]] h`` in seconds; another form is null."""
    low = F.lower(value)
    parts = F.split(F.regexp_extract(value, r"([\d:.]+)", 1), ":")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    def part_or_zero(i: int) -> Column:
        return F.when(F.size(parts) > i, part(i)).otherwise(F.lit(0.0))

    seconds = F.regexp_extract(value, r"([\d.]+)", 1).try_cast("double")
    is_min = F.contains(low, F.lit("min"))
    return (
        F.when(F.contains(low, F.lit("s")) & ~is_min, seconds)
        .when(is_min, part(0) * 60 + part_or_zero(1))
        .when(F.contains(low, F.lit("h")), part(0) * 3600 + part_or_zero(1) * 60 + part_or_zero(2))
    )


def covered_lines(text: Column) -> Column:
    """``8,16,19-21`` as sorted distinct ints. Blank parts and reversed ranges give nothing."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")

    def bounds(part: Column) -> Column:
        start = F.trim(F.substring_index(part, "-", 1)).cast("int")
        end = F.trim(F.element_at(F.split(part, "-", 2), -1)).cast("int")
        none = F.array().cast("array<int>")
        return F.when(start <= end, F.sequence(start, end)).otherwise(none)

    return F.sort_array(F.array_distinct(F.flatten(F.transform(parts, bounds))))


def clock_seconds(clock: Column) -> Column:
    """Seconds of ``HH:MM:SS,f``; ``f`` is read as a decimal fraction, as written."""
    hms = F.split(F.substring_index(clock, ",", 1), ":")
    fraction = F.concat(F.lit("0."), F.element_at(F.split(clock, ","), -1)).try_cast("double")

    def part(i: int) -> Column:
        return F.get(hms, F.lit(i)).try_cast("double")

    return part(0) * 3600 + part(1) * 60 + part(2) + fraction


def clock_difference(start: Column, end: Column) -> Column:
    """Seconds from one clock time to the next, over midnight if need be."""
    delta = clock_seconds(end) - clock_seconds(start)
    return F.when(delta < 0, delta + 86400).otherwise(delta)


# The averages of a pressure line.
PRESSURE_FIELDS = ("avg10", "avg60", "avg300")


def pressure_values(line: Column) -> Column:
    """``map<string,double>`` of the averages the line holds."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"),
                F.regexp_extract(line, name + r"=([\d.]+)", 1).try_cast("double").alias("value"),
            )
            for name in PRESSURE_FIELDS
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def clean_message(text: Column) -> Column:
    """Commas to blanks, then drop all up to the first ``- ``; without one, drop all."""
    spaced = F.replace(text, F.lit(","), F.lit(" "))
    at = F.instr(spaced, "- ")
    return F.when(at > 0, F.substr(spaced, at + F.lit(2))).otherwise(F.lit(""))
