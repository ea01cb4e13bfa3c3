"""Column functions on paths and labels, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators import tools


def clean_path(path: Column) -> Column:
    """A path without empty and `.` parts, each `..` taking the part before it; an empty path is `.`."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        drop = (x == "..") & (F.size(acc) == 0) & rooted
        return F.when(up, F.slice(acc, 1, F.size(acc) - 1)).when(drop, acc).otherwise(F.concat(acc, F.array(x)))

    folded = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(folded, "/"))
    # Most paths are clean; the fold is for the others.
    plain = path.rlike(r"^/?[^/]") & ~path.rlike(r"//|(^|/)\.\.?(/|$)|/$")
    return F.when(plain, path).otherwise(F.when(joined == "", ".").otherwise(joined))


def external_root(path: Column, cwd: Column) -> Column:
    """What a path shares with the folder, and one part more."""
    a, b = F.split(path, "/"), F.split(cwd, "/")
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: (i <= F.size(b)) & (F.element_at(a, i) == F.element_at(b, F.least(i, F.size(b)))))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))
    return F.array_join(F.slice(a, 1, shared["n"] + 1), "/")


def project_name(folder: Column) -> Column:
    """The last part of a folder's name between dashes."""
    parts = F.filter(F.split(folder, "-"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(folder)


def path_suffix_match(path: Column, query: str) -> Column:
    return (path == query) | path.endswith("/" + query)


def is_system_path(path: Column) -> Column:
    """Whether a path lies in a folder of the system, on Unix or Windows."""
    unix = path.rlike("^/(usr|bin|sbin|etc|tmp|var|dev|proc|sys)/")
    return unix | F.lower(path).rlike(r"^c:\\(windows|program files|program files \(x86\)|programdata)\\")


def bash_paths(command: Column) -> Column:
    """The absolute paths among a command's words that are no system paths, quotes trimmed."""
    words = F.transform(F.split(command, r"\s+"), lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", ""))
    return F.filter(words, lambda w: w.startswith("/") & ~is_system_path(w))


def retry_signature(name: Column, path: Column, command: Column, pattern: Column) -> Column:
    """What a call tries: a file tool with its clean path, a command, a search with pattern and path, else the tool."""
    some = lambda c: c.isNotNull() & (c != "")
    file = name.isin(*tools.READS, *tools.WRITES) & some(path)
    return (
        F.when(file, F.concat(name, F.lit(":"), clean_path(path)))
        .when(name.isin(*tools.BASH) & some(command), F.concat(F.lit("Bash:"), F.trim(command)))
        .when(name.isin(*tools.SEARCHES) & some(pattern), F.concat(name, F.lit(":"), pattern, F.lit(":"), F.coalesce(path, F.lit(""))))
        .otherwise(name)
    )


def register(spark: SparkSession) -> None:
    """SQL functions that Catalyst inlines: grade, clean_path, decision_hint, retry_signature, project_name."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION grade(p DOUBLE) RETURNS STRING RETURN CASE WHEN p > 90 THEN 'A' WHEN p > 75 THEN 'B' WHEN p > 60 THEN 'C' WHEN p > 40 THEN 'D' ELSE 'F' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION retry_signature(tool STRING, path STRING, command STRING) RETURNS STRING RETURN CASE WHEN command IS NOT NULL THEN concat('Bash:', trim(command)) WHEN path IS NOT NULL THEN concat(tool, ':', path) ELSE tool END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION project_name(f STRING) RETURNS STRING RETURN element_at(filter(split(f, '-'), x -> x != ''), -1)")
