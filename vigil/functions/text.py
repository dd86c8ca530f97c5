"""Log text: levels, tokens, templates and service names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level words, what a line is stripped of before it is cut into tokens, and what its template has marks for.
ERROR = r"(?i)\b(error|critical|fatal|severe|emergency)\b"
WARN = r"(?i)\b(warn|warning)\b"
NOISE = r"(?i)(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{10,13}|\[?(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\]?|\x1B\[[0-9;]*m)"
HEXADECIMAL, NUMBER = r"(?i)\b[0-9a-f]{8,}\b", r"\b\d[\d.:,_-]*\b"


def level(level_: Column, body: Column) -> Column:
    """ERROR, WARN or INFO: by the start of the level field, or without one by a search of the body."""

    def of(text: Column, at_start: bool) -> Column:
        first = "^" if at_start else ""
        return F.when(F.rlike(text, F.lit(ERROR.replace("(?i)", f"(?i){first}"))), "ERROR").when(F.rlike(text, F.lit(WARN.replace("(?i)", f"(?i){first}"))), "WARN").otherwise("INFO")

    return F.when(F.coalesce(level_, F.lit("")) != "", of(level_, True)).otherwise(of(F.coalesce(body, F.lit("")), False))


def tokens(line: Column) -> Column:
    """Lower-case tokens of two or more characters, without times, levels and colour codes."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(line, NOISE, " ")), F.lit(r"\S{2,}"), F.lit(0))


def letters(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def template(line: Column) -> Column:
    """A line with marks for runs of hexadecimal digits and for numbers, white space collapsed, 200 characters at most."""
    marked = F.regexp_replace(F.regexp_replace(line, HEXADECIMAL, "<H>"), NUMBER, "<N>")
    return F.substring(F.trim(F.regexp_replace(marked, r"\s+", " ")), 1, 200)


def entropy(rows: DataFrame, keys: list[str], token: str) -> DataFrame:
    """Shannon entropy in bits of the tokens of each group. rows: one for each token."""
    counts = rows.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def service_label(labels: Column, pod: Column) -> Column:
    """The first label that names the service, or the pod without its replica suffix."""
    named = F.coalesce(*[F.nullif(labels[k], F.lit("")) for k in ("service", "app", "service_name")])
    bare = (
        F.when(F.rlike(pod, F.lit("-[a-f0-9]{8,12}-[a-z0-9]{5}$")), F.regexp_replace(pod, "-[a-f0-9]{8,12}-[a-z0-9]{5}$", ""))
        .when(F.rlike(pod, F.lit("-[0-9]+$")), F.regexp_replace(pod, "-[0-9]+$", ""))
        .when(F.rlike(pod, F.lit("-[a-z0-9]{5}$")), F.regexp_replace(pod, "-[a-z0-9]{5}$", ""))
        .otherwise(pod)
    )
    return F.coalesce(named, bare)


def duration(text: Column) -> Column:
    """Seconds of 30s, 2m, 1h or 500ms."""
    n = F.regexp_extract(text, r"^([0-9.]+)(ms|s|m|h)$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([0-9.]+)(ms|s|m|h)$", 2)
    return n * F.when(unit == "ms", 0.001).when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0)
