"""Point lookups without a scan: files by time, bloom filters of ids and fingerprints in every row group.

A table is written in the order of time, so that questions for a span read the row groups of the span by their least
and greatest times, and with bloom filters of the columns that are looked up by value, so that a lookup reads the row groups
that may hold it.  ``scan`` tells how many rows a query's scans gave, from the executed plan's metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import POINTS

#: Rows of a row group: few enough that a lookup reads little, many enough to pack well.
GROUP_ROWS = 20_000


def options(distinct: int = GROUP_ROWS, rows: int = GROUP_ROWS, points: tuple[str, ...] = POINTS) -> dict[str, str]:
    """Writer options: a bloom filter for each of ``points``, sized for a row group's values, and row groups of ``rows`` rows."""
    out = {"parquet.block.row.count.limit": str(rows), "parquet.page.row.count.limit": str(min(rows, 20_000))}
    for c in points:
        out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(distinct), f"parquet.bloom.filter.fpp#{c}": "0.001"}
    return out


def write(posts: DataFrame, path: str, rows: int = GROUP_ROWS, by: str = "created_at", mode: str = "errorifexists", bloom: bool = True) -> None:
    """Posts by ranges of time, with their ``day``, in row groups with bloom filters.

    Parquet's statistics of dates narrow a scan in every session; those of times without a zone don't.
    """
    dealt = posts.withColumn("day", F.to_date(by)).repartitionByRange(F.col(by)).sortWithinPartitions(by)
    points = tuple(c for c in POINTS if c in posts.columns) if bloom else ()
    dealt.write.mode(mode).options(**options(rows, rows, points)).parquet(path)


def one(posts: DataFrame, post_id: str) -> DataFrame:
    return posts.where(F.col("post_id") == post_id)


def within(posts: DataFrame, start: str, end: str) -> DataFrame:
    """Posts from the time ``start`` to before ``end``; by their day as well, where they have one, so that other row groups aren't read."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = posts.where((F.col("created_at") >= first) & (F.col("created_at") < last))
    return rows.where(F.col("day").between(F.to_date(first), F.to_date(last))) if "day" in posts.columns else rows


def same_text(posts: DataFrame, text_hash: str) -> DataFrame:
    return posts.where(F.col("text_hash") == text_hash)


@dataclass(frozen=True)
class Scan:
    """What the file scans of an executed query gave: rows they handed on, and those in the tables."""

    rows: int
    rows_there: int

    @property
    def skipped(self) -> float:
        """The share of rows in row groups (or pages of them) that weren't read."""
        return 1 - self.rows / max(self.rows_there, 1)


def _scans(plan) -> list:
    """The Parquet scans of an executed plan; adaptive plans and their stages hide what has run."""
    name, out = plan.nodeName(), []
    if name.startswith("Scan parquet"):
        return [plan]
    if name == "AdaptiveSparkPlan":
        return _scans(plan.executedPlan())
    if "QueryStage" in name:
        return _scans(plan.plan())
    for i in range(plan.children().size()):
        out += _scans(plan.children().apply(i))
    return out


def scan(df: DataFrame) -> Scan:
    """Runs a query and reads its scans' metrics; a scan that is used twice counts once."""
    df.collect()
    rows, there = 0, 0
    for leaf in _scans(df._jdf.queryExecution().executedPlan()):
        rows += leaf.metrics().apply("numOutputRows").value()
        paths = leaf.relation().location().rootPaths()
        there += sum(df.sparkSession.read.parquet(paths.apply(j).toString()).count() for j in range(paths.size()))  # from the footers
    return Scan(rows, there)
