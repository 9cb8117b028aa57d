"""Writers: appends without known ids, staged rebuilds, batches per partition, codecs and extracts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indexes
from tidemark.schema import POINTS, schema_violations


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that was published under ``path``, None where there's none."""
    marker = f"{path}/CURRENT"
    if not exists(spark, marker):
        return None
    name = spark.read.text(marker).first()
    return f"{path}/{name['value']}" if name else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """The folder published under ``path``; where there's none, ``write`` makes it first.

    A table is written to a folder of its own, and only a whole one is named by the marker; what is published is never
    written again, so frames that read it stay valid.  Of two that publish at once the later one is named, and both folders stay.
    """
    done = current(spark, path)
    if done:
        return done
    name = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    draft, marker = jvm.Path(f"{path}/{name}.marker"), jvm.Path(f"{path}/CURRENT")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    if not fs.rename(draft, marker):
        fs.delete(draft, False)
    return current(spark, path) or f"{path}/{name}"


def append_unknown(rows: DataFrame, path: str, key: str = "post_id", valid: Column | None = None, counted: dict[str, Column] | None = None, drop: tuple[str, ...] = (), by: str | None = None) -> dict[str, int]:
    """Appends the ``valid`` rows whose key (``by``, if the rows call it otherwise) isn't in the table yet; counts of all rows, from the write itself.

    All keys of the table are compared, whatever its days, so a row that comes again with another time is known too; only their
    column is read.  The counts (``inserted``, ``known`` and what ``counted`` adds, as sums over the rows) are observed
    after the last shuffle, in the stage that writes: its tasks count once, also where executors are lost.
    """
    spark = rows.sparkSession
    valid = F.lit(True) if valid is None else valid
    if exists(spark, path):
        there = spark.read.parquet(path).select(F.col(key).alias("_known_key"))
        marked = rows.join(there, F.col(by or key) == F.col("_known_key"), "left").withColumn("_known", F.col("_known_key").isNotNull()).drop("_known_key")
    else:
        marked = rows.withColumn("_known", F.lit(False))
    sums = {"inserted": (valid & ~F.col("_known")).cast("bigint"), "known": (valid & F.col("_known")).cast("bigint"), **(counted or {})}
    seen = Observation()
    marked = marked.observe(seen, *[F.sum(F.coalesce(c, F.lit(0))).alias(n) for n, c in sums.items()])
    out = marked.where(valid & ~F.col("_known")).drop("_known", *drop)
    if "created_at" in out.columns:
        out = out.sortWithinPartitions("created_at")
    out.write.mode("append").options(**indexes.options(points=tuple(c for c in POINTS if c in out.columns))).parquet(path)
    return {n: (seen.get or {}).get(n) or 0 for n in sums}


def append_new(posts: DataFrame, path: str, key: str = "post_id") -> DataFrame:
    """Appends valid posts whose id isn't there yet; the counts of what was done (one row)."""
    broken = F.size(schema_violations()) > 0
    n = append_unknown(posts, path, key, ~broken, {"schema_validation": broken.cast("bigint")})
    return posts.sparkSession.createDataFrame([(n["inserted"], n["known"], n["schema_validation"])], "inserted bigint, duplicates bigint, schema_validation bigint")


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rebuild(df: DataFrame, path: str) -> None:
    """Writes beside ``path`` and then takes its place: the old table is renamed away first and deleted last, so a crash loses neither."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.staging")
    jvm = spark.sparkContext._jvm
    new, now, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.staging", path, f"{path}.old"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        if not fs.rename(now, old):
            raise OSError(f"{path} can't be renamed")
    if not fs.rename(new, now):
        raise OSError(f"{path}.staging can't be renamed; the table is at {path}.old")
    fs.delete(old, True)


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...], where: Column, write: Callable[[DataFrame, str], None]) -> None:
    """Puts df's partitions (by the first of ``by``) in the place of those of the table at ``path`` for which ``where`` holds; ones that df lacks go.

    df is written beside the table first (``write``), then folders are moved, so readers wait for renames only.
    """
    spark, top = df.sparkSession, by[0]
    fresh = f"{path}.refresh-{uuid.uuid4().hex}"
    write(df, fresh)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = lambda table: {r[top] for r in spark.read.parquet(table).where(where).select(top).distinct().collect()} if _has_rows(spark, table) else set()  # noqa: E731  days
    now, new = parts(path), parts(fresh)
    for part in sorted(now | new):
        old, made = (hadoop.Path(f"{table}/{top}={part}") for table in (path, fresh))
        fs.delete(old, True)
        if part in new:
            fs.mkdirs(old.getParent())
            if not fs.rename(made, old):
                raise OSError(f"{made} can't be renamed")
    fs.delete(hadoop.Path(fresh), True)
    spark.catalog.refreshByPath(path)


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether there is a table with any partition: one without has no files that tell its columns."""
    if not exists(spark, path):
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return any("=" in s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def write_with_codec(df: DataFrame, path: str, codec: str) -> None:
    """``none``, ``snappy``, ``gzip`` or ``zstd`` Parquet, or ``json``."""
    if codec == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").option("compression", codec).parquet(path)


def in_batches(df: DataFrame, send: Callable[[list[Row]], None], size: int = 5000) -> None:
    """Hands each partition's rows to ``send`` in lists of ``size``; for stores without a Spark writer.

    A task that runs again sends again; ``batches.send_once`` is for stores that can hold back what isn't committed.
    """

    def run(rows: Iterator[Row]) -> None:
        for batch in in_lists(rows, size):
            send(batch)

    df.foreachPartition(run)


def in_lists(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    while batch := list(islice(rows, size)):
        yield batch


def extract(df: DataFrame, most: int = 1000) -> list[dict]:
    """A small result as plain records, for charts."""
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]
