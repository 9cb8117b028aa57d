"""Streams of posts: rollups kept fresh batch by batch, and hourly counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import rollups
from tidemark.sources import sinks


def hourly_counts(stream: DataFrame, delay: str = "1 day", once: bool = False) -> DataFrame:
    """Posts, reach and engagement by hour, language and sentiment; posts later than ``delay`` are left out.

    With ``once`` a post that comes again within ``delay`` counts once; its id is forgotten when the watermark has passed it, so the
    state holds the ids and hours of a ``delay`` and no more.
    """
    s = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    if once:
        s = s.dropDuplicatesWithinWatermark(["post_id"])
    g = s.groupBy(F.window("created_at", "1 hour"), rollups.named("language"), rollups.named("sentiment"))
    return g.agg(F.count("*").alias("posts"), F.sum(F.coalesce("reach", F.lit(0))).alias("reach"), F.sum(F.coalesce("engagement", F.lit(0))).alias("engagement")).select(F.col("window.start").alias("hour"), "language", "sentiment", "posts", "reach", "engagement")


def write_hours(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """hourly_counts() as a table of hours that are over: an hour is written once, when the watermark has passed it.

    A query that is started again with its checkpoint goes on where it stopped: the file sink's log knows which batches it has.
    """
    out = hourly_counts(stream, delay, once=True).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_batch(new: DataFrame, key: str = "post_id") -> DataFrame:
    """The first row of every id of a batch: the earliest, then by the row's hash."""
    order = Window.partitionBy(key).orderBy("created_at", F.xxhash64(*[c for c, kind in new.dtypes if not kind.startswith("map")]))
    return new.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def keep_fresh(stream: DataFrame, posts_path: str, rollup_root: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's new posts and recomputes the days it touches.

    An id is known whatever day it was stored with, as in a job's append; a batch that is run again finds its ids
    in the table and appends nothing, and a day recomputed twice is the same day.
    """

    def batch(new: DataFrame, _: int) -> None:
        spark = new.sparkSession
        days = rollups.touched_days(new)
        if not days:
            return
        sinks.append_unknown(first_of_batch(new), posts_path)
        rollups.refresh_days(spark.read.schema(new.schema).parquet(posts_path), rollup_root, days, new.select("username").distinct())

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
