"""Routing of a question to the smallest table that can answer it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indexes, rollups, search
from tidemark.plans.filters import Filters, on_cube, on_posts
from tidemark.sources import sinks


@dataclass
class Tables:
    """The posts table and the rollups: read where they are built; published once under ``root`` where that is given (of posts that don't change), else derived from posts.

    ``texts`` (text_hash, clean_text) are the texts that the posts' fingerprints name.  Where they and ``root`` are given, each text is stored and indexed
    once, however many posts repeat it.
    """

    posts: DataFrame
    topics: DataFrame | None = None
    built: dict[str, DataFrame] = field(default_factory=dict)
    root: str | None = None
    texts: DataFrame | None = None

    def rollup(self, name: str) -> DataFrame:
        if name not in self.built:
            if self.root:
                self.built[name] = rollups.published(self.posts, name, self.root)
            else:
                self.built[name] = rollups.BUILDERS[name](self.posts)
        return self.built[name]

    @property
    def indexed(self) -> bool:
        """Whether searches have an index to read."""
        return self.root is not None or "postings" in self.built

    def by_time(self) -> DataFrame:
        """The posts in files by time with bloom filters of their ids, written once under ``root``; without it, the posts as they are.

        Where the texts are stored by themselves, they aren't in it."""
        if not self.root:
            return self.posts
        rows = self.posts.drop("clean_text") if self.by_text else self.posts
        return self._published("posts", lambda to: indexes.write(rows, to))

    @property
    def by_text(self) -> bool:
        """Whether texts are stored and indexed by themselves."""
        return self.root is not None and self.texts is not None

    def stored_texts(self) -> DataFrame:
        """search.numbered() of the texts, with bloom filters of the fingerprints."""
        return self._published("texts", lambda to: search.numbered(self.texts).write.options(**indexes.options(points=("text_hash",))).parquet(to))

    def text_postings(self) -> DataFrame:
        return self._published("text_postings", lambda to: search.text_postings(self.stored_texts()).write.partitionBy("bucket").parquet(to))

    def _published(self, name: str, write: Callable[[str], None]) -> DataFrame:
        if name not in self.built:
            spark = self.posts.sparkSession
            self.built[name] = spark.read.parquet(sinks.publish(spark, f"{self.root}/{name}", write))
        return self.built[name]

    @classmethod
    def at(cls, spark, posts: DataFrame, root: str, topics: DataFrame | None = None) -> Tables:
        return cls(posts, topics, {n: rollups.stored(spark, n, root) for n in rollups.BUILDERS})


def choose(f: Filters, granularity: str | None = None) -> str:
    """``posts`` or ``daily_cube``; live-only filters win over mode=cube."""
    return "posts" if f.mode == "live" or f.live_only or granularity == "hour" else "daily_cube"


def choose_hourly(f: Filters) -> str:
    return "posts" if f.mode == "live" or f.live_only or f.country or f.topic else "hourly_cube"


def choose_hashtags(f: Filters) -> str:
    return "posts" if f.mode == "live" or f.more_than_dates else "hashtag_daily"


def cells(t: Tables, f: Filters, granularity: str | None = None) -> DataFrame:
    """The filtered rows of the chosen source, with the cube's columns and a time ``t``."""
    if choose(f, granularity) == "posts":
        return rollups.as_measures(t.posts.where(on_posts(f)))
    return t.rollup("daily_cube").where(on_cube(f)).withColumn("t", F.col("day").cast("timestamp_ntz"))
