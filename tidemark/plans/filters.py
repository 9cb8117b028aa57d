"""The filter model that every analytic takes, as predicates over posts or over the cube."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.search import hits
from tidemark.schema import SENTIMENTS, SENTINELS

#: Filters that only the posts table can answer.
LIVE_ONLY = ("hashtag", "q", "min_engagement", "exclude_retweets", "user")


@dataclass(frozen=True)
class Filters:
    start: date | None = None
    end: date | None = None  # inclusive
    language: str | None = None
    country: str | None = None
    sentiment: str | None = None
    topic: str | None = None
    hashtag: str | None = None
    q: str | None = None
    min_engagement: int | None = None
    exclude_retweets: bool = False
    user: str | None = None
    mode: str = "auto"

    def __post_init__(self):
        tag = (self.hashtag or "").lstrip("#").strip().lower() or None
        object.__setattr__(self, "hashtag", tag)
        object.__setattr__(self, "q", (self.q or "").strip() or None)
        if self.mode not in ("auto", "live", "cube"):
            raise ValueError(f"mode {self.mode!r} is not auto, live or cube")
        if self.sentiment is not None and self.sentiment not in (*SENTIMENTS, SENTINELS["sentiment"]):
            raise ValueError(f"unknown sentiment {self.sentiment!r}")
        if self.min_engagement is not None and self.min_engagement < 0:
            raise ValueError("min_engagement is negative")
        if len(self.q or "") > 200 or len(self.user or "") > 50:
            raise ValueError("q has at most 200 characters, user at most 50")

    @property
    def live_only(self) -> bool:
        """``min_engagement=0`` counts: it leaves out posts without engagement, which the cube can't tell."""
        return any(getattr(self, f) is not None and getattr(self, f) is not False for f in LIVE_ONLY)

    def of_cube(self) -> Filters:
        """The part of the filters that the cube can answer."""
        return replace(self, **{f: False if f == "exclude_retweets" else None for f in LIVE_ONLY})

    @property
    def more_than_dates(self) -> bool:
        return self != Filters(start=self.start, end=self.end, mode=self.mode)

    def only_dates(self) -> Filters:
        return Filters(start=self.start, end=self.end)

    def without_topic(self) -> Filters:
        return replace(self, topic=None)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def on_cube(f: Filters) -> Column:
    """Dates and dimensions; the rest isn't in the cube."""
    parts = []
    if f.start:
        parts.append(F.col("day") >= F.lit(f.start))
    if f.end:
        parts.append(F.col("day") <= F.lit(f.end))
    for value, column in ((f.language, "language"), (f.country, "country"), (f.sentiment, "sentiment"), (f.topic, "topic_id")):
        if value:
            parts.append(F.col(column) == value)
    return _all(parts)


def on_posts(f: Filters) -> Column:
    """All filters; a sentinel asks for missing values."""
    parts, at = [], F.col("created_at")
    if f.start:
        parts.append(at >= F.lit(f.start).cast("timestamp_ntz"))
    if f.end:
        parts.append(at < F.lit(f.end + timedelta(days=1)).cast("timestamp_ntz"))
    for value, column in ((f.language, "language"), (f.country, "country"), (f.sentiment, "sentiment"), (f.topic, "topic_id")):
        if value:
            parts.append(F.col(column).isNull() if value == SENTINELS[column] else F.col(column) == value)
    if f.hashtag:
        parts.append(F.array_contains("hashtags", f.hashtag))
    if f.q:
        parts.append(hits(F.col("clean_text"), f.q) > 0)
    if f.min_engagement is not None:
        parts.append(F.col("engagement") >= f.min_engagement)
    if f.exclude_retweets:
        parts.append(~F.col("is_retweet"))
    if f.user:
        parts.append(F.col("username") == f.user)
    return _all(parts)
