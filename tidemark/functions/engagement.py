"""Synthetic engagement: reproducible numbers per post for data sets that have none, always flagged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The seed, the distributions' parameters and, in ``generated``, which numbers are drawn in which order.
# A post's numbers must stay the same wherever they are made, so all of these are part of the result.
SEED = 20261008
REACH_FACTOR, REACH_POWER, RETWEET_FACTOR, SPREAD = 0.004, 0.85, 0.1, 1.1
SHARE_RATES, COMMENT_RATES = (0.10, 0.35), (0.02, 0.12)
GENERATOR = "tidemark.functions.engagement"


def generated(post_ids: list[str], followers: np.ndarray, is_retweet: np.ndarray) -> pd.DataFrame:
    """likes, comments and shares of some posts.  Every post has a generator of its own, seeded by its id; the rest is done for all at once."""
    digests = b"".join(hashlib.blake2b(i.encode(), digest_size=8).digest() for i in post_ids)
    own = [np.random.default_rng(s) for s in (np.frombuffer(digests, "<u8") ^ np.uint64(SEED)).tolist()]
    expected = REACH_FACTOR * followers**REACH_POWER * np.where(is_retweet, RETWEET_FACTOR, 1.0)
    out = pd.DataFrame({c: np.zeros(len(own), np.int64) for c in ("likes", "comments", "shares")})
    out["likes"] = (expected * np.array([g.lognormal(0.0, SPREAD) for g in own])).astype(np.int64)
    for i in np.flatnonzero(out["likes"]):
        for column, rates in (("shares", SHARE_RATES), ("comments", COMMENT_RATES)):
            out.loc[i, column] = own[i].binomial(out["likes"][i], own[i].uniform(*rates))
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("likes", "comments", "shares")]))
def _numbers(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ids, followers, retweets in batches:
        todo = ids.notna().to_numpy()
        made = generated(ids[todo].tolist(), followers[todo].to_numpy(float), retweets[todo].to_numpy(bool))
        yield made.set_axis(np.flatnonzero(todo)).reindex(range(len(ids)))


def synthesize(posts: DataFrame) -> DataFrame:
    """posts (POSTS_DDL) with engagement where they have none; other posts go to Python as nulls, for which nothing is drawn."""
    lacks = F.col("engagement").isNull()
    made = _numbers(F.when(lacks, F.col("post_id")), F.coalesce("reach", F.lit(0)).cast("double"), F.coalesce("is_retweet", F.lit(False)))
    n = [F.col(f"__made.{c}") for c in ("likes", "comments", "shares")]
    whole = F.struct(n[0].alias("likes"), n[1].alias("comments"), n[2].alias("shares"), (n[0] + n[1] + n[2]).alias("total"), F.lit(True).alias("synthetic"), F.lit(GENERATOR).alias("generator"))
    return posts.withColumn("__made", made).withColumn("engagement", F.coalesce("engagement", whole)).drop("__made")


def remove(posts: DataFrame) -> DataFrame:
    return posts.withColumn("engagement", F.when(~F.coalesce("engagement.synthetic", F.lit(False)), F.col("engagement")))
