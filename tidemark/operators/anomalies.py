"""Daily features and three kinds of outliers: rolling z-scores, quartile fences, isolation forest.

All work on one row per day, after aggregation, so a window over all rows holds thousands of them.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rollups import total
from tidemark.plans.filters import Filters, on_cube
from tidemark.plans.planner import Tables

HISTORY, LEAST_HISTORY, LEAST_ANALYSED = 28, 14, 50


def daily_features(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Posts, retweets, reach, negative share and engagement by day, with means and deviations of the 28 rows before.

    Always from the daily cube; filters that it can't answer are left aside.
    """
    of = lambda s: total(F.when(F.col("sentiment") == s, F.col("posts")))
    d = t.rollup("daily_cube").where(on_cube(f)).groupBy("day").agg(*[total(m).alias(m) for m in ("posts", "retweets", "reach")], of("negative").alias("negative"), total(F.when(F.col("sentiment") != "not_analyzed", F.col("posts"))).alias("analysed"), total("engagement").alias("engagement"))
    d = d.withColumn("neg_share", F.try_divide(F.col("negative").cast("double"), "analysed"))
    w = Window.partitionBy().orderBy("day").rowsBetween(-HISTORY, -1)
    d = d.select(
        "*", F.avg("posts").over(w).alias("vol_mean"), F.stddev_pop("posts").over(w).alias("vol_std"),
        F.avg("neg_share").over(w).alias("neg_mean"), F.stddev_pop("neg_share").over(w).alias("neg_std"), F.count("*").over(w).alias("history"),
    )
    z = lambda x, m, s, more: F.when((F.col("history") >= LEAST_HISTORY) & (F.col(s) > 0) & more, F.round((F.col(x) - F.col(m)) / F.col(s), 6))
    d = d.withColumn("vol_z", z("posts", "vol_mean", "vol_std", F.lit(True)))
    d = d.withColumn("neg_z", z("neg_share", "neg_mean", "neg_std", (F.col("analysed") >= LEAST_ANALYSED) & F.col("neg_share").isNotNull()))
    return d.withColumns({c: F.round(c, 6) for c in ("neg_share", "vol_mean", "vol_std", "neg_mean", "neg_std")})


def fences(d: DataFrame) -> DataFrame:
    """Quartiles of the posts a day and the fences beyond them (one row)."""
    q = d.agg(F.percentile("posts", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[0] - 1.5 * iqr).alias("low"), (F.col("q")[1] + 1.5 * iqr).alias("high"))


def isolation_scores(x: np.ndarray, trees: int = 200, seed: int = 42, size: int = 256) -> np.ndarray:
    """Isolation-forest scores in (0, 1), higher for points that random splits isolate sooner."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(size, n)
    limit = int(np.ceil(np.log2(max(size, 2))))
    mean_path = lambda m: np.where(m > 2, 2 * (np.log(np.maximum(m - 1, 1)) + np.euler_gamma) - 2 * (m - 1) / np.maximum(m, 1), np.where(m == 2, 1.0, 0.0))
    depth = np.zeros(n)
    for _ in range(trees):
        stack = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while stack:
            sample, points, level = stack.pop()
            spread = np.ptp(x[sample], axis=0) if len(sample) else np.zeros(x.shape[1])
            usable = np.flatnonzero(spread > 0)
            if level >= limit or len(sample) <= 1 or not len(usable):
                depth[points] += level + mean_path(np.array(len(sample)))
                continue
            c = rng.choice(usable)
            at = rng.uniform(x[sample, c].min(), x[sample, c].max())
            for side in (True, False):
                stack.append((sample[(x[sample, c] < at) == side], points[(x[points, c] < at) == side], level + 1))
    return 2.0 ** (-depth / trees / max(float(mean_path(np.array(size))), 1e-9))


def _forest(contamination: float):
    def run(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("day").reset_index(drop=True)
        posts = np.maximum(days["posts"], 1)
        x = np.column_stack([np.log1p(days["posts"]), days["neg_share"].fillna(0), days["retweets"] / posts, np.log1p(days["reach"] / posts)]).astype(float)
        score = isolation_scores(x) if len(days) >= 30 else np.zeros(len(days))
        cutoff = np.quantile(score, 1 - contamination) if len(days) >= 30 else np.inf
        return pd.DataFrame({"day": days["day"], "if_score": np.round(score, 6), "if_outlier": score > cutoff})

    return run


def forest(d: DataFrame, contamination: float = 0.02) -> DataFrame:
    """(day, if_score, if_outlier): a forest over the whole daily series, one row per day.

    Its features are log posts, negative share, retweet share and log mean reach.
    """
    return d.select("day", "posts", "neg_share", "retweets", "reach", F.lit(1).alias("series")).groupBy("series").applyInPandas(_forest(contamination), "day date, if_score double, if_outlier boolean")


def judged(t: Tables, f: Filters = Filters(), z: float = 3.0, contamination: float | None = 0.02, min_volume: int = 100) -> DataFrame:
    """Every day with its ``reasons``, by the rules; without ``contamination`` the forest is left out."""
    d = daily_features(t, f)
    big = F.greatest("posts", "vol_mean") >= min_volume
    rules: dict[str, Column] = {
        "volume_spike": big & (F.col("vol_z") >= z), "volume_drop": big & (F.col("vol_z") <= -z),
        "negativity_surge": big & (F.col("neg_z") >= z), "negativity_drop": big & (F.col("neg_z") <= -z),
        "iqr_outlier": (F.col("posts") < F.col("low")) | (F.col("posts") > F.col("high")),
    }
    d = d.crossJoin(F.broadcast(fences(d)))  # one row of fences
    if contamination is not None:
        d, rules["isolation_forest"] = d.join(forest(d, contamination), "day"), F.col("if_outlier")
    return d.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def detect(t: Tables, f: Filters = Filters(), z: float = 3.0, contamination: float | None = 0.02, limit: int = 50, min_volume: int = 100) -> DataFrame:
    """Days with at least one reason, those with most reasons first."""
    d = judged(t, f, z, contamination, min_volume).where(F.size("reasons") > 0)
    return d.orderBy(F.size("reasons").desc(), F.abs(F.coalesce("vol_z", F.lit(0.0))).desc(), "day").limit(limit).drop("q1", "q3")


def methods(days: DataFrame) -> DataFrame:
    """How many days in all, with any reason, and by method (one row), from judged()."""
    has = lambda *names: F.count_if(F.arrays_overlap("reasons", F.array(*map(F.lit, names))))
    return days.agg(
        F.count("*").alias("days"), F.count_if(F.size("reasons") > 0).alias("anomalous_days"), has("volume_spike", "volume_drop").alias("volume_z"),
        has("negativity_surge", "negativity_drop").alias("negativity_z"), has("iqr_outlier").alias("iqr"), has("isolation_forest").alias("isolation_forest"),
    )


__all__ = ["daily_features", "detect", "fences", "forest", "isolation_scores", "judged", "methods"]
