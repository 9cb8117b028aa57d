"""A job from files to fresh rollups: ingest, append what is new, enrich it, recompute the days it touches.

Under ``root`` lie ``posts`` (appended to, never rewritten; bloom filters of ids), ``enriched`` (a row per post and processing, joined by id on
reading) and ``rollups``.  A job that is run again appends nothing and recomputes the same days to the same cells.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import factors, ingest, nlp, rollups
from tidemark.schema import flat, schema_violations
from tidemark.sources import readers, sinks

#: What enrichment tells about a post.
ENRICHED = {
    "sentiment": "struct<label: string, score: double, confidence: double, method: string>",
    "topic": "struct<id: string, label: string, weight: double, method: string>",
    "keywords": "array<string>",
    "processed_at": "timestamp",
}


def count_terms(posts: DataFrame, root: str, job_id: str) -> None:
    """Stores in how many of a job's posts each term stands; a job that is run again replaces its own counts."""
    own = posts.where(F.col("ingestion_job_id") == job_id)
    nlp.term_statistics(own, "language", "clean_text").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/terms/job={job_id}")


def terms(spark: SparkSession, root: str) -> DataFrame | None:
    """The statistics of all jobs, None before the first."""
    return nlp.united(spark.read.parquet(f"{root}/terms")) if sinks.exists(spark, f"{root}/terms") else None


def write_back(posts: DataFrame, root: str, sentiment: PipelineModel | None = None, topics: dict[str, PipelineModel | factors.Topics] | None = None, reprocess: bool = False) -> None:
    """Enriches the unprocessed posts (all with ``reprocess``) and adds the results beside the posts; keywords by the stored statistics of terms."""
    spark = posts.sparkSession
    told = nlp.enrich(flat(posts), sentiment, topics or {}, reprocess, terms(spark, root), nlp.stop_words(spark))
    if "topic_id" in told.columns:
        method = F.create_map(*[F.lit(x) for language, m in (topics or {}).items() for x in (language, "tfidf_nmf" if isinstance(m, factors.Topics) else "lda")])
        told = told.withColumn("topic", F.when(F.col("topic_id").isNotNull(), F.struct(F.col("topic_id").alias("id"), F.lit(None).cast("string").alias("label"), F.col("topic_weight").alias("weight"), method[F.substring_index("topic_id", "-", 1)].alias("method"))))
    columns = [(F.col(c) if c in told.columns else F.lit(None)).cast(kind).alias(c) for c, kind in ENRICHED.items()]
    told.select("post_id", *columns).write.mode("append").parquet(f"{root}/enriched")


def posts(spark: SparkSession, root: str) -> DataFrame:
    """The stored posts with what their latest enrichment tells."""
    stored = spark.read.parquet(f"{root}/posts")
    if not sinks.exists(spark, f"{root}/enriched"):
        return stored
    latest = spark.read.parquet(f"{root}/enriched").groupBy("post_id").agg(F.max_by(F.struct(*ENRICHED), "processed_at").alias("told"))
    j = stored.join(latest, "post_id", "left")
    over = {c: F.when(F.col("told").isNotNull(), F.col("told")[c]).otherwise(F.col(c)).alias(c) for c in ENRICHED}
    over["processed"] = (F.col("processed") | F.col("told").isNotNull()).alias("processed")
    return j.select(*[over.get(c, F.col(c)) for c in stored.columns])


def take(read: DataFrame, path: str) -> dict[str, int]:
    """Appends what is new of normalised records; all counters come from that one pass over the input."""
    rows = ingest.folded(read)
    ok = F.col("reason").isNull()
    broken = ok & (F.size(schema_violations()) > 0)
    of_input = ("fold_key", "rows", "reason", "file_ord", "row_ord")  # rejected rows have no id to be known by, but their place
    return sinks.append_unknown(rows, path, "post_id", ok & ~broken, {**ingest.counted(), "schema_validation": broken.cast("bigint")}, of_input, by="fold_key")


def run(spark: SparkSession, paths: list[str], root: str, job_id: str, profile: str = "generic", sentiment: PipelineModel | None = None, topics: dict[str, PipelineModel | factors.Topics] | None = None) -> dict[str, int]:
    """One job; the counts of what was read, rejected, inserted and found to be there already."""
    counts = take(ingest.normalise(readers.read(spark, paths), profile, job_id=job_id), f"{root}/posts")
    count_terms(spark.read.parquet(f"{root}/posts"), root, job_id)
    write_back(posts(spark, root), root, sentiment, topics)
    days = rollups.touched_days(spark.read.parquet(f"{root}/posts").where(F.col("ingestion_job_id") == job_id))
    whole = flat(posts(spark, root))
    if not sinks.exists(spark, f"{root}/rollups"):
        rollups.rebuild(whole, f"{root}/rollups")
    else:
        rollups.refresh_days(whole, f"{root}/rollups", days)
    return counts
