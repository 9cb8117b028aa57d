"""Filter interaction audit: every order of five filters is replayed over every document's flags.

``flags`` reads the texts once and stores a row per document: its part, a bit for each filter that it fails, and its
labels.  ``replay`` crosses these rows with the orders (120 rows, broadcast), finds each order's first failing step,
explodes the steps, and counts by part, order and step; counts are combined before they are shuffled, so a shuffle
moves at most 600 rows of each part from a task.  A filter's share over all orders (its Shapley value) is a window
over those counts.

Copies are found by the SHA-256 of their texts: the least id of each hash is aggregated with map-side combining, only
hashes of several ids come back, and the join with them can be split by adaptive skew handling, whatever share of the
rows one text has.

Edge cases: a null text is empty; a null or empty source is the part ''; a null id stands before all others, has no
labels, and rows of one id aren't copies of each other by themselves; labels that repeat an id count as 1 where any of
them is 1; a document without labels or with null ones is never good or toxic; repeated rows are counted row by row; an
empty table has no parts and gives no rows; other columns of the inputs are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, key_or

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}


def failures(text: Column) -> dict[str, Column]:
    """The conditions of the filters that look at one text only."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 50,
        "B": 100 * distinct < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flags(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic) of every document."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    own = [F.when(c, BIT[f]).otherwise(0) for f, c in failures(text).items()]
    rows = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"), key_or(documents["doc_id"]).alias("place"),
        F.coalesce(documents["source"].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), sum(own[1:], own[0]).alias("own"),
    )
    rows = cut(rows, "flags")  # texts are read for it once
    first = rows.groupBy("content").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    first = cut(first, "copies")  # a join of two tables can be split where one text has many rows
    said = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False)))
    judged = labels.groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    copy = F.when(F.col("place") > F.col("first"), BIT["E"]).otherwise(0)
    rows = rows.join(first, "content", "left").select("doc_id", "part", (F.col("own") + copy).alias("bits"))
    is_so = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.join(judged, "doc_id", "left").select("part", "bits", is_so("good"), is_so("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """All 120 orders, each with its filters' bits as b1 to b5."""
    steps = range(1, len(FILTERS) + 1)
    rows = [("".join(p), *[BIT[f] for f in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"b{i} int" for i in steps)).coalesce(1)


def replay(rows: DataFrame) -> DataFrame:
    """The counts by part, filter_order and step from rows of flags()."""
    steps = range(1, len(FILTERS) + 1)
    failed = F.lit(len(FILTERS) + 1)
    for i in reversed(steps):
        failed = F.when(F.col("bits").bitwiseAND(F.col(f"b{i}")) != 0, i).otherwise(failed)
    each = rows.crossJoin(F.broadcast(orders(rows.sparkSession))).withColumn("failed", failed)
    each = each.select("part", "filter_order", "bits", "good", "toxic", "failed", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"b{i}").alias("bit")) for i in steps])).alias("s"))
    here, fails = F.col("failed") == F.col("s.step"), F.col("bits").bitwiseAND(F.col("s.bit")) != 0
    counts = each.groupBy("part", "filter_order", F.col("s.step").alias("step"), F.col("s.bit").alias("bit")).agg(
        F.count_if(F.col("failed") > F.col("s.step")).alias("kept"), F.count_if(here).alias("removed"),
        F.count_if(fails & (F.col("failed") < F.col("s.step"))).alias("redundant"), F.count_if(F.col("bits") == F.col("s.bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"), F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")  # 120 rows each


def op13(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of whole documents, a row for each part, order and step."""
    return replay(flags(documents, labels))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
#: The same rows from any SQL engine.
SQL = rf"""
WITH d AS (SELECT *, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failing,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM d),
o AS (SELECT o AS filter_order FROM (VALUES {_ORDERS}) AS v(o)),
x AS (SELECT part, failing, good, toxic, filter_order, coalesce((SELECT min(i) FROM unnest([1, 2, 3, 4, 5]) AS v(i) WHERE contains(failing, filter_order[i])), 6) AS failed FROM f CROSS JOIN o),
c AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, count(*) FILTER (failed > step) AS kept, count(*) FILTER (failed = step) AS removed,
  count(*) FILTER (contains(failing, filter_order[step]) AND failed < step) AS redundant, count(*) FILTER (failing = filter_order[step]) AS unique_fails,
  count(*) FILTER (failed = step AND good) AS good_lost, count(*) FILTER (failed = step AND toxic) AS toxic_lost FROM x, unnest([1, 2, 3, 4, 5]) AS u(step) GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c
"""
