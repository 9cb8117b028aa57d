"""Full-text search by an inverted index: postings of words, scores, phrases and negation.

``postings`` has a row per word and post (day, bucket, word, post_id, created_at, tf, length, positions).  It is partitioned by day
and by the word's hash bucket and sorted by word, so a search reads the asked words' buckets in the asked days, and in them the row groups
that have the words.  It is kept like the rollups: a day is recomputed as a whole.  ``text_daily`` counts texts and words by day, for scores.

A query's words are OR-ed; ``"two words"`` must stand in a row; ``-word`` and ``-"two words"`` exclude.  A query without a
word that is asked for finds nothing.  Words are runs of word characters in lower case, not stemmed; a text that is null has none.

Where posts repeat texts and don't change, an index by text is a fraction of that: ``numbered`` has each text once with a number, and
``text_postings`` has a row per word and text in segments, each sorted by bucket and word where its texts are split, so
that postings aren't shuffled.  Posts have their texts' fingerprints, and are joined to the texts that a search finds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of words in each day.
BUCKETS = 8
#: Words of texts in a segment of the index by text: its postings are sorted in one task (about 150 MB).
SEGMENT_WORDS = 2_000_000
#: Postings that a task hands on at a time.
OUT_ROWS = 100_000
#: How soon more uses of a word stop to count, and how much a text's length does (the usual values of BM25).
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Asked:
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    without: tuple[tuple[str, ...], ...]

    @property
    def all_words(self) -> list[str]:
        return sorted({*self.words, *(w for p in self.without for w in p)})


def _split(text: str) -> tuple[str, ...]:
    return tuple("".join(c if c == "_" or unicodedata.category(c)[0] in "LMN" else " " for c in text).split())


def parse(q: str) -> Asked:
    """What a query asks for."""
    words, phrases, without = set(), [], []
    for minus, quoted, bare in re.findall(r'(?:(?<=\s)|^)(-?)(?:"([^"]*)"|([^\s"]\S*))', q.lower()):
        said = _split(quoted or bare)
        if not said:
            continue
        if minus:
            without.append(said)
            continue
        words.update(said)
        if quoted and len(said) > 1:
            phrases.append(said)
    return Asked(tuple(sorted(words)), tuple(phrases), tuple(without))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")


def _pattern(said: tuple[str, ...]) -> str:
    return r"(?U)(?<!\w)" + r"\W+".join(said) + r"(?!\w)"


def hits(text: Column, q: str) -> Column:
    """The uses of the asked words in a text, 0 where a phrase is missing or an excluded one is there: by patterns, without the index."""
    asked = parse(q)
    if not asked.words:
        return F.lit(0)
    low = F.lower(text)
    n = F.regexp_count(low, F.lit(rf"(?U)(?<!\w)(?:{'|'.join(asked.words)})(?!\w)"))
    for p in asked.phrases:
        n = F.when(low.rlike(_pattern(p)), n).otherwise(0)
    for p in asked.without:
        n = F.when(low.rlike(_pattern(p)), 0).otherwise(n)
    return n


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per word and text of (keys, w); a text's words are together, so postings are shuffled only to be written, if at all."""
    for b in batches:
        keys = [n for n in b.schema.names if n != "w"]
        row, words, places = [], [], []
        for i, w in enumerate(b.column("w").to_pylist()):
            at: dict[str, list[int]] = {}
            for place, word in enumerate(w):
                at.setdefault(word, []).append(place)
            row += [i] * len(at)
            words += at
            places += at.values()
            if len(row) >= OUT_ROWS or i + 1 == b.num_rows:
                size = [len(x) for x in places]
                length = pa.array(pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False).astype("int32")).take(pa.array(row, pa.int64()))
                taken = b.select(keys).take(pa.array(row, pa.int64()))
                columns = [pa.array(words, pa.string()), *taken.columns, pa.array(size, pa.int32()), length, pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", *keys, "tf", "length", "positions"])
                row, words, places = [], [], []


def postings(posts: DataFrame) -> DataFrame:
    """The index of some posts: texts are dealt evenly and split by Spark, and each one's words are gathered where they are split."""
    dealt = posts.where("clean_text is not null").select("post_id", "created_at", "clean_text").repartition("post_id")  # a day's posts may lie in one file
    w = dealt.select("post_id", "created_at", words_of(F.col("clean_text")).alias("w")).where(F.size("w") > 0)
    kind = w.schema["created_at"].dataType.simpleString()
    g = w.mapInArrow(_postings, f"word string, post_id string, created_at {kind}, tf int, length int, positions array<int>")
    return g.select(F.to_date("created_at").alias("day"), _bucket(F.col("word")).alias("bucket"), "word", "post_id", "created_at", "tf", "length", "positions")


def text_daily(posts: DataFrame) -> DataFrame:
    x = posts.where("clean_text is not null").select(F.to_date("created_at").alias("day"), F.size(words_of(F.col("clean_text"))).alias("n"))
    return x.groupBy("day").agg(F.count("*").alias("texts"), F.sum("n").alias("words"))


def numbered(texts: DataFrame) -> DataFrame:
    """(text_id, text_hash, clean_text, n_words): each text of (text_hash, clean_text) once.  The numbers hold once it is written."""
    each = texts.where("clean_text is not null").select("text_hash", "clean_text").dropDuplicates(["text_hash"])
    return each.select(F.monotonically_increasing_id().alias("text_id"), "text_hash", "clean_text", F.size(words_of(F.col("clean_text"))).alias("n_words"))


def text_postings(texts: DataFrame) -> DataFrame:
    """The index of numbered() texts, as written: (word, text_id, tf, length, positions, bucket), a segment in each partition."""
    n = texts.agg(F.sum("n_words")).first()[0] or 0  # one row
    dealt = texts.where("n_words > 0").select("text_id", "clean_text").repartition(max(1, -(-n // SEGMENT_WORDS)))
    g = dealt.select("text_id", words_of(F.col("clean_text")).alias("w")).mapInArrow(_postings, "word string, text_id bigint, tf int, length int, positions array<int>")
    return g.withColumn("bucket", _bucket(F.col("word"))).sortWithinPartitions("bucket", "word")


def _of_words(index: DataFrame, words: list[str]) -> DataFrame:
    """The postings of some words; the buckets are constants, so that others aren't read."""
    return index.where(F.col("bucket").isin([_bucket(F.lit(w)) for w in words]) & F.col("word").isin(words))


def _between(df: DataFrame, start, end) -> DataFrame:
    if start:
        df = df.where(F.col("day") >= F.lit(start))
    return df.where(F.col("day") <= F.lit(end)) if end else df


def _in_a_row(said: tuple[str, ...]) -> Column:
    """Whether the words stand in a row, from the map of their positions."""
    places = [F.col("places")[w] for w in said]
    here = lambda p: _all([F.array_contains(x, p + i) for i, x in enumerate(places[1:], 1)])
    return F.coalesce(F.exists(places[0], here), F.lit(False))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def found(index: DataFrame, q: str, start=None, end=None, scored: Column | None = None) -> DataFrame:
    """(post_id, created_at, relevance) of the posts that a query finds; relevance is the number of uses of its words, or the sum of ``scored``."""
    asked = parse(q)
    if not asked.words:
        return index.select("post_id", "created_at", F.lit(0).alias("relevance")).limit(0)
    return _matched(_between(_of_words(index, asked.all_words), start, end), asked, "post_id", ("created_at",), scored)


def found_texts(index: DataFrame, texts: DataFrame, q: str, scored: Column | None = None) -> DataFrame:
    """(text_hash, relevance) of the texts that a query finds, from the index by text; as found()."""
    asked = parse(q)
    if not asked.words:
        return texts.select("text_hash", F.lit(0).alias("relevance")).limit(0)
    g = _matched(_of_words(index, asked.all_words), asked, "text_id", (), scored)
    return g.join(texts.select("text_id", "text_hash"), "text_id").select("text_hash", "relevance")


def _matched(rows: DataFrame, asked: Asked, key: str, kept: tuple[str, ...], scored: Column | None) -> DataFrame:
    ours = F.col("word").isin(list(asked.words))
    measures = [*[F.first(c).alias(c) for c in kept], F.sum(F.when(ours, F.col("tf") if scored is None else scored)).alias("relevance"), F.collect_set("word").alias("has")]
    if any(len(p) > 1 for p in (*asked.phrases, *asked.without)):
        measures.append(F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("places"))  # a query's words at most
    g = rows.groupBy(key).agg(*measures).where("relevance is not null")
    is_in = lambda said: _in_a_row(said) if len(said) > 1 else F.array_contains("has", said[0])
    for p in asked.phrases:
        g = g.where(_in_a_row(p))
    for p in asked.without:
        g = g.where(~is_in(p))
    relevance = F.col("relevance").cast("int") if scored is None else F.round("relevance", 6)
    return g.select(key, *kept, relevance.alias("relevance"))


def _score(n: int, mean: float, df: dict[str, int]) -> Column:
    """A posting's part of BM25."""
    idf = F.lit(0.0)
    for w, d in df.items():
        idf = F.when(F.col("word") == w, F.log1p(F.lit((n - d + 0.5) / (d + 0.5)))).otherwise(idf)
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))


def ranked_texts(index: DataFrame, texts: DataFrame, posts: DataFrame, q: str, k: int = 20) -> DataFrame:
    """ranked() from the index by text; a text counts as often as it is posted in ``posts`` (post_id, created_at, text_hash)."""
    words = list(parse(q).words)
    if not words:
        return posts.select("post_id", "created_at", F.lit(0.0).alias("score")).limit(0)
    uses = posts.where("text_hash is not null").groupBy("text_hash").agg(F.count("*").alias("posts")).join(texts.select("text_id", "text_hash", "n_words"), "text_hash")
    total = uses.agg(F.sum("posts").alias("n"), F.sum(F.col("posts") * F.col("n_words")).alias("m")).first()  # one row
    n, mean = total["n"] or 0, (total["m"] or 0) / max(total["n"] or 0, 1)
    of_words = _of_words(index, words).select("text_id", "word").join(uses, "text_id")
    df = {r["word"]: r["df"] for r in of_words.groupBy("word").agg(F.sum("posts").alias("df")).collect()}  # a query's words
    found = found_texts(index, texts, q, _score(n, mean, df))
    return posts.join(found, "text_hash").select("post_id", "created_at", F.col("relevance").alias("score")).orderBy(F.desc("score"), "post_id").limit(k)


def ranked(index: DataFrame, texts: DataFrame, q: str, k: int = 20, start=None, end=None) -> DataFrame:
    """The k best posts (post_id, created_at, score) by BM25: rare words count more, long texts less; ties go to the smaller id."""
    words = list(parse(q).words)
    if not words:
        return index.select("post_id", "created_at", F.lit(0.0).alias("score")).limit(0)
    total = _between(texts, start, end).agg(F.sum("texts").alias("n"), F.sum("words").alias("m")).first()  # one row
    n, mean = total["n"] or 0, (total["m"] or 0) / max(total["n"] or 0, 1)
    df = {r["word"]: r["df"] for r in _between(_of_words(index, words), start, end).groupBy("word").agg(F.count("*").alias("df")).collect()}  # a query's words
    return found(index, q, start, end, _score(n, mean, df)).orderBy(F.desc("relevance"), "post_id").limit(k).withColumnRenamed("relevance", "score")
