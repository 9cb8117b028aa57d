"""Language identification by Bayesian fusion of evidence.

Evidence for each document: its text (byte trigrams under per-language models), the language its
markup declares, and a prior for its host that is smoothed hierarchically: global, then address suffix, then
host, each level drawn towards the one above by SMOOTH pseudo-documents.  The counts behind the declared
language's reliability and the priors are sums of text posteriors by group, over all documents; a
document's own share is taken out of its priors again.  One class more, ``und``, has uniform
trigrams, so that text unlike all languages is found.

Training: the text model of a label is fitted on all its rows if they are at most SAMPLE, else on about SAMPLE of them
(chosen by a hash of id and text), their whole texts; everything else covers all rows.  Rows that repeat both id and text are one here.
So a label with LEAST rows with text is a class at every size of the table; one with fewer (a stray declaration) is not, and its texts
get the class they are most like, or ``und``.  Models of classes go to the driver and to all workers, so more than CLASSES labels of LEAST rows are an error.

A row is kept if it has words, its best class isn't ``und`` and that class has a posterior of at
least MIN_CONFIDENCE.

Edge cases: null or empty texts have no text evidence, get their class from the rest, and aren't
kept; null declared languages, suffixes or hosts are no evidence at that level; a declared value outside the
classes counts as one more value; without labelled rows the only class is ``und`` and nothing is
kept; rows that repeat an id count each; other columns pass through, result columns replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, key_or, utf8, with_arrow
from tidemark.llm._text import SLICE_BYTES, slices

#: Rows of each label that its text model is fitted on.
SAMPLE = 4000
#: Labelled rows that a language needs to be a class.
LEAST = 5
#: The most classes: their models take 32 MB.
CLASSES = 256
BUCKETS = 1 << 15
#: Weight of a trigram's log-likelihood; neighbours overlap, so they aren't independent evidence.
TEXT_WEIGHT = 0.1
SMOOTH, MIN_CONFIDENCE = 20.0, 0.5
#: Priors of up to so many bytes go to all tasks, so that no text moves; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
UND = "und"
#: How likely a text is of no class, before any evidence.
UND_PRIOR = 0.01
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def trigram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): hashed byte trigrams of some texts (lower-cased, two spaces behind), and where each text's begin."""
    buf = np.frombuffer(b"".join(t.lower() + b"  " for t in texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    x = (buf[:-2] << 16 | buf[1:-1] << 8 | buf[2:]) if len(buf) > 2 else np.zeros(0, np.uint32)
    inside = np.ones(len(buf), bool)
    ends = np.cumsum(sizes + 2)
    inside[ends - 1] = inside[ends - 2] = False  # these go on into the next text
    hashed = (x * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return hashed[inside[: len(x)]], np.concatenate(([0], np.cumsum(sizes)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for name in sorted(set(label)):
            n = np.zeros(BUCKETS, np.int64)
            own = [t for x, t in zip(label, texts, strict=True) if x == name]
            for i, j in slices(own):
                n += np.bincount(trigram_buckets(own[i:j])[0], minlength=BUCKETS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["label", "bucket", "n"])


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(classes, log-probabilities) from rows (id, label, t); ``und`` is the last class."""
    labelled = rows.where("label is not null and length(t) > 0")
    labelled = labelled.withColumn("x", F.xxhash64("t"))
    # rows that repeat an id and a text are one in the sample: else all of them would be drawn, or none
    often = labelled.groupBy("label").agg(F.count("*").alias("rows"), F.count_distinct(F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")), "x")).alias("texts")).where(F.col("rows") >= LEAST)
    if often.limit(CLASSES + 1).count() > CLASSES:
        raise ValueError(f"more than {CLASSES} labels have {LEAST} rows or more; a model of each wouldn't fit into a worker: give a label column with fewer values")
    chance = F.pmod(F.xxhash64("id", "t", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = labelled.join(F.broadcast(often), "label").where(chance < F.lit(float(SAMPLE)) / F.col("texts"))  # CLASSES rows
    some = some.groupBy("label", "id", "x").agg(F.first("t").alias("t"))
    counts = some.select("label", "t").mapInArrow(_count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # CLASSES x BUCKETS rows
    classes = sorted(counts["label"].unique().tolist())
    logs = np.full((len(classes) + 1, BUCKETS), -np.log(BUCKETS), np.float32)
    for i, c in enumerate(classes):
        own = counts[counts["label"] == c]
        n = np.full(BUCKETS, 0.05)
        n[own["bucket"].to_numpy()] += own["n"].to_numpy()
        logs[i] = np.log(n / n.sum())
    return [*classes, UND], logs


def _evidence(shared):
    """Weighted log-likelihoods of texts under every class, the posteriors by them alone, and whether there are words."""

    def make(texts: list[bytes | None]) -> dict:
        logs, sums, words = shared.value, [], []
        texts = [t or b"" for t in texts]
        for i, j in slices(texts, SLICE_BYTES // 4):
            hashed, first = trigram_buckets(texts[i:j])
            # one zero more, as the last texts may be empty
            some = np.stack([np.add.reduceat(np.append(row[hashed], np.float32(0)), first[:-1], dtype=np.float64) for row in logs], axis=1)
            some[first[1:] == first[:-1]] = 0.0
            sums.append(some)
            words += [bool(t.strip()) for t in texts[i:j]]
        told = np.concatenate(sums) * TEXT_WEIGHT if sums else np.zeros((0, len(logs)))
        told[:, -1] += np.log(UND_PRIOR)
        e = np.exp(told - told.max(axis=1, keepdims=True)) if len(told) else told
        return {"told": list(told), "post": list(e / e.sum(axis=1, keepdims=True)), "words": words}

    return make


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def identify(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, label: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns ``keep``) with lang_id, confidence, text_lang (by the text alone) and kept.

    ``label`` is the training label, by default what is declared.  Texts go to Python once, and only a few numbers a row come back.
    """
    none = F.lit(None).cast("string")
    text = F.col("text") if text is None else text
    declared, suffix, host = (none if c is None else c.cast("string") for c in (declared, suffix, host))
    label = declared if label is None else label
    new = ("lang_id", "confidence", "text_lang", "kept")
    rest = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # their columns in a struct, so that no name clashes with ours
    d = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none")).alias("row"), utf8(text).alias("t"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), label.alias("label"), docs[f"`{id_col}`"].alias("id"))
    classes, logs = fit(d.select("id", "label", F.coalesce("t", F.lit(b"")).alias("t")))
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # classes x BUCKETS
    n = len(classes)
    x = d.select("row", "declared", "suffix", "host", "t")
    x = cut(with_arrow(x, [F.col("t")], _evidence(shared), "told array<double>, post array<double>, words boolean").drop("t"), "evidence")

    sums = lambda by: x.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias("sums"))
    # reliability of declarations: P(declared | class), from (value, class) sums; at most classes + 1 values
    value = F.when(F.col("declared").isin(classes[:-1]), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), F.lit("?")))
    x = x.withColumn("value", value)
    said = dict(sums("value").collect())
    values = [*classes[:-1], "?"]
    table = np.array([said.get(v, [0.0] * n) for v in values]) + 0.5
    table = np.log(table / table.sum(axis=0))
    table[:, -1] = -np.log(len(values))
    say = F.create_map(*[e for v, row in zip(values, table.tolist(), strict=True) for e in (F.lit(v), F.array(*map(F.lit, row)))])
    nothing = F.array(*[F.lit(0.0)] * n)

    total = x.agg(*[F.sum(F.col("post")[i]) for i in range(n)]).first()
    prior = F.array(*[F.lit((float(c or 0.0) + 1.0) / (sum(float(c or 0.0) for c in total) + n)) for c in total])
    for level, used in (("suffix", suffix is not none), ("host", host is not none)):
        if not used:
            continue
        at = cut(sums(level).select(F.col(level).alias("at"), "sums"), "priors")
        few = (at.agg(F.sum(F.octet_length("at") + 8 * n + 64)).first()[0] or 0) <= BROADCAST_BYTES
        x = x.withColumn("prior", prior).join(F.broadcast(at) if few else at, F.col(level) == F.col("at"), "left")
        others = F.when(F.col("sums").isNotNull(), F.zip_with("sums", "post", lambda s, p: F.greatest(s - p, F.lit(0.0)))).otherwise(nothing)
        weight = F.aggregate(others, F.lit(SMOOTH), lambda a, v: a + v)
        x = x.withColumn("prior", F.zip_with(others, "prior", lambda c, p: (c + p * SMOOTH) / weight)).drop("at", "sums")
        prior = F.col("prior")
    whole = F.zip_with(F.zip_with("told", F.coalesce(say[F.col("value")], nothing), lambda a, b: a + b), prior, lambda a, p: a + F.log(p))
    x = x.withColumn("fused", _softmax(whole))
    names = F.array(*map(F.lit, classes))
    best = lambda c: names[F.array_position(c, F.array_max(c)).cast("int") - 1]
    x = x.withColumn("lang_id", best(F.col("fused"))).withColumn("confidence", F.round(F.array_max("fused"), 6)).withColumn("text_lang", best(F.col("post")))
    x = x.withColumn("kept", F.col("words") & (F.col("lang_id") != UND) & (F.col("confidence") >= MIN_CONFIDENCE))
    return x.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(rest)], *new)


def documents(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For rows of ``documents``: lang is what is declared, source stands for the host."""
    return identify(docs, declared=F.col("lang"), host=F.col("source"), keep=keep)


def markup_language(html: Column) -> Column:
    """What <html lang> declares, without its region; null where it says nothing."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1), F.lit("")))


def pages(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For rows of ``pages``: <html lang>, the host's last label and the host, and the text outside tags."""
    body = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>|&\w+;", " ")
    host = F.lower(F.nullif(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return identify(rows, "page_id", body, markup_language(F.col("html")), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")), host, keep=keep)


def op5(documents_table: DataFrame, pages_table: DataFrame | None = None) -> DataFrame:
    """A row per document (page_id null) and per page (doc_id null), each table with classes and priors of its own."""
    new = ["lang_id", "confidence", "text_lang", F.col("lang").alias("declared"), "kept"]
    found = documents(documents_table, ["doc_id", "lang"]).select("doc_id", F.lit(None).cast("bigint").alias("page_id"), *new)
    if pages_table is None:
        return found
    of_pages = pages(pages_table.select("page_id", "url", "html", markup_language(F.col("html")).alias("lang")), ["page_id", "lang"])
    return found.unionByName(of_pages.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), *new))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows whose language is told with confidence; all columns of docs stay as they are.

    Texts go to Python once and are dealt out once, to meet the ids that are kept; the tables on the way hold no texts.
    """
    seen = [F.coalesce(F.concat(F.lit("="), docs[f"`{c}`"].cast("string")), F.lit("")) for c in ("lang", "source")]
    seen.append(F.coalesce(docs["text"].cast("string"), F.lit("")))
    # rows that agree in these agree in the decision
    keyed = docs.select(key_or(docs["doc_id"]).alias("k"), F.xxhash64(*seen).alias("x"), F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"))
    facts = docs.select(key_or(docs["doc_id"]).alias("k"), F.xxhash64(*seen).alias("x"), docs["text"].alias("t"), docs["lang"], docs["source"])
    kept = identify(facts, "k", F.col("t"), F.col("lang"), None, F.col("source"), keep=["k", "x"]).where("kept").select("k", "x").distinct()
    return keyed.join(kept.hint("shuffle_hash"), ["k", "x"], "left_semi").select(*[F.col("whole")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
