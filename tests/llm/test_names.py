"""Columns of a user may have any name: the operators' helpers, their results in another case, dots and spaces."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, counts, jaccard, langid, lm, media, mixing, quality, replay, substring, urlfilter, warc, yinyang

HELPERS = [
    "k", "x", "t", "row", "whole", "none", "made", "gone", "label", "component", "bits", "part", "content", "c0", "h", "s", "st", "en", "seg", "segment", "hit", "fetched_", "prior", "value", "sums", "told", "post",
    "__k", "__x", "__t", "__gk", "__gx", "__gone", "__made", "__hit", "__segment", "a.b", "with space", "_known", "id", "n", "v", "bucket", "size", "copies",
]
RESULTS = [
    "N_WORDS", "N_REMOVED", "KEPT_SHA256", "KEPT_TEXT", "KEPT", "LANG_ID", "Confidence", "Text_Lang", "MEDIA", "N_BYTES", "N_TOKENS", "IDS_SHA256", "DECODED_SHA256", "FAIL_BITS", "N_Dup_Lines",
    "COMPONENT_ID", "N_SHINGLES", "TAKEN", "Target", "N_CHARS_", "WIDTH", "Deltas", "HOST", "BLOCKED", "LIST", "Pattern", "IDS", "DECODED", "payload", "PAYLOAD_BYTES", "record_TYPE",
]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, f"{'alpha beta gamma delta ' * 12} number {i % 4}", "en", f"s{i % 2}", 5) for i in range(12)] + [(12, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate([*HELPERS, *RESULTS])]).cache()


def whole(df, path):
    """It has no two names that Parquet holds for one, and can be written and read."""
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def users_columns(df, given):
    """The user's columns that are left keep their values."""
    own = [n for n in HELPERS if n in df.columns]
    want = {n: i for i, n in enumerate(HELPERS)}
    assert own and all(r[n] == want[n] for r in df.select(*[f"`{n}`" for n in own]).collect() for n in own)
    return own


@pytest.mark.parametrize("f", [
    lambda d: substring.remove_repeats(d), lambda d: langid.documents(d), lambda d: bpe.encode(d), lambda d: bpe.digests(d), lambda d: media.store_media(d),
    lambda d: media.read_media(media.store_media(d)), lambda d: quality.ledger(d), lambda d: counts.prefix_counts(d),
    lambda d: urlfilter.judge(d.withColumns({"url": F.lit("http://x.com/en"), "fetched": F.current_timestamp()}), d.sparkSession.createDataFrame([("a", "x.com", "block", "add")], "list string, pattern string, verdict string, action string").withColumn("since", F.to_timestamp(F.lit("2020-01-01")))),
], ids=["remove_repeats", "documents", "encode", "digests", "store_media", "read_media", "ledger", "prefix_counts", "judge"])
def test_functions_keep_columns(crowded, tmp_path, f):
    out = whole(f(crowded), str(tmp_path / "out"))
    assert out.count() == 13 and len(users_columns(out, crowded)) == len(HELPERS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, crowded, tmp_path, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, crowded, "")
    if name != "tokenize":
        assert out.columns == crowded.columns
        users_columns(whole(out, str(tmp_path / "out")), crowded)
    else:
        assert whole(out, str(tmp_path / "out")).count() == 13


@pytest.mark.parametrize("f", [substring.op2, lm.op3, mixing.op4, langid.op5, jaccard.op7, bpe.op8, media.op9, quality.op10, counts.op11], ids=lambda f: f.__name__)
def test_queries_take_any_columns(crowded, tmp_path, f):
    assert whole(f(crowded), str(tmp_path / "out")).count() == 13


def test_other_queries_take_any_columns(spark, crowded, tmp_path):
    extra = [F.lit(i).alias(n) for i, n in enumerate([*HELPERS, *[r for r in RESULTS if r != "HOST"]])]
    pages = spark.createDataFrame([(1, "http://a.com./x", "<p>a"), (2, None, None)], "page_id bigint, url string, html string").select("*", *extra)
    assert whole(warc.op1(pages), str(tmp_path / "1")).count() == 2
    assert {r["host"] for r in whole(urlfilter.op6(pages), str(tmp_path / "6")).collect()} == {"a.com", None}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").select("*", *extra)
    assert whole(replay.op13(crowded, labels), str(tmp_path / "13")).count() == 1800
    vectors = spark.createDataFrame([(i, [float(i)] * 64) for i in range(5)], "vec_id bigint, embedding array<double>").select("*", *extra)
    assert whole(yinyang.op12(vectors), str(tmp_path / "12")).count() == 5
