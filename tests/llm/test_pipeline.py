"""The pipeline's stages against brute force, and the registered queries against their SQL."""

import collections

import pytest
from compare import assert_same
from test_operators import brute_components, brute_windows, find

import corpus_pipeline
from tidemark.llm import mixing, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def test_stages(spark, docs, rows, tmp_path):
    texts = {i: t for i, t in rows}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "mixing", "tokenize"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language_id"](spark, docs, "")
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and all(find(texts[i]) for i in ids)
    assert {i for i, t in texts.items() if len(find(t)) > 30} <= ids

    near = stage["near_duplicates"](spark, kept, "")
    comps = brute_components([(i, texts[i]) for i in ids], 5, 80)
    left = {r["doc_id"] for r in near.collect()}
    assert near.columns == docs.columns and left == {i for i, (_, c) in comps.items() if c == i}

    cut = stage["repeated_passages"](spark, near, "")
    want = {i: w for i, w in brute_windows([(i, texts[i]) for i in left]).items() if w[1] == 0 or w[1] < w[0]}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and set(got) == set(want)
    assert all(len(find(got[i])) == want[i][0] - want[i][1] for i in got)

    mixed = stage["mixing"](spark, cut, "")
    copies = {r["doc_id"]: r["copies"] for r in mixing.op4(cut).collect()}
    assert mixed.columns == docs.columns and collections.Counter(r["doc_id"] for r in mixed.collect()) == {i: c for i, c in copies.items() if c}
    assert stage["tokenize"](spark, mixed, "").count() == mixed.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty_tables(spark, empty):
    out = empty
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0
