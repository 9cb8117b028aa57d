"""Topics by factorisation: against NumPy, planted topics, and any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors, nlp

THEMES = [["election", "vote", "senate", "ballot", "governor", "poll"], ["football", "goal", "stadium", "coach", "league", "keeper"], ["guitar", "drums", "concert", "album", "singer", "stage"], ["bread", "butter", "oven", "recipe", "flour", "sugar"]]


def themed(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join([*rng.choice(THEMES[i % 4], 6), *rng.choice(["from", "with", "about"], 1)])) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*themed(240, 1), (900, None), (901, ""), (902, "12 3")], "id int, text string").repartition(5).cache()


@pytest.fixture(scope="module")
def model(docs):
    return factors.fit(docs, "en", 4, steps=15)


def test_weights_and_steps_as_in_numpy(spark):
    texts = spark.createDataFrame([(i, t) for i, t in themed(60, 2)], "key bigint, text string")
    names, idf = factors.vocabulary(texts, 40)
    assert len(names) == 40 and names == sorted(names)
    rows = factors.weighted(texts, names, idf).cache()
    v = np.zeros((60, 40))
    for r in rows.collect():
        v[r["key"], r["terms"]] = r["weights"]
    split = {r["key"]: r["t"] for r in texts.select("key", factors.terms_of(F.col("text")).alias("t")).collect()}
    tf = np.array([[split[i].count(t) for t in names] for i in range(60)], float)
    want = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)
    assert np.abs(v - want).max() < 1e-12
    h, losses, state = factors.factorise(rows.repartition(3), 3, 40, steps=5, seed=7)
    hh, w, own = np.random.default_rng(7).uniform(0.1, 1.0, (3, 40)) / np.sqrt(40), np.full((60, 3), 1 / 3), []
    for i in range(6):
        for _ in range(factors.INNER):
            w = w * (v @ hh.T) / np.maximum(w @ (hh @ hh.T), factors.TINY)
        own.append(((v - w @ hh) ** 2).sum())
        if i < 5:
            hh = hh * (w.T @ v) / np.maximum(w.T @ w @ hh, factors.TINY)
    assert np.abs(h - hh).max() < 1e-9 and np.allclose(losses, own, atol=1e-9)
    last = {r["key"]: r["w"] for r in state.collect()}
    assert np.abs(np.array([last[i] for i in range(60)]) - w).max() < 1e-9


def test_planted_topics(spark, docs, model):
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:], strict=False)) and model.losses[-1] < 0.85 * model.losses[0]
    own = factors.assign(model, docs).collect()
    assert len(own) == 243 and {r["topic_id"] for r in own if r["id"] >= 900} == {"en-other"}
    by = {}
    for r in own:
        if r["id"] < 900:
            by.setdefault(r["id"] % 4, []).append(r["topic_id"])
    main = {t: max(set(x), key=x.count) for t, x in by.items()}
    assert len(set(main.values())) == 4 and np.mean([x == main[t] for t, xs in by.items() for x in xs]) > 0.9
    for t, topic in main.items():
        top = [w for w in model.top_terms(6)[int(topic[-2:])] if " " not in w]
        assert set(top) <= set(THEMES[t])


def test_any_partitioning_and_reload(spark, docs, model, tmp_path):
    again = factors.fit(docs.repartition(2), "en", 4, steps=15)
    assert again.top_terms(5) == model.top_terms(5) and np.allclose(again.losses, model.losses)
    model.save(spark, str(tmp_path / "m"))
    loaded = factors.Topics.load(spark, str(tmp_path / "m"), "en")
    key = lambda m: sorted(map(repr, factors.assign(m, docs.select("id", "text", F.lit(1).alias("key"), F.lit(2).alias("row"))).collect()))
    assert loaded.terms == model.terms and key(loaded) == key(model)
    assert [r["topic_id"] for r in model.listed(spark).orderBy("topic_id").collect()] == ["en-00", "en-01", "en-02", "en-03"]


def test_odd_tables(spark, docs):
    none = factors.fit(docs.where("id > 5000"), "en", 2, steps=1)
    assert none.terms == [] and none.top_terms() == [[], []]
    assert {r["topic_id"] for r in factors.assign(none, docs.limit(3)).collect()} == {"en-other"}


def test_enrichment_takes_these_topics(spark, model):
    posts = spark.createDataFrame([("1", "en", "vote senate election ballot", False), ("2", "en", "oven bread flour", False), ("3", "de", "vote", False)], "post_id string, language string, clean_text string, processed boolean")
    got = {r["post_id"]: r["topic_id"] for r in nlp.enrich(posts, None, {"en": model}).collect()}
    assert got["1"] != got["2"] and got["1"].startswith("en-0") and got["3"] is None


def test_terms_are_counted_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb bb dd"), (3, None), (4, "")], "key bigint, text string")
    counts = factors.term_counts(rows.select(factors.terms_of(F.regexp_replace("text", r"(\w)\w", "$1$1$1")).alias("t")), "t")
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # before it runs
    assert {(r["term"], r["uses"], r["df"]) for r in counts.collect() if " " not in r["term"]} == {("aaa", 2, 1), ("bbb", 3, 2), ("ccc", 1, 1), ("ddd", 1, 1)}
    weighed = factors.weighted(rows, ["aa"], np.ones(1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in weighed  # a text's weights are found where the text is


def test_commonest_sorts_only_what_may_be_kept(spark, tmp_path):
    spark.createDataFrame([(f"t{i:02}", 9 if i < 3 else 5 if i < 40 else 2) for i in range(90)], "term string, uses bigint").write.parquet(str(tmp_path / "c"))
    counts = spark.read.parquet(str(tmp_path / "c"))
    for n in (1, 3, 10, 40, 60, 90, 200):
        kept = factors.commonest(counts, n)
        assert [r["term"] for r in kept.collect()] == [f"t{i:02}" for i in range(min(n, 90))]
    assert "uses#" in factors.commonest(counts, 10)._jdf.queryExecution().executedPlan().toString() and "GreaterThanOrEqual(uses,5)" in factors.commonest(counts, 10)._jdf.queryExecution().executedPlan().toString()
