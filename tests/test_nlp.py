"""Models and their features: against NumPy, golden literals, planted topics, and as parts of a job."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import jobs, nlp
from tidemark.sources import readers

GOOD, BAD, PLAIN = ["lovely", "great", "happy", "sunny"], ["awful", "broken", "angry", "rotten"], ["table", "report", "window", "paper"]


def sayings(n, seed):
    rng = np.random.default_rng(seed)
    kinds = {"positive": GOOD, "negative": BAD, "neutral": PLAIN}
    out = []
    for i in range(n):
        label = list(kinds)[i % 3]
        words = [*rng.choice(kinds[label], 4), *rng.choice(["the", "day", "was", "news", "from", "here"], 5)]
        rng.shuffle(words)
        out.append((f"p{i}", " ".join(words), label))
    return out


THEMES = [["election", "vote", "senate", "ballot", "border", "governor", "poll", "party"], ["football", "goal", "stadium", "coach", "league", "keeper", "corner", "season"]]


def themed(n, seed):
    """Texts of one theme each; a word stands in less than three of ten, as the vocabulary asks."""
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(THEMES[i % 2], 5))) for i in range(n)]


@pytest.fixture(scope="module")
def said(spark):
    return spark.createDataFrame(sayings(240, 1), "post_id string, text string, label string").cache()


@pytest.fixture(scope="module")
def model(said):
    return nlp.train_classifier(said.select("text", "label"), 1.0)


def test_sublinear_counts(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"], 30))) for i in range(50)]
    d = spark.createDataFrame(rows, "id int, text string").withColumns({"label": F.lit("x"), "weight": F.lit(1.0)})
    pipeline = nlp.Pipeline(stages=nlp._features(1000, 1.0, 2.0**62, bigrams=False)).fit(d)
    pipeline.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    vocabulary = again.stages[2].vocabulary
    tf = np.array([[t.split().count(w) for w in vocabulary] for _, t in rows], float)
    idf = np.log((len(rows) + 1) / ((tf > 0).sum(0) + 1))
    want = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    got = np.array([r["features"].toArray() for r in again.transform(d).orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-9
    plain = nlp._features(1000, 1.0, 2.0**62, sublinear=False)
    assert not any(isinstance(s, nlp.SublinearCounts) for s in plain)


@pytest.mark.parametrize("kind", ["logistic", "bayes"])
def test_classifiers(spark, said, model, kind):
    m = model if kind == "logistic" else nlp.train_classifier(said.select("text", "label"), kind=kind)
    new = spark.createDataFrame([(t, label) for _, t, label in sayings(60, 2)], "text string, label string")
    told = nlp.predict(m, new).withColumn("total", F.col("p_positive") + F.col("p_neutral") + F.col("p_negative")).collect()
    assert np.mean([r["predicted"] == r["label"] for r in told]) > 0.9
    assert all(abs(r["total"] - 1) < 1e-9 and abs(r["confidence"] - max(r["p_positive"], r["p_neutral"], r["p_negative"])) < 1e-12 for r in told)
    assert nlp.classes(m) == ["negative", "neutral", "positive"]


def test_model_selection(said):
    train, rest = said.where("cast(substr(post_id, 2) as int) % 4 > 0"), said.where("cast(substr(post_id, 2) as int) % 4 = 0")
    c, best = nlp.select_model(train.select("text", "label"), rest.select("text", "label"), (0.001, 1.0))
    scores = {x: nlp.metrics(nlp.predict(nlp.train_classifier(train.select("text", "label"), x), rest)).first()["macro_f1"] for x in (0.001, 1.0)}
    assert scores[c] == max(scores.values()) and nlp.metrics(nlp.predict(best, rest)).first()["macro_f1"] == max(scores.values())


def test_topics_are_found_and_assigned(spark):
    docs = spark.createDataFrame(themed(300, 5), "id int, text string")
    model, listed = nlp.fit_topics(docs, "en", 2, iterations=60)
    own = nlp.assign_topics(model, docs, "en")
    by = own.groupBy((F.col("id") % 2).alias("theme"), "topic_id").agg(F.count("*").alias("n")).collect()
    best = {t: max((r["n"], r["topic_id"]) for r in by if r["theme"] == t) for t in (0, 1)}
    assert best[0][0] + best[1][0] > 270 and best[0][1] != best[1][1]
    assert {r["topic_id"] for r in listed.collect()} == {"en-00", "en-01"} and all(len(r["top_terms"]) == 12 for r in listed.collect())
    assert all(r["topic_id"] == "en-other" for r in nlp.assign_topics(model, docs, "en", least=1.1).limit(3).collect())


# -- lexicon


def lexicon_score(spark, text):
    words = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("great", 3.1)], "word string, valence double")
    posts = spark.createDataFrame([("1", text)], "post_id string, clean_text string")
    r = nlp.lexicon_sums(posts, words).collect()
    return r[0]["s"] if r else None


@pytest.mark.parametrize(("text", "want"), [
    ("a good day", 1.9), ("Good, great!", 5.0), ("nothing here", None), ("", None), (None, None),
    ("very good", 1.9 + 0.293), ("very, um good", 1.9 + 0.293 * 0.95), ("very um um good", 1.9 + 0.293 * 0.9), ("very um um um good", 1.9), ("slightly bad", -2.5 + 0.293), ("really very good", 1.9 + 0.293 * 1.95),
    ("not good", 1.9 * -0.74), ("isn't so bad", (-2.5 - 0.293) * -0.74), ("never was a good", 1.9 * -0.74), ("not one two three good", 1.9), ("not never good", 1.9 * -0.74),
    ("GOOD day", 1.9 + 0.733), ("BAD day", -2.5 - 0.733), ("GOOD DAY", 1.9), ("not GOOD day", (1.9 + 0.733) * -0.74),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5), ("but good", 1.9 * 1.5), ("good but", 1.9 * 0.5),
])
def test_lexicon_rules(spark, text, want):
    got = lexicon_score(spark, text)
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-9)


def test_lexicon_labels(spark):
    words = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    posts = spark.createDataFrame([("1", "good"), ("2", "not good"), ("3", "plain"), ("4", None)], "post_id string, clean_text string")
    got = {r["id"]: (r["label"], r["score"]) for r in nlp.lexicon_sentiment(posts, words).collect()}
    assert got == {"1": ("positive", round(1.9 / math.sqrt(1.9**2 + 15), 4)), "2": ("negative", round(-1.406 / math.sqrt(1.406**2 + 15), 4)), "3": ("neutral", 0.0), "4": ("neutral", 0.0)}


# -- keywords and jobs


def test_keywords_dont_depend_on_the_batch(spark):
    docs = spark.createDataFrame([(i, f"the border wall {'vote ' * (i % 4)} and the city{i % 5}", "en") for i in range(60)] + [(100, None, "en"), (101, "только слова", None)], "doc_id int, text string, lang string")
    seen = nlp.united(nlp.term_statistics(docs.where("doc_id < 30")).unionByName(nlp.term_statistics(docs.where("doc_id >= 30"))))
    whole = nlp.term_statistics(docs)
    assert sorted(map(repr, seen.collect())) == sorted(map(repr, whole.collect()))
    assert {(r["language"], r["df"]) for r in whole.where("term is null").collect()} == {("en", 61), ("unknown", 1)}
    words = lambda d, **o: {r["id"]: [] for r in d.select(F.col("doc_id").alias("id")).collect()} | {k: sorted((r["place"], r["term"], r["weight"]) for r in rows) for k, rows in _by_id(nlp.keywords(d, statistics=seen, **o)).items()}
    alone = docs.where("doc_id = 7")
    assert words(alone)[7] == words(docs)[7]
    stop = nlp.common_terms(seen, 0.9)
    assert {r["term"] for r in stop.collect()} == {"the", "border", "wall", "and", "city"}
    assert [t for _, t, _ in words(docs, stop_words=stop)[7]] == ["vote"]
    listed = nlp.stop_words(spark)
    assert {"the", "and"} <= {r["term"] for r in listed.where("language = 'en'").collect()} and not {"the"} & {t for _, t, _ in words(docs, stop_words=listed)[7]}


def by_definition(rows, top=5, stop=()):
    """(id, place): (term, weight) of (id, text), in plain Python; rows with one id are one text."""
    uses = {}
    for i, text in rows:
        uses.setdefault(i, Counter()).update(w for w in re.findall(r"[^\W\d_]{3,}", (text or "").lower()) if w not in stop)
    df, out = Counter(w for c in uses.values() for w in c), {}
    for i, c in uses.items():
        weights = {w: round((1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1), 6) for w, n in c.items()}
        out |= {(i, k): (w, weights[w]) for k, w in enumerate(sorted(weights, key=lambda w: (-weights[w], w))[:top], 1)}
    return out


def shuffled_rows(spark, run):
    """Rows that ``run`` writes to shuffles."""
    sc = spark.sparkContext
    none, store = sc._jvm.java.util.ArrayList(), sc._jsc.sc().statusStore()

    def told():
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        stages = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = told()
    run()
    return sum(n for k, n in told().items() if k not in before)


@pytest.mark.parametrize("known", [0, 9, 40, 1 << 17])
@pytest.mark.parametrize("twice", [False, True])
def test_keywords_by_the_definition(spark, monkeypatch, known, twice):
    """However few terms are weighed beside the texts: ties, repeated and null ids, texts without words."""
    monkeypatch.setattr(nlp, "KNOWN", known, raising=False)
    monkeypatch.setattr(nlp, "ROWS", 7, raising=False)
    rng = np.random.default_rng(8)
    words = [a + b + c for a in ("ba", "zé", "ko") for b in ("lu", "mi", "по") for c in ("r", "st", "на")]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=(p := 1 / np.arange(1, 28)) / p.sum()))) for i in range(60)]
    rows += [(100, None), (101, "a b 12"), (102, " ".join(words)), (103, " ".join(words))] + ([(3, "bazelu ko"), (None, "only once"), (None, "once more")] if twice else [])
    docs = spark.createDataFrame([(*r, "xx") for r in rows], "doc_id int, text string, lang string").repartition(3)
    for stop in ((), ("balur", "balust")):
        got = {(r["id"], r["place"]): (r["term"], r["weight"]) for r in nlp.keywords(docs, stop_words=stop).collect()}
        want = by_definition(rows, stop=stop)
        assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
        assert all(abs(w - want[k][1]) < 1.5e-6 for k, (_, w) in got.items())


def test_terms_of_texts_arent_shuffled(spark, tmp_path):
    """100 texts of 100 terms: fewer rows are shuffled than a text has terms, times the texts."""
    words = ["".join(chr(97 + i // k % 26) for k in (676, 26, 1)) for i in range(200)]
    spark.createDataFrame([(i, " ".join(words[(i * j) % 199] for j in range(100)), "xx") for i in range(100)], "doc_id int, text string, lang string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("m8_keywords", "m8_keywords_by_language"):
        assert shuffled_rows(spark, lambda: catalog.QUERIES[name](spark, str(tmp_path)).collect()) < 5000, name  # noqa: B023


def _by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append(r)
    return out


def test_a_job_with_models(spark, model, tmp_path):
    topics, _ = nlp.fit_topics(spark.createDataFrame(themed(300, 5), "id int, text string"), "en", 2, iterations=60)
    (tmp_path / "a.csv").write_text("id,text,created_at,language,author\n1,lovely happy great election vote the senate ballot governor,2016-01-01,English,ann\n2,awful rotten broken football the stadium goal coach league,2016-01-02,English,bob\n3,выборы выборы сегодня,2016-01-02,Russian,bob\n")
    (tmp_path / "b.csv").write_text("id,text,created_at,language,author\n4,awful angry the the the border election,2016-03-01,English,bob\n")
    root = str(tmp_path / "lake")
    jobs.run(spark, [str(tmp_path / "a.csv")], root, "j1", sentiment=model, topics={"en": topics})
    p = {r["post_id"]: r for r in jobs.posts(spark, root).collect()}
    assert (p["1"]["sentiment"]["label"], p["2"]["sentiment"]["label"], p["3"]["sentiment"]) == ("positive", "negative", None)
    assert p["1"]["sentiment"]["method"] == "tfidf_logreg" and 0 < p["1"]["sentiment"]["score"] <= 1 and -1 <= p["2"]["sentiment"]["score"] < 0
    assert p["1"]["topic"]["id"] != p["2"]["topic"]["id"] and p["3"]["topic"] is None and p["1"]["topic"]["method"] == "lda"
    assert "the" not in p["1"]["keywords"] and "election" in p["1"]["keywords"] and p["3"]["keywords"] is None
    cube = {(str(r["day"]), r["sentiment"]): r["posts"] for r in spark.read.parquet(f"{root}/rollups/daily_cube").collect()}
    assert cube["2016-01-01", "positive"] == 1 and cube["2016-01-02", "negative"] == 1 and cube["2016-01-02", "not_analyzed"] == 1
    before = jobs.terms(spark, root).where("term = 'election'").first()["df"]
    for _ in range(2):  # the same job again counts its terms once
        jobs.run(spark, [str(tmp_path / "b.csv")], root, "j2", sentiment=model, topics={"en": topics})
        assert (before, jobs.terms(spark, root).where("term = 'election'").first()["df"]) == (1, 2)
    p = {r["post_id"]: r for r in jobs.posts(spark, root).collect()}
    assert p["4"]["sentiment"]["label"] == "negative" and "the" not in p["4"]["keywords"]


def test_preview(spark, tmp_path):
    (tmp_path / "x2.jsonl").write_text("".join(f'{{"id": {i}, "text": "t{i}"}}\n' for i in range(30)))
    (tmp_path / "x1.csv").write_text("id,text\na,first\nb,second\n")
    raw = readers.read(spark, [str(tmp_path)])
    got = readers.preview(raw, 5).collect()
    assert [r["rec"] for r in got] == ['{"id":"a","text":"first"}', '{"id":"b","text":"second"}', '{"id": 0, "text": "t0"}', '{"id": 1, "text": "t1"}', '{"id": 2, "text": "t2"}']
    for bad in (0, 51):
        with pytest.raises(ValueError):
            readers.preview(raw, bad)


def test_records_are_parsed_once(spark, tmp_path):
    from tidemark.operators import ingest

    (tmp_path / "x.jsonl").write_text('{"id": 1, "text": "t", "created_at": "2016-01-01"}\n')
    rows = ingest.folded(ingest.normalise(readers.read(spark, [str(tmp_path)])))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 and "get_json_object" not in plan, plan


def test_counts_are_those_of_mllib(spark):
    """The vocabulary of Counts against CountVectorizer's own, with its bounds; the tasks of its shuffle aren't bound to the cores."""
    rows = [(["a", "b", "a"],), (["a", "c", "d"],), (["a", "b", "d", "d"],), (["e"],), ([],)]
    d = spark.createDataFrame(rows, "words array<string>")
    for terms, least, most in ((10, 1.0, 2.0**62), (10, 2.0, 0.5), (2, 1.0, 2.0**62), (10, 0.4, 3.0)):
        own = nlp.Counts(inputCol="words", outputCol="n", terms=terms, min_df=least, max_df=most).fit(d)
        want = nlp.CountVectorizer(inputCol="words", outputCol="n", vocabSize=terms, minDF=least, maxDF=most).fit(d)
        assert set(own.vocabulary) == set(want.vocabulary), (terms, least, most)
        assert [sorted(r["n"].values) for r in own.transform(d).collect()] == [sorted(r["n"].values) for r in want.transform(d).collect()]
