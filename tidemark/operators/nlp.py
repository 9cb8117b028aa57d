"""Sentiment, topics and keywords on MLlib and SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import factors
from tidemark.schema import SENTIMENTS
from tidemark.session import shared_dir
from tidemark.sources import sinks


def _features(terms: int, min_df: float, max_df: float, bigrams: bool = True, sublinear: bool = True) -> list:
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False)
    stages: list = [words]
    if bigrams:
        stages += [NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]
    else:
        stages += [SQLTransformer(statement="SELECT *, words AS terms FROM __THIS__")]
    counts = Counts(inputCol="terms", outputCol="counts", terms=terms, min_df=min_df, max_df=max_df)
    return [*stages, counts, *([SublinearCounts(inputCol="counts", outputCol="damped")] if sublinear else []), IDF(inputCol="damped" if sublinear else "counts", outputCol="features")]


class Counts(Estimator, HasInputCol, HasOutputCol):
    """CountVectorizer, with the terms counted in a shuffle whose tasks follow its size: MLlib's own count has as many tasks as there are cores, however long the texts.

    ``min_df`` and ``max_df`` are numbers of texts from 1 on, else shares; among terms that are used as often, those first in order are kept.
    """

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, terms: int = 1 << 18, min_df: float = 1.0, max_df: float = 2.0**62):  # noqa: N803  MLlib's names
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None and k in ("inputCol", "outputCol")})
        self.terms, self.min_df, self.max_df = terms, min_df, max_df

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        spark = dataset.sparkSession
        n = dataset.count() if min(self.min_df, self.max_df) < 1 else 0
        least, most = (x if x >= 1 else x * n for x in (self.min_df, self.max_df))
        kept = f"{shared_dir(spark)}/tidemark-terms-{uuid.uuid4().hex}"
        factors.term_counts(dataset, self.getInputCol()).where((F.col("df") >= least) & (F.col("df") <= most)).write.parquet(kept)
        chosen = factors.commonest(spark.read.parquet(kept), self.terms).select(F.array("term").alias(self.getInputCol()))
        model = CountVectorizer(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), vocabSize=self.terms).fit(chosen)  # ``terms`` rows of one term
        sinks.delete(spark, [kept])
        return model


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts n of a sparse vector as 1 + ln n, batch by batch; a stage that is saved and loaded with its pipeline."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):  # noqa: N803  MLlib's names
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        damp = F.udf(lambda v: Vectors.sparse(v.size, v.indices, 1.0 + np.log(v.values)), VectorUDT())
        return dataset.withColumn(self.getOutputCol(), damp(F.col(self.getInputCol())))


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weights that give every class the same total."""
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    whole = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(n.crossJoin(whole)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def train_classifier(rows: DataFrame, c: float = 1.0, kind: str = "logistic", terms: int = 300_000, sublinear: bool = True) -> PipelineModel:
    """From (text, label): word and pair TF-IDF with a balanced logistic regression or naive Bayes.

    ``c`` weighs the rows' losses against the penalty, so the penalty of the mean loss is 1 / (c rows); it is that of the weights
    themselves, so features aren't standardised.  Counts n in a text are 1 + ln n (``sublinear``).
    """
    index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="error")
    if kind == "logistic":
        last = LogisticRegression(labelCol="target", weightCol="weight", regParam=1.0 / (c * max(1, rows.count())), maxIter=50, standardization=False)
    else:
        last = NaiveBayes(labelCol="target", smoothing=0.5)
    return Pipeline(stages=[*_features(terms, 2.0, 0.9, sublinear=sublinear), index, last]).fit(balanced(rows))


def classes(model: PipelineModel) -> list[str]:
    return next(s.labelsArray[0] for s in model.stages if hasattr(s, "labelsArray"))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with predicted, confidence and the probability of each class as p_<class>."""
    names = classes(model)
    out = rows
    for s in model.stages:
        if not hasattr(s, "labelsArray"):
            out = s.transform(out)
    p = vector_to_array("probability")
    out = out.withColumn("__p", p).withColumn("predicted", F.array(*map(F.lit, names))[F.col("prediction").cast("int")])
    out = out.withColumn("confidence", F.array_max("__p")).withColumns({f"p_{n}": F.col("__p")[i] for i, n in enumerate(names)})
    return out.select(*rows.columns, "predicted", "confidence", *[f"p_{n}" for n in names])


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def metrics(predicted: DataFrame) -> DataFrame:
    """Per label precision, recall and F1, and on every row accuracy and macro averages."""
    c = confusion(predicted)
    right = c.where("label = predicted").select("label", F.col("n").alias("hit"))
    truth = c.groupBy("label").agg(F.sum("n").alias("support"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    m = truth.join(right, "label", "left").join(said, "label", "left").fillna(0, ["hit", "said"])
    m = m.withColumn("precision", F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))).withColumn("recall", F.try_divide("hit", "support"))
    m = m.withColumn("f1", F.try_divide(F.lit(2.0) * F.col("hit"), F.col("said") + F.col("support")))
    w = Window.partitionBy()
    return m.withColumn("accuracy", F.sum("hit").over(w) / F.sum("support").over(w)).withColumn("macro_f1", F.avg("f1").over(w)).withColumn("macro_recall", F.avg("recall").over(w))


def select_model(train: DataFrame, validation: DataFrame, grid: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0)) -> tuple[float, PipelineModel]:
    """The regularisation with the best macro-F1 on validation rows."""
    best = (-1.0, grid[0], None)
    for c in grid:
        model = train_classifier(train, c)
        score = metrics(predict(model, validation)).first()["macro_f1"]
        best = max(best, (score, c, model), key=lambda x: x[0])
    return best[1], best[2]


def sentiment_column(predicted: DataFrame, method: str = "tfidf_logreg") -> Column:
    """The posts model's sentiment from class probabilities: score is P(positive) - P(negative)."""
    return F.struct(F.col("predicted").alias("label"), F.round(F.col("p_positive") - F.col("p_negative"), 4).alias("score"), F.round("confidence", 4).alias("confidence"), F.lit(method).alias("method"))


#: Words that turn what follows within three words, and words that strengthen or weaken it (fixed values, English).
NEGATIONS = ("not", "no", "never", "nor", "neither", "nothing", "none", "nobody", "nowhere", "without", "cannot", "cant", "dont", "isnt", "wasnt", "wont", "hardly", "rarely", "seldom", "despite")
BOOSTERS = {
    **dict.fromkeys(("very", "really", "extremely", "absolutely", "completely", "totally", "incredibly", "especially", "highly", "hugely", "so", "most", "remarkably", "deeply", "utterly"), 0.293),
    **dict.fromkeys(("slightly", "somewhat", "barely", "partly", "marginally", "occasionally", "almost", "scarcely", "less", "little"), -0.293),
}
#: Rule constants (fixed values): words in capitals, a booster's weight by distance, negation, and what stands before and after a "but".
CAPITALS, BY_DISTANCE, NEGATED, BEFORE_BUT, AFTER_BUT = 0.733, (1.0, 0.95, 0.9), -0.74, 0.5, 1.5


def lexicon_sums(posts: DataFrame, lexicon: DataFrame, id_col: str = "post_id", text_col: str = "clean_text", negations: tuple[str, ...] = NEGATIONS, boosters: dict[str, float] = BOOSTERS, but: str = "but") -> DataFrame:
    """(id, hits, s): the sum of the valences of a text's words, by rules in this order.

    A word in capitals counts more, unless the whole text is in capitals; boosters among the three words before it strengthen or
    weaken it, less with distance; one negation there (or a word in n't) turns it; what stands before the first ``but`` counts half, what
    stands after it one and a half times.  ``lexicon`` is a table of (word, valence), a word once.
    """
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(r"(?U)[\w']+"), 0)
    t = posts.select(F.col(id_col).alias("id"), tokens.alias("w")).withColumn("low", F.transform("w", F.lower))
    is_capital = lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)
    t = t.withColumn("emphasis", F.exists("w", lambda x: (F.lower(x) == x) | ~is_capital(x))).withColumn("but_at", F.array_position("low", but))
    # what a word's rules need goes with it, so that only words of the lexicon are kept and nothing is looked up again
    at = F.transform("w", lambda x, i: F.struct(
        F.lower(x).alias("word"), (is_capital(x) & F.col("emphasis")).alias("capital"), F.reverse(F.slice("low", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))).alias("before"),
        F.when(F.col("but_at") == 0, 1.0).when(i + 1 < F.col("but_at"), BEFORE_BUT).when(i + 1 > F.col("but_at"), AFTER_BUT).otherwise(1.0).alias("clause"),
    ))
    each = t.select("id", F.explode(at).alias("x")).select("id", "x.*").join(lexicon, "word")
    v, sign = F.col("valence").cast("double"), F.signum(F.col("valence").cast("double"))
    v = v + F.when(F.col("capital"), sign * CAPITALS).otherwise(0.0)
    known = F.create_map(*[F.lit(y) for kv in boosters.items() for y in kv]) if boosters else None
    for d, weight in enumerate(BY_DISTANCE):
        if known is not None:
            v = v + sign * F.coalesce(F.try_element_at(known, F.get("before", F.lit(d))), F.lit(0.0)) * weight
    turned = F.exists("before", lambda x: x.isin(*negations) | x.endswith("n't"))
    v = F.when(turned, v * NEGATED).otherwise(v) * F.col("clause")
    return each.select("id", v.alias("v")).groupBy("id").agg(F.count("*").alias("hits"), F.sum("v").alias("s"))


def lexicon_sentiment(posts: DataFrame, lexicon: DataFrame, id_col: str = "post_id", text_col: str = "clean_text", **rules) -> DataFrame:
    """(id, label, score) by lexicon_sums(): the sum s as s / sqrt(s^2 + 15)."""
    s = posts.select(F.col(id_col).alias("id")).distinct().join(lexicon_sums(posts, lexicon, id_col, text_col, **rules), "id", "left")
    score = F.round(F.coalesce(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), F.lit(0.0)), 4)
    return s.select("id", F.when(score >= 0.05, SENTIMENTS[0]).when(score <= -0.05, SENTIMENTS[2]).otherwise(SENTIMENTS[1]).alias("label"), score.alias("score"))


#: Words of keywords in any alphabet: three letters or more, marks included.
TERM = r"\p{L}[\p{L}\p{M}]{2,}"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def term_statistics(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(language, term, df): in how many texts a term stands; the row of the null term has the number of texts.

    Statistics of parts add up (``united``), so a job stores those of its own posts only.
    """
    d = docs.select(F.coalesce(F.col(lang_col), F.lit("unknown")).alias("language"), F.array_distinct(terms_of(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    each = d.select("language", F.explode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("term"))
    return each.groupBy("language", "term").agg(F.count("*").alias("df"))


def united(statistics: DataFrame) -> DataFrame:
    return statistics.groupBy("language", "term").agg(F.sum("df").alias("df"))


def common_terms(statistics: DataFrame, share: float = 0.3, least: int = 20) -> DataFrame:
    """(language, term) of the terms in more than a share of a language's texts, where it has ``least`` of them: its stop words by count."""
    docs = statistics.where("term is null").select("language", F.col("df").alias("docs"))
    return statistics.where("term is not null").join(docs, "language").where((F.col("docs") >= least) & (F.col("df") > share * F.col("docs"))).select("language", "term")


def stop_words(spark: SparkSession, languages: dict[str, str] | None = None) -> DataFrame:
    """(language, term) of the stop words that MLlib brings, by language code."""
    known = languages or {"en": "english", "ru": "russian", "de": "german", "fr": "french", "es": "spanish"}
    rows = [(code, w) for code, name in known.items() for w in sorted({*StopWordsRemover.loadDefaultStopWords(name), "rt", "amp", "via"})]
    return spark.createDataFrame(rows, "language string, term string")


#: Terms whose weights are told where the texts are read (the others are looked up in a shuffle), rows that are weighed at a time, and how far
#: apart weights must be for their order to hold after rounding.
KNOWN, ROWS, APART = 1 << 17, 1000, 2e-6


def _said(d: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(id, language, said: an array of term and uses) of (id, language, text).

    A term may stand there more than once.  Rows that share id and language become one; only such rows are shuffled.
    """
    terms = terms_of(F.coalesce(F.col("text"), F.lit("")))
    terms = F.filter(terms, lambda t: ~t.isin(*without)) if without else terms
    own = lambda rows: rows.select("id", "language", F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).cast("bigint").alias("uses"))).alias("said"))
    again = d.groupBy("id", "language").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("language").alias("_language"))
    if again.isEmpty():
        return own(d)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("language") == F.col("_language"))
    each = own(d.join(again, same, "left_semi")).select("id", "language", F.inline("said")).groupBy("id", "language", "term").agg(F.sum("uses").alias("uses"))
    return own(d.join(again, same, "left_anti")).unionByName(each.groupBy("id", "language").agg(F.collect_list(F.struct("term", "uses")).alias("said")))


def _commonest(df: DataFrame, most: int) -> DataFrame:
    """The terms of a stored (language, term, df) from the least df on that no more than ``most`` of them have."""
    least = None
    for r in df.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).collect():  # a row per number of texts: few, as they add up to all uses
        most -= r["n"]
        if most < 0:
            break
        least = r["df"]
    return df.where(F.lit(False) if least is None else F.col("df") >= least)


def _leading(known: list[Row], top: int):
    """Rows (id, language, term, tf, known) from (id, language, said): of the known terms those that may be among a text's ``top``, with their df, and all others."""
    names = pa.array([f"{r['term']} {r['language']}" for r in known], pa.string())  # KNOWN rows at most; no term has a space
    df, idf, stop = (np.array([r[c] for r in known], kind) for c, kind in (("df", np.int64), ("idf", float), ("stop", bool)))

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        said, language = b.column("said"), b.column("language").dictionary_encode()
        flat, n = said.flatten(), max(len(language.dictionary), 1)
        terms = flat.field("term").dictionary_encode()
        words = max(len(terms.dictionary), 1)
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(said).to_numpy(zero_copy_only=False))
        cells, at = np.unique(row * words + terms.indices.to_numpy(), return_inverse=True)
        tf = np.bincount(at, flat.field("uses").to_numpy(), len(cells))
        row, code = np.divmod(cells, words)
        pairs, at = np.unique(code * n + language.indices.to_numpy()[row], return_inverse=True)
        called = pc.binary_join_element_wise(terms.dictionary.take(pa.array(pairs // n)), language.dictionary.take(pa.array(pairs % n)), " ")
        place = pc.fill_null(pc.index_in(called, value_set=names), -1).to_numpy()[at]
        rest = np.flatnonzero(place < 0)
        i = np.flatnonzero(place >= 0)
        i = i[~stop[place[i]]]
        weight = (1 + np.log(tf[i])) * idf[place[i]]
        order = np.empty(words, np.int64)
        order[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(terms.dictionary))
        o = np.lexsort((order[code[i]], df[place[i]], -weight, row[i]))
        i, weight = i[o], weight[o]
        if len(i):
            spot = np.arange(len(i))
            begins = np.concatenate([[True], np.diff(row[i]) != 0])
            first = np.maximum.accumulate(np.where(begins, spot, 0))  # where its text begins
            last = np.minimum(first + top - 1, len(i) - 1)
            least = np.where(row[i][last] == row[i], weight[last], -np.inf)  # the weight of the text's place ``top``
            begins[1:] |= (np.diff(weight) != 0) | (np.diff(df[place[i]]) != 0)
            alike = spot - np.maximum.accumulate(np.where(begins, spot, 0))  # terms of the same uses and df before it
            i = i[(alike < top) & (weight >= least - APART)]
        out = np.concatenate([i, rest])
        told = pa.array(np.concatenate([df[place[i]], np.zeros(len(rest), np.int64)]), mask=np.arange(len(out)) >= len(i))
        columns = [b.column("id").take(pa.array(row[out])), b.column("language").take(pa.array(row[out])), terms.dictionary.take(pa.array(code[out])), pa.array(tf[out].astype(np.int64)), told]
        return pa.RecordBatch.from_arrays(columns, names=["id", "language", "term", "tf", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from (of(b.slice(i, ROWS)) for i in range(0, b.num_rows, ROWS))

    return run


def keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 5, stop_words: tuple[str, ...] | DataFrame = (), statistics: DataFrame | None = None, lang_col: str = "lang") -> DataFrame:
    """(id, term, weight, place): the terms with the largest (1 + ln tf)(ln((1 + n) / (1 + df)) + 1) of each text.

    df and n are those of ``docs`` (kept in the shared folder), or by language those of stored ``statistics``: then a text has the same keywords in
    whatever batch it comes; a term that they don't have counts as in no text.  ``stop_words`` are left out (a table of (language, term), or some terms).
    A text's terms aren't shuffled: the commonest ones (KNOWN) are weighed beside the text and all but the heaviest of them go; the rarer ones,
    each in few texts, are joined with their df.
    """
    spark, listed = docs.sparkSession, isinstance(stop_words, DataFrame)
    language = F.coalesce(F.col(lang_col), F.lit("unknown")) if statistics is not None or listed else F.lit("")
    d = docs.select(F.col(id_col).alias("id"), language.alias("language"), F.col(text_col).alias("text"))
    said = _said(d, () if listed else stop_words)
    if statistics is None:
        kept = f"{shared_dir(spark)}/tidemark-terms-{uuid.uuid4().hex}"
        each = said.select("language", F.explode(F.array_distinct("said.term")).alias("term"))
        each.groupBy("language", "term").agg(F.count("*").alias("df")).write.parquet(kept)
        df, n = spark.read.parquet(kept), d.groupBy("language").agg(F.count("*").alias("docs"))
    else:
        df, n = statistics.where("term is not null").select("language", "term", "df"), statistics.where("term is null").select("language", F.col("df").alias("docs"))
    n = F.broadcast(n)  # a row per language
    stop = stop_words.select("language", "term").distinct() if listed else spark.createDataFrame([], "language string, term string")
    idf = F.log((1.0 + F.coalesce("docs", F.lit(0))) / (1.0 + F.coalesce("df", F.lit(0)))) + 1
    known = _commonest(df, KNOWN).join(n, "language", "left").join(stop.withColumn("stop", F.lit(True)), ["language", "term"], "left")
    known = known.select("language", "term", "df", idf.alias("idf"), F.col("stop").isNotNull().alias("stop")).collect()  # KNOWN rows at most
    fields = T.StructType([d.schema["id"], *T._parse_datatype_string("language string, term string, tf bigint, known bigint")])
    w = said.mapInArrow(_leading(known, top), fields)
    # known terms have a key of their text that no term is like, so that none of them is looked up, and no common one is in a single task
    asked = F.when(F.col("known").isNull(), F.col("term")).otherwise(F.concat(F.lit(" "), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    w = w.withColumn("asked", asked).join(df.withColumnRenamed("term", "asked"), ["language", "asked"], "left")
    if listed:
        w = w.join(stop.withColumnRenamed("term", "asked"), ["language", "asked"], "left_anti")
    w = w.withColumn("df", F.coalesce("known", "df")).join(n, "language", "left")
    w = w.select("id", "term", F.round((1 + F.log("tf")) * idf, 6).alias("weight"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "term"))
    return w.withColumn("place", place).where(F.col("place") <= top)


def fit_topics(docs: DataFrame, language: str, k: int, terms: int = 50_000, seed: int = 42, iterations: int = 20, stop_words: list[str] | None = None) -> tuple[PipelineModel, DataFrame]:
    """A topic model of (text) and its topics (topic_id, language, label, top_terms)."""
    words = RegexTokenizer(inputCol="text", outputCol="raw_words", pattern=r"(?U)\b\p{L}[\p{L}'-]{2,}\b", gaps=False)
    stop = StopWordsRemover(inputCol="raw_words", outputCol="words", stopWords=stop_words or [])
    pairs = [NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]
    counts = Counts(inputCol="terms", outputCol="features", terms=terms, min_df=2.0, max_df=0.3)
    model = Pipeline(stages=[words, stop, *pairs, counts, LDA(k=k, seed=seed, maxIter=iterations, optimizer="online")]).fit(docs.select("text"))
    vocabulary = model.stages[-2].vocabulary
    t = model.stages[-1].describeTopics(12)
    listed = docs.sparkSession.createDataFrame([(r["topic"], [vocabulary[i] for i in r["termIndices"]]) for r in t.select("topic", "termIndices").collect()], "topic int, top_terms array<string>")  # k rows
    label = F.array_join(F.transform(F.slice("top_terms", 1, 3), F.initcap), " / ")
    return model, listed.select(F.format_string(f"{language}-%02d", "topic").alias("topic_id"), F.lit(language).alias("language"), label.alias("label"), "top_terms")


def topics_by_language(docs: DataFrame, k: int, lang_col: str = "lang", method: str = "lda", **options) -> DataFrame:
    """The topics of a model (``lda``, or ``nmf``: a non-negative factorisation) for every language in the table (a handful): LDA one after the other, factorisations two at a time."""
    names = sorted(r[0] for r in docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().collect())
    of = lambda name: docs.where(F.col(lang_col) == name)
    if method == "nmf":
        with ThreadPoolExecutor(2) as pool:  # a step is a short job, so the other's tasks fill the cores
            parts = [m.listed(docs.sparkSession) for m in pool.map(lambda name: factors.fit(of(name), name, k, **options), names)]
    else:
        parts = [fit_topics(of(name), name, k, **options)[1] for name in names]
    return reduce(DataFrame.unionByName, parts)


def assign_topics(model: PipelineModel | factors.Topics, docs: DataFrame, language: str, least: float = 0.02) -> DataFrame:
    """docs with topic_id (the heaviest topic, ``<language>-other`` below ``least``) and topic_weight."""
    if isinstance(model, factors.Topics):
        return factors.assign(model, docs, least)
    x = model.transform(docs).withColumn("__w", vector_to_array("topicDistribution"))
    best = F.array_max("__w")
    name = F.when(best >= least, F.format_string(f"{language}-%02d", F.array_position("__w", best).cast("int") - 1)).otherwise(f"{language}-other")
    return x.withColumn("topic_id", name).withColumn("topic_weight", F.round(best, 4)).select(*docs.columns, "topic_id", "topic_weight")


def enrich(posts: DataFrame, sentiment: PipelineModel | None, topics: dict[str, PipelineModel | factors.Topics], reprocess: bool = False, statistics: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(post_id, sentiment, topic_id, keywords, processed_at) of unprocessed posts, to be joined by id.

    Sentiment is told for English, topics for the languages that have a model; keywords for both, by the stored ``statistics``
    (else those of the posts at hand) and without the words in ``stop``.
    """
    todo = (posts if reprocess else posts.where(~F.col("processed"))).select("post_id", "language", F.col("clean_text").alias("text"))
    base = todo.select("post_id")
    if sentiment is not None:
        s = predict(sentiment, todo.where("language = 'en'"))
        base = base.join(s.select("post_id", sentiment_column(s).alias("sentiment")), "post_id", "left")
    found = None
    for language, model in topics.items():
        part = assign_topics(model, todo.where(F.col("language") == language), language).select("post_id", "topic_id", "topic_weight")
        found = part if found is None else found.unionByName(part)
    if found is not None:
        base = base.join(found, "post_id", "left")
    kw = keywords(todo.where(F.col("language").isin("en", *topics)), "post_id", "text", stop_words=() if stop is None else stop, statistics=statistics, lang_col="language")
    terms = F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
    base = base.join(kw.groupBy(F.col("id").alias("post_id")).agg(terms.alias("keywords")), "post_id", "left")
    return base.withColumn("processed_at", F.current_timestamp())
