"""Topics as a non-negative factorisation of TF-IDF weights, on rows of texts.

A text is a row v of its terms' numbers and weights (1 + ln tf) idf, scaled to length 1.  The topics' matrix H (topics x terms, both
bounded by parameters) goes to all tasks.  In a step the topic weights w of every text are solved for H, and in the same pass each task sums
what the next H needs (w' v by term and w' w); the driver gets topics x terms numbers and solves H.  Both are least squares by coordinate
descent, so the loss never rises, and nothing of a text is kept from step to step: the rows are stored once and read in each pass.
H starts from the singular vectors (NNDSVDa); ``fit`` goes on until ten steps gain next to nothing.  A pass has as many tasks as there are
cores at most, so what is shuffled doesn't grow with the texts.

``factorise`` is the same problem by multiplicative updates for a given number of steps; its rows, with w, are written anew in each step.

Edge cases: null and empty texts and those without a term of the vocabulary have no weights and the topic "other"; rows that repeat an id
count and are told each; fewer terms than topics give topics that repeat or have no terms; an empty table gives topics without terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir
from tidemark.sources import sinks

#: Words of topics: three letters or more, with marks, apostrophes and hyphens inside.
WORD = r"(?U)\b\p{L}[\p{L}\p{M}'-]{2,}"
#: Multiplicative steps on a text's weights for each step on the topics.
INNER = 3
#: Sweeps of coordinate descent on the topics in a step, and on texts' weights at most (a few are enough).
SWEEPS, MOST_SWEEPS = 20, 1000
#: The start's passes over the rows, and the columns it has besides the topics'.
POWERS, EXTRA = 7, 10
#: Steps whose gain tells whether to go on.
WINDOW = 10
#: Cells (a text's terms) that are worth a task, and those that are in memory at a time.
TASK_CELLS, CELLS = 1 << 19, 1 << 18
TINY = 1e-12
_ROWS = "key bigint, terms array<int>, weights array<double>, w array<double>"
#: Rows of texts, and (with a place) a task's sums.
_STATE = f"{_ROWS}, place int, sums array<double>"


@dataclass
class Topics:
    """A fitted model: the vocabulary's terms with their idf, and the topics' weights of them."""

    language: str
    terms: list[str]
    idf: np.ndarray
    h: np.ndarray
    losses: list[float] = field(default_factory=list)

    def top_terms(self, n: int = 12) -> list[list[str]]:
        """Each topic's heaviest terms; ties go to the term that comes first.  The last digits of sums depend on the tasks, so nine digits count."""
        parts = [np.round(row / max(row.max(initial=0), TINY), 9) for row in self.h]
        return [[self.terms[i] for i in sorted(np.flatnonzero(row > TINY), key=lambda i: (-part[i], self.terms[i]))[:n]] for row, part in zip(self.h, parts, strict=True)]

    def listed(self, spark: SparkSession) -> DataFrame:
        """(topic_id, language, label, top_terms)."""
        rows = [(f"{self.language}-{i:02}", self.language, " / ".join(t.title() for t in top[:3]), top) for i, top in enumerate(self.top_terms())]
        return spark.createDataFrame(rows, "topic_id string, language string, label string, top_terms array<string>")

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table (term, idf, weights); a row per term."""
        rows = [(i, t, float(x), col.tolist()) for i, (t, x, col) in enumerate(zip(self.terms, self.idf, self.h.T, strict=True))]
        spark.createDataFrame(rows, "place int, term string, idf double, weights array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, language: str) -> Topics:
        rows = spark.read.parquet(path).orderBy("place").collect()  # a row per term of the vocabulary
        return cls(language, [r["term"] for r in rows], np.array([r["idf"] for r in rows]), np.array([r["weights"] for r in rows]).T)


def terms_of(text: Column) -> Column:
    """Words and pairs of neighbouring words, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    less = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, 1, less(w)), F.slice(w, 2, less(w)), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.array(words), lambda w: F.concat(w, pairs(w)))[0]  # the words are named once, so that they are found once


def term_counts(rows: DataFrame, terms: str) -> DataFrame:
    """(term, uses, df) of a column of arrays of terms: a term's first use in a row is marked there, so one shuffle counts both."""
    s = rows.select(F.sort_array(terms).alias("s"))
    each = s.select(F.inline(F.transform("s", lambda t, i: F.struct(t.alias("term"), (~F.get("s", i - 1).eqNullSafe(t)).alias("first")))))
    return each.groupBy("term").agg(F.count("*").alias("uses"), F.count_if("first").alias("df"))


def commonest(counts: DataFrame, terms: int) -> DataFrame:
    """The rows of the ``terms`` most used terms of a stored (term, uses, ...); ties go to the term that comes first.

    The least number of uses comes from a histogram, so that one task sorts those above it and ties only.
    """
    left, least = terms, 0
    for r in counts.groupBy("uses").agg(F.count("*").alias("n")).orderBy(F.desc("uses")).collect():  # a row per number of uses: few, as they add up to all uses
        left, least = left - r["n"], r["uses"]
        if left <= 0:
            break
    return counts.where(F.col("uses") >= least).orderBy(F.desc("uses"), "term").limit(terms)


def vocabulary(texts: DataFrame, terms: int, least: int = 2, share: float = 0.3, stop: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """The commonest ``terms`` terms of (text) with their idf, of those in ``least`` texts and at most a share of all."""
    n = texts.count()
    seen = term_counts(texts.select(terms_of(F.col("text")).alias("terms")), "terms").where((F.col("df") >= least) & (F.col("df") <= share * n))
    if stop is not None:
        seen = seen.join(stop.select("term").distinct(), "term", "left_anti")
    spark = texts.sparkSession
    kept = f"{shared_dir(spark)}/tidemark-terms-{uuid.uuid4().hex}"
    seen.write.parquet(kept)
    few = commonest(spark.read.parquet(kept), terms).select("term", "df").toArrow()  # ``terms`` rows
    rows = sorted(zip(*(few.column(c).to_pylist() for c in ("term", "df")), strict=True))
    sinks.delete(spark, [kept])
    return [t for t, _ in rows], np.array([np.log((1 + n) / (1 + df)) + 1 for _, df in rows])


def weighted(texts: DataFrame, terms: list[str], idf: np.ndarray) -> DataFrame:
    """(key, terms, weights) of the texts (key, text) that have a term of the vocabulary; numbers ascend, weights have length 1."""
    return texts.select("key", terms_of(F.col("text")).alias("said")).mapInArrow(_weigher(terms, idf), "key bigint, terms array<int>, weights array<double>")


def _weigher(terms: list[str], idf: np.ndarray):
    """Rows of weights from (key, said), a text at a time: nothing is shuffled."""
    known = pa.array(terms, pa.string())  # ``terms`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column("said")
            numbers = pc.index_in(said.flatten(), value_set=known)
            row = np.repeat(np.arange(b.num_rows), np.diff(said.offsets.to_numpy()))
            has = pc.is_valid(numbers).to_numpy(zero_copy_only=False)
            cells, tf = np.unique(row[has] * max(len(terms), 1) + pc.drop_null(numbers).to_numpy().astype(np.int64), return_counts=True)
            row, number = np.divmod(cells, max(len(terms), 1))
            x = (1 + np.log(tf)) * idf[number] if len(cells) else np.zeros(0)
            x = x / np.sqrt(np.bincount(row, x * x, b.num_rows))[row]
            size = np.bincount(row, minlength=b.num_rows)
            some = np.flatnonzero(size)
            at = pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (number.astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(some)), *lists], names=["key", "terms", "weights"])

    return run


def _fitted(w: np.ndarray, terms: np.ndarray, first: np.ndarray, weights: np.ndarray, h: np.ndarray, hh: np.ndarray, steps: int) -> np.ndarray:
    """Weights of some texts after some multiplicative steps; a text's terms begin at its ``first``."""
    vh = np.add.reduceat(weights[:, None] * np.ascontiguousarray(h.T)[terms], first, axis=0) if len(first) else np.zeros((0, len(h)))
    for _ in range(steps):
        w = w * vh / np.maximum(w @ hh, TINY)
    return w


def _arrays(b: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [b.column(n).flatten().to_numpy(zero_copy_only=False) for n in names]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _step(h: np.ndarray, steps: int):
    """Rows with the weights of texts after some steps."""
    hh = h @ h.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("terms"), b.column("weights"), _lists(_stepped(b, h, hh, steps)[0])], names=["key", "terms", "weights", "w"])

    return run


def _stepped(b: pa.RecordBatch, h: np.ndarray, hh: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's w after some steps, and its terms and weights."""
    terms, weights, w = _arrays(b, ("terms", "weights", "w"))
    first = b.column("terms").offsets.to_numpy()[:-1] - b.column("terms").offsets[0].as_py()
    return _fitted(w.reshape(b.num_rows, len(h)), terms, first, weights, h, hh, steps), terms, weights


def _step_and_sums(h: np.ndarray, steps: int, n_terms: int):
    """_step(), and after a task's rows its sums, k numbers a row: w' v by term (for terms it has), w' w in the places -1 to -k, and in -k-1 the sum of squares."""
    hh, k = h @ h.T, len(h)
    kinds = {"key": pa.int64(), "terms": pa.list_(pa.int32()), "weights": pa.list_(pa.float64()), "w": pa.list_(pa.float64()), "place": pa.int32(), "sums": pa.list_(pa.float64())}

    def whole(n: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wv, ww, square = np.zeros((n_terms, k)), np.zeros((k, k)), 0.0
        for b in batches:
            if not b.num_rows:
                continue
            w, terms, weights = _stepped(b, h, hh, steps)
            size = np.diff(b.column("terms").offsets.to_numpy())
            for j in range(k):
                wv[:, j] += np.bincount(terms, np.repeat(w[:, j], size) * weights, n_terms)
            ww += w.T @ w
            square += float(weights @ weights)
            yield whole(b.num_rows, key=b.column("key"), terms=b.column("terms"), weights=b.column("weights"), w=_lists(w))
        has = np.flatnonzero(wv.any(axis=1))
        rows = np.concatenate([wv[has], ww, np.full((1, k), square)])
        yield whole(len(rows), place=pa.array(np.concatenate([has, -1 - np.arange(k + 1)]).astype(np.int32)), sums=_lists(rows))

    return run


def factorise(rows: DataFrame, k: int, n_terms: int, steps: int = 20, seed: int = 42) -> tuple[np.ndarray, list[float], DataFrame]:
    """(H, the loss before each step on H and at the end, rows with their last w) from weighted() rows."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/tidemark-factors-{uuid.uuid4().hex}"
    rng = np.random.default_rng(seed)
    h = rng.uniform(0.1, 1.0, (k, max(n_terms, 1))) / np.sqrt(max(n_terms, 1))
    state, losses = rows.withColumn("w", F.array_repeat(F.lit(1.0 / k), k)), []
    for i in range(steps + 1):
        state.mapInArrow(_step_and_sums(h, INNER, n_terms), _STATE).write.parquet(f"{root}/step-{i}")
        if i:
            sinks.delete(spark, [f"{root}/step-{i - 1}"])
        stored = spark.read.parquet(f"{root}/step-{i}")
        state = stored.where("place is null").select("key", "terms", "weights", "w")
        told = stored.where("place is not null").groupBy("place").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(k)]).toPandas().to_numpy(np.float64)  # topics x (terms + topics) numbers
        sums = np.zeros((max(n_terms, 1) + k + 1, k))  # negative rows stand at the end
        sums[told[:, 0].astype(int)] = told[:, 1:]
        wv, ww, square = sums[: max(n_terms, 1)].T, sums[[-1 - j for j in range(k)]], float(sums[-k - 1, 0])
        losses.append(square - 2 * float((wv * h).sum()) + float((ww * (h @ h.T)).sum()))
        if i < steps:
            h = h * wv / np.maximum(ww @ h, TINY)
    return h, losses, state


def _least(b: np.ndarray, q: np.ndarray, x: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative rows x with the least x q x' / 2 - b x', by coordinate descent from ``x``."""
    x = x.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(q) > TINY):
            new = np.maximum(x[:, j] + (b[:, j] - x @ q[:, j]) / q[j, j], 0)
            moved, x[:, j] = max(moved, float(np.abs(new - x[:, j]).max(initial=0))), new
        if moved <= 1e-10 * x.max(initial=TINY):
            break
    return x


def _slices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first cells of texts, terms, weights) of a batch, about CELLS at a time; each text has a cell."""
    terms, weights = _arrays(b, ("terms", "weights"))
    at = b.column("terms").offsets.to_numpy() - b.column("terms").offsets[0].as_py()
    cuts = [*np.unique(np.searchsorted(at, np.arange(0, at[-1], CELLS))), len(at) - 1]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield at[i:j] - at[i], terms[at[i] : at[j]], weights[at[i] : at[j]]


def _summed(sent: Broadcast, n_terms: int, c: int, solved: bool):
    """A task's sums over its texts, c numbers a row, where w is v q (q is sent: terms x c), or if ``solved`` the weights of the topics q: w' v by term (for terms it
    has), w' w in the places -1 to -c, and below them the squares of w above and below 0 and the sums of v's squares, of v, and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.ascontiguousarray(sent.value.T)
        qq = columns @ columns.T
        wv, ww, more = np.zeros((c, n_terms)), np.zeros((c, c)), np.zeros((5, c))
        for b in batches:
            for first, terms, weights in _slices(b):
                terms = terms.astype(np.intp)
                w = np.stack([np.add.reduceat(np.take(column, terms) * weights, first) for column in columns], axis=1)
                if solved:
                    w = _least(w, qq, np.zeros_like(w), MOST_SWEEPS)
                size = np.diff(first, append=len(terms))
                for j in range(c):
                    wv[j] += np.bincount(terms, np.repeat(w[:, j], size) * weights, n_terms)
                ww += w.T @ w
                more += [(np.maximum(w, 0) ** 2).sum(axis=0), (np.minimum(w, 0) ** 2).sum(axis=0), *(np.full(c, x) for x in (weights @ weights, weights.sum(), len(first)))]
        has = np.flatnonzero(wv.any(axis=0))
        place = np.concatenate([has, -1 - np.arange(c + 5)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), _lists(np.concatenate([wv[:, has].T, ww, more]))], names=["place", "sums"])

    return run


def _over(rows: DataFrame, q: np.ndarray, solved: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of _summed() over all rows, in one pass."""
    n_terms, c = q.shape
    sent = rows.sparkSession.sparkContext.broadcast(q)  # terms x columns numbers
    told = rows.select("terms", "weights").mapInArrow(_summed(sent, n_terms, c, solved), "place int, sums array<double>")
    told = told.groupBy("place").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(c)]).toArrow()  # as many
    sent.destroy()
    sums = np.zeros((n_terms + c + 5, c))  # negative places stand at the end, the last one first
    for j in range(c):
        sums[told.column("place").to_numpy(), j] = told.column(f"s{j}").to_numpy()
    return sums[:n_terms], sums[n_terms + 5 :][::-1], sums[n_terms : n_terms + 5][::-1]


def start(rows: DataFrame, k: int, n_terms: int, seed: int = 42) -> np.ndarray:
    """H from the leading singular vectors of weighted() rows: of each the side with more weight, and the mean weight where that has none."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, min(n_terms, k + EXTRA))))[0]
    for _ in range(POWERS):
        wv, ww, _ = _over(rows, q, False)
        q = np.linalg.qr(wv @ np.linalg.eigh(ww)[1][:, ::-1])[0]
    q = q[:, :k]
    above, below, _, total, texts = _over(rows, q, False)[2]
    h = np.zeros((k, n_terms))
    for j in range(q.shape[1]):
        sides = [(np.sqrt(x) * np.linalg.norm(side), side) for x, side in ((above[j], np.maximum(q[:, j], 0)), (below[j], np.maximum(-q[:, j], 0)))]
        size, side = max(sides, key=lambda s: s[0])
        h[j] = np.sqrt(size) * side / max(np.linalg.norm(side), TINY)
    return np.where(h > TINY, h, total[0] / (max(texts[0], 1) * n_terms))


def descend(rows: DataFrame, h: np.ndarray, steps: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """(H, losses) of weighted() rows: ``steps`` steps at most, fewer if WINDOW of them lower the error by less than ``tol`` of the texts' norm.

    The losses are that without topics, those before each step and that at the end.
    """
    losses: list[float] = []
    for i in range(steps + 1):
        wv, ww, more = _over(rows, h.T, True)
        losses = losses or [float(more[2, 0])]
        losses.append(losses[0] - 2 * float((wv * h.T).sum()) + float((ww * (h @ h.T)).sum()))
        error = np.sqrt(np.maximum(losses, 0))
        if i == steps or (i >= WINDOW and error[-1 - WINDOW] - error[-1] < tol * error[0]):
            break
        h = _least(wv, ww, h.T, SWEEPS).T
    return h, losses


def fit(docs: DataFrame, language: str, k: int, terms: int = 50_000, steps: int = 400, seed: int = 42, stop: DataFrame | None = None, tol: float = 1e-4) -> Topics:
    """Topics of (text), fitted until they settle (see descend(); the defaults are those of the reference's factorisation)."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("key"), "text")
    names, idf = vocabulary(texts, terms, stop=stop)
    if not names:
        return Topics(language, names, idf, np.zeros((k, 0)))
    kept = f"{shared_dir(spark)}/tidemark-weights-{uuid.uuid4().hex}"
    weighted(texts, names, idf).write.parquet(kept)
    rows = spark.read.parquet(kept)
    cells = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    rows = rows.coalesce(min(spark.sparkContext.defaultParallelism, 1 + cells // TASK_CELLS))
    h, losses = descend(rows, start(rows, k, len(names), seed), steps, tol)
    sinks.delete(spark, [kept])
    return Topics(language, names, idf, h, losses)


def assign(model: Topics, docs: DataFrame, least: float = 0.02, steps: int = 30) -> DataFrame:
    """docs (with text) with topic_id (the heaviest topic, ``<language>-other`` below ``least``) and topic_weight."""
    k = len(model.h)
    keyed = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.col("text").alias("text"))
    # a text is weighed once, however many rows have it
    rows = weighted(keyed.groupBy("key").agg(F.first("text").alias("text")), model.terms, model.idf).withColumn("w", F.array_repeat(F.lit(1.0 / k), k))
    told = rows.mapInArrow(_step(model.h, steps), _ROWS).select("key", "w")
    best = F.array_max("w")
    name = F.when(best >= least, F.format_string(f"{model.language}-%02d", F.array_position("w", best).cast("int") - 1)).otherwise(F.lit(f"{model.language}-other"))
    j = keyed.join(told, "key", "left")
    return j.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)], name.alias("topic_id"), F.round(F.coalesce(best, F.lit(0.0)), 4).alias("topic_weight"))
