"""Topics are fitted until they settle: the passes against NumPy, and the registered query's own models."""

import numpy as np
import pyarrow as pa
import pytest
from test_factors import themed

from tidemark import catalog
from tidemark.operators import factors


@pytest.fixture(scope="module")
def dense(spark):
    """Weighted rows of 60 texts, and the same as a matrix."""
    texts = spark.createDataFrame([(i, t) for i, t in themed(60, 2)], "key bigint, text string")
    names, idf = factors.vocabulary(texts, 40)
    rows = factors.weighted(texts, names, idf).repartition(3).cache()
    v = np.zeros((60, 40))
    for r in rows.collect():
        v[r["key"], r["terms"]] = r["weights"]
    return rows, v


def solved(v, h, steps=20_000):
    """The texts' weights by projected gradients."""
    w, hh = np.zeros((len(v), len(h))), h @ h.T
    for _ in range(steps):
        w = np.maximum(w - (w @ hh - v @ h.T) / np.linalg.norm(hh, 2), 0)
    return w


def test_sums_of_a_pass_as_in_numpy(dense):
    rows, v = dense
    q = np.random.default_rng(3).standard_normal((40, 5))
    wv, ww, more = factors._over(rows, q, False)
    w = v @ q
    assert np.allclose(wv, v.T @ w) and np.allclose(ww, w.T @ w)
    assert np.allclose(more, [(np.maximum(w, 0) ** 2).sum(0), (np.minimum(w, 0) ** 2).sum(0), *(np.full(5, x) for x in ((v**2).sum(), v.sum(), 60))])
    h = np.abs(q.T)
    wv, ww, _ = factors._over(rows, h.T, True)
    w = solved(v, h)
    assert np.allclose(wv, v.T @ w, atol=1e-6) and np.allclose(ww, w.T @ w, atol=1e-6)


def test_it_settles_below_multiplicative_steps(dense):
    rows, v = dense
    first = factors.start(rows, 4, 40)
    s, right = np.linalg.svd(v)[1:]
    assert np.allclose(first[0][np.abs(right[0]) > 1e-9], np.sqrt(s[0]) * np.abs(right[0])[np.abs(right[0]) > 1e-9], atol=1e-6)
    h, losses = factors.descend(rows, first, 400, 1e-4)
    error = np.sqrt(losses)
    assert factors.WINDOW < len(losses) - 1 < 400 and error[-1 - factors.WINDOW] - error[-1] < 1e-4 * error[0]
    assert losses[0] == pytest.approx(60) and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:], strict=False))
    assert losses[-1] == pytest.approx(((v - solved(v, h) @ h) ** 2).sum(), abs=1e-6)
    for seed in (1, 2, 3):
        hh, w = np.random.default_rng(seed).uniform(0.1, 1.0, (4, 40)) / np.sqrt(40), np.full((60, 4), 1 / 4)
        for _ in range(400):
            w = w * (v @ hh.T) / np.maximum(w @ (hh @ hh.T), factors.TINY)
            hh = hh * (w.T @ v) / np.maximum(w.T @ w @ hh, factors.TINY)
        assert losses[-1] <= ((v - w @ hh) ** 2).sum() * 1.001
    assert len(factors.descend(rows, first, 3, 1e-4)[1]) == 5


def test_slices_are_whole_texts(monkeypatch):
    lists = [list(range(n)) for n in (3, 9, 1, 1, 8, 2)]
    b = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array([[x + 0.5 for x in xs] for xs in lists], pa.list_(pa.float64()))], names=["terms", "weights"])
    for cells in (1, 4, 5, 100):
        monkeypatch.setattr(factors, "CELLS", cells)
        for part, want in ((b, lists), (b.slice(1, 4), lists[1:5]), (b.slice(0, 0), [])):
            got = [x for first, terms, weights in factors._slices(part) for x in np.split(np.stack([terms, weights - 0.5]), first[1:], axis=1)]
            assert [x.astype(int).tolist() for x in got] == [[xs, xs] for xs in want]


def test_registered_topics_have_settled(spark, sf_dir, monkeypatch):
    models, fit = [], factors.fit
    monkeypatch.setattr(factors, "fit", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    rows = catalog.QUERIES["m6_topics_factorised"](spark, sf_dir).collect()
    assert len(rows) == 8 * len(models) and len(models) == len({r["language"] for r in rows}) > 1
    for m in models:
        error = np.sqrt(np.maximum(m.losses, 0))
        assert len(error) - 1 > factors.WINDOW and error[-1 - factors.WINDOW] - error[-1] < 1e-4 * error[0], m.language


def test_last_digits_do_not_order_terms():
    h = np.array([[0.3, 0.3 + 1e-13, 0.3 - 1e-13, 0.4, 0.0], np.zeros(5)])
    assert factors.Topics("en", list("abcde"), np.ones(5), h).top_terms(3) == [["d", "a", "b"], []]
