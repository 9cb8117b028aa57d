"""Operators 11 to 13 against the tokenizers library and brute force, on small tables with odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import counts, replay, yinyang
from tidemark.llm.bpe import public_path

PATH = public_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "a", "İstanbul ΣΑΣ éé \x1f\x85​ x", "<|endoftext|≯ a<|END<|startoftext|>!!<|endoftext", "'re 'r I'LL don't 'l 'v", "!" * 300 + "a" * 300, "ꟋꟜ ½²ﬁ", "क्षि 漢字 \U0001f600"]


def length(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def prefixes(text):
    width, deltas = counts.counter(PATH).deltas(text)
    return counts._sums(width, deltas).tolist()


# -- 11


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aeinorst 'Σİ!<|>1\ńé漢", "international", "unbeliev", "'re", "'ll", "<|endoftext|>", "aaaa"]), max_size=25).map("".join))
def test_every_prefix(text):
    whole = counts.composed(text)
    assert prefixes(text) == [length(whole[:i]) for i in range(len(whole) + 1)]


def test_odd_texts():
    for text in ODD:
        whole = counts.composed(text)
        assert prefixes(text) == [length(whole[:i]) for i in range(len(whole) + 1)], text


def test_long_texts_and_wide_changes(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    assert prefixes(text)[-1] == length(text)
    mixed = "!a1" * 100_000
    assert prefixes(mixed)[-1] == length(mixed)
    own = counts.PrefixCounts(PATH)
    narrow = own.deltas("some words<|endoftext|>more İ")
    monkeypatch.setattr(own, "_narrow", lambda piece: (_ for _ in ()).throw(OverflowError))
    own.narrow.clear(), own.narrow.old.clear()
    own.narrow.of = own._narrow
    wide = own.deltas("some words<|endoftext|>more İ")
    assert (narrow[0], wide[0]) == (1, 4) and counts._sums(*narrow).tolist() == counts._sums(*wide).tolist()


def test_prefix_counts(docs, rows):
    got = {r["doc_id"]: r for r in counts.op11(docs, limit=20).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t = t or ""
        r, whole = got[i], counts.composed(t)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"], r["n_chars"]) == (len(t.encode()), length(t), length(t) > 20, len(whole))
        assert length(whole[: r["kept_chars"]]) <= 20
        assert all(length(whole[:k]) > 20 for k in range(r["kept_chars"] + 1, min(len(whole), r["kept_chars"] + 40) + 1))
    book = counts.stored(docs)
    asked = counts.at(book, F.col("doc_id") % 50 - 1).collect()
    texts = dict(rows)
    assert all(r["tokens_at"] == length(counts.composed(texts[r["doc_id"]] or "")[: max(0, r["doc_id"] % 50 - 1)]) for r in asked)
    assert all(r["kept_chars"] == 0 for r in counts.longest(book, F.lit(None)).collect())


def test_prefix_counts_odd(odd, empty, spark):
    got = counts.prefix_counts(odd.withColumns({"N_TOKENS": F.lit("x"), "made": F.lit(1), "Deltas": F.lit(2)}))
    assert sorted(r["n_tokens"] for r in got.collect())[0] == 0 and got.count() == 7
    assert {"made", "kept", "k", "a.b"} <= set(got.columns) and len({c.lower() for c in got.columns}) == len(got.columns)
    assert counts.op11(odd).count() == 7 and counts.op11(empty).count() == 0


# -- 12


def brute_clusters(vectors, k, rounds, seed):
    x = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors]
    name = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist())
    centroids = [v.copy() for _, v in sorted(x, key=name)[:k]]
    near = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in x]
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(x, at, strict=True) if a == j]
            if mine:
                centroids[j] = sum(mine) // len(mine)
    out = [(i, *near(v)) for i, v in x]
    return sorted((-1 if i is None else i, c, d, sum(e for _, e, f in out if f == c), sum(e for _, e, _ in out), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for i, d, c in out)


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)


def plain(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("spread", [0.02, 0.5, 100.0])
def test_clusters(spark, spread):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 64))
    rows = [(i, (middles[i % 12] + spread * rng.normal(size=64)).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(150)]  # copies of one vector: ties, also among the first centroids
    want = brute_clusters([r[:2] for r in rows], 40, 5, 2)
    assert plain(yinyang.op12(embedded(spark, rows))) == want


def test_bounds_skip_work(spark):
    rng = np.random.default_rng(6)
    middles = 20 * rng.normal(size=(40, 64))
    rows = [(i, (middles[i % 40] + rng.normal(size=64)).astype(np.float32).tolist(), 0) for i in range(2000)]
    state, _ = yinyang.clustered(yinyang.whole_vectors(embedded(spark, rows)), 40, 5, 2)
    assert state.agg(F.avg("scanned")).first()[0] < 20


def test_clusters_odd(spark, sf_dir):
    v = [float(i) for i in range(64)]
    odd = [(1, None, 0), (2, v[:63], 0), (3, [*v[:63], None], 0), (4, [*v[:63], float("nan")], 0), (5, [*v[:63], float("-inf")], 0), (None, v, 0), (7, v, 0), (7, v, 0), (7, v[::-1], 0), (8, [-0.001] * 64, 0)]
    used = [r[:2] for r in odd[5:]]
    df = embedded(spark, odd).withColumns({"V": F.lit(1), "cluster": F.lit("x"), "a.b": F.lit(2)})
    assert plain(yinyang.op12(df)) == brute_clusters(used, 40, 5, 2)
    assert yinyang.op12(df.where("vec_id < 0")).count() == 0
    assert yinyang.op12(df.where("vec_id < 0")).columns == yinyang.op12(df).columns
    with pytest.raises(Exception, match="too large"):
        yinyang.op12(embedded(spark, [(1, [1e30] * 64, 0)])).collect()


# -- 13


def brute_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    place = lambda i: -(1 << 63) if i is None else i
    first, flags = {}, []
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", place(i)), place(i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    for i, t, s in docs:
        t = t or ""
        w = word.findall(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": place(i) > first[t]}
        flags.append((s or "", {k for k, b in bad.items() if b}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in flags}:
        mine, share = [f for f in flags if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, letter in enumerate(order):
                gone = [f for f in left if letter in f[1]]
                before = [f for f in mine if f not in left or any(x in f[1] for x in order[:k])]
                left = [f for f in left if letter not in f[1]]
                redundant = sum(letter in f[1] for f in mine if any(x in f[1] for x in order[:k]))
                share[letter] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone), letter]
                assert len(before) >= redundant
        for key, v in out.items():
            if key[0] == part:
                v[-1] = share[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_audit(spark, docs, rows):
    noisy = [(i, t if t is None or i % 3 else t.upper() + " #1", [None, "src0", "src0", "src1", ""][i % 5]) for i, t in rows]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i, _ in rows if i % 4] + [(None, 1, 1), (5, 0, 1), (5, 1, 0)]
    d = spark.createDataFrame(noisy, "doc_id bigint, text string, source string").withColumns({"part": F.lit("mine"), "bits": F.lit(1), "a.b": F.lit(2), "Good": F.lit(3)})
    got = replay.op13(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert audited(got) == brute_audit(noisy, labels)
    assert len(set(got.columns)) == 10


def test_audit_odd(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    got = audited(replay.op13(odd, labels))
    assert got == brute_audit(rows, []) and len(got) == 600
    assert replay.op13(empty, labels).count() == 0
    long = spark.createDataFrame([(1, "Word " * 300_000, None), (2, "Word " * 300_000, None)], "doc_id bigint, text string, source string")
    assert audited(replay.op13(long, labels)) == brute_audit([(1, "Word " * 300_000, None), (2, "Word " * 300_000, None)], [])


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plan = replay.op13(d, labels)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "BroadcastNestedLoopJoin" in plan and "Python" not in plan
