"""Each operator against a brute-force version, on small tables with odd rows."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import bpe, jaccard, langid, lm, media, mixing, quality, substring, urlfilter, warc
from tidemark.llm._text import Words, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
find = lambda t: WORD.findall(t or "")
low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_and_hashes():
    texts = [b"", b"a bb  a\n", "é x \x1f y".encode(), b"abc" * 1000 + b" z"]
    w = Words(texts)
    assert w.per_text.tolist() == [len(t.split()) for t in texts]
    h, all_ = w.hashes().tolist(), [x for t in texts for x in t.split()]
    assert len(dict(zip(all_, h, strict=True))) == len(set(h))
    assert [j - i for i, j in slices([b"x" * 10] * 5, 25)] == [2, 2, 1]


# -- 1


def test_warc(spark, tmp_path):
    big, other = "<p>" + "é" * 80, "<p>" + "x" * 200
    rows = [(3, "http://a/", big), (1, "http://b/", big), (2, "http://c/\r\nX: y", other), (4, None, None), (5, "u", "small"), (6, "u", "small"), (None, "n", other), (7, "n", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = by_id(warc.op1(pages), "page_id")
    assert len(got) == 8
    for i, _, h in rows:
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), sha(h or ""))
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("revisit", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None), 7: ("response", None)}
    assert warc.op1(pages.where("page_id < 0")).count() == 0
    long = spark.createDataFrame([(1, None, "x" * 3_000_000), (2, None, "x" * 3_000_000)], pages.schema).withColumn("payload", warc.F.lit(1))
    assert [(r["payload_bytes"], r["refers_to"]) for r in warc.op1(long).orderBy("page_id").collect()] == [(3_000_000, None), (3_000_000, 1)]
    found = warc.cut(warc.op1(long).withColumn("archive", warc.F.lit("a")).withColumn("offset", warc.F.lit(0)), "test")
    with pytest.raises(Exception, match="no such response"):
        warc.confirmed(found.withColumn("payload_bytes", warc.F.when(warc.F.col("page_id") == 2, 5).otherwise(warc.F.col("payload_bytes")))).collect()
    again = spark.createDataFrame([(1, "u", big), (1, "u", big)], pages.schema)
    assert [r["record_type"] for r in warc.op1(again).collect()] == ["response"] * 2


def test_warc_members_and_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "text %d " % i * 30) for i in range(20)], "page_id bigint, url string, html string").coalesce(2)
    warc.write_monolithic(pages, str(tmp_path / "raw"))
    out = "file://" + str(tmp_path / "members")
    index = warc.normalise(spark, str(tmp_path / "raw"), out).collect()
    assert len(index) == 20
    for r in index:
        data = open(r["archive"].removeprefix("file://"), "rb").read()[r["offset"] : r["offset"] + r["length"]]
        z = zlib.decompressobj(31)
        headers, _ = warc.parse(z.decompress(data))
        assert z.eof and not z.unused_data and headers["warc-record-id"] == r["record_id"]
    side = open(index[0]["archive"].removeprefix("file://") + ".idx").read().splitlines()
    assert any(line.split("\t")[3] == index[0]["record_id"] for line in side)
    with pytest.raises(ValueError):
        list(warc._Members(io.BytesIO(warc._member(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"))))


# -- 2


def brute_windows(rows, n=20):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w, gone = find(t), set()
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone |= set(range(s, s + n))
            seen.setdefault(k, i)
        out[i] = (len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_substring(docs, rows):
    got = {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(substring.op2(docs)).items()}
    assert got == brute_windows(rows)


def test_substring_odd(odd, empty):
    got = substring.remove_repeats(odd).collect()
    assert len(got) == 7 and all(r["kept"] == "mine" and r["a.b"] == 2 for r in got)
    removed = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got)
    assert removed == [(False, 5, 40, 40), (False, 5, 40, 40), (False, 5, 43, 40), (False, 6, 0, 0), (False, 7, 40, 40), (True, 0, 1, 0), (True, 0, 40, 0)]
    assert substring.op2(empty).count() == 0
    left = substring.without_repeats(odd)
    assert left.columns == odd.columns and left.where("doc_id = 7").count() == 0


# -- 3


def test_lm(docs, rows):
    got, train, pairs, toks = by_id(lm.op3(docs)), collections.Counter(), collections.Counter(), {}
    for i, t in rows:
        toks[i] = [*find(low(t)), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(toks[i])
            pairs.update(zip(["begin", *toks[i]], toks[i], strict=False))
            train["begin"] += 1
    begin = train.pop("begin")
    n, v = sum(train.values()), len(train)
    for i, k in toks.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(k), sum(train[x] > 0 for x in k), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in k), rel_tol=1e-9)
    exact = lambda k: sum(math.log10((pairs[a, b] + 8 * (train[b] + 1) / (n + v + 1)) / ((begin if a == "begin" else train[a]) + 8)) for a, b in zip(["begin", *k], k, strict=False))
    assert np.mean([abs(exact(k) - got[i]["score"]) / len(k) for i, k in toks.items()]) < 0.1
    held = [i for i in toks if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_lm_odd(odd, empty):
    assert lm.op3(odd).count() == 7
    assert lm.op3(empty).count() == 0


def test_filter_levels():
    keys = np.random.default_rng(2).integers(0, 1 << 36, 3000, dtype=np.uint64)
    keys = np.unique(keys)
    counts = np.random.default_rng(3).integers(1, 500, len(keys))
    size = 1 << 20
    table = lm._segment(keys, counts, size)
    got = lm.level_counts(lm.probed_levels(keys, table, size))
    level = lambda c: np.floor(np.log2(c))
    assert (level(got) >= level(counts)).all() and (level(got) == level(counts)).mean() > 0.99
    absent = np.setdiff1d(np.random.default_rng(4).integers(0, 1 << 36, 3000, dtype=np.uint64), keys)
    assert (lm.probed_levels(absent, table, size) > 0).mean() < 0.01
    # counts of frequent words at any size, and the middles of levels
    many = np.array([1 << 32, (1 << 40) + 5], np.int64)
    assert (lm.probed_levels(keys[:2], lm._segment(keys[:2], many, size), size) == [33, 41]).all()
    assert lm.level_counts(np.array([0, 1, 2, 33])).tolist() == [0.0, 1.0, 2.5, 1.5 * 2**32 - 0.5]


def test_lm_once_seen_grams_stay(docs, monkeypatch):
    """However texts are cut into units, pairs seen once are in the model."""
    before = {i: r["score"] for i, r in by_id(lm.op3(docs)).items()}
    monkeypatch.setattr(lm, "UNIT_BYTES", 1 << 12)
    after = {i: r["score"] for i, r in by_id(lm.op3(docs)).items()}
    assert set(after) == set(before) and all(math.isclose(after[i], before[i], rel_tol=1e-9, abs_tol=1e-9) for i in before)


def test_lm_segments_grow():
    """A bucket with a hundred times the grams still tells them from absent ones, and gives each unit its own."""
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 32, 300000, dtype=np.uint64))
    counts = np.where(np.arange(len(keys)) % 3 == 0, 0, 1)  # a third in held-out documents only
    rows = lm._answers(0, [(7, keys, counts), (9, keys[::2], 0 * counts[::2])]).to_pylist()
    first, second = (np.frombuffer(r["levels"], np.uint8) for r in rows)
    assert [r["unit"] for r in rows] == [7, 9] and (second == first[::2]).all()
    assert (first[counts > 0] >= 1).all() and (first[counts > 0] == 1).mean() > 0.99 and (first[counts == 0] > 0).mean() < 0.01


def test_lm_unit_must_match():
    keys = np.arange(20, dtype=np.uint64) << np.uint64(32)
    answers = [(i, b"\x01", i << 32) for i in range(16)]
    assert (lm._told(keys[:16], 4, answers) == 1).all()
    with pytest.raises(RuntimeError, match="same rows"):
        lm._told(keys[:15], 4, answers)


# -- 4


def test_mixing(docs, rows):
    got = [r.asDict() for r in mixing.op4(docs).collect()]
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, total = {i: len(find(t)) for i, t in rows}, collections.Counter()
    for i, s in size.items():
        total[source[i]] += s
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            rest -= target[s]
            open_.remove(s)
    target |= share
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s] + 5
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, (r.asDict() for r in mixing.op4(docs.repartition(3)).collect())))


def test_mixing_rates_solve_the_dual(docs):
    """Each source's rates are exponentials in the root of the size, with the multiplier that a bisection in NumPy finds, and meet its target."""
    by = collections.defaultdict(list)
    for r, source in ((r, s) for r in mixing.op4(docs).collect() for s in [r["source_size"]]):
        by[source].append(r)
    for own in by.values():
        size, rate = np.array([r["size"] for r in own], float), np.array([r["rate"] for r in own])
        some, target = size > 0, own[0]["target"]
        x = np.sqrt(size[some] / size[some].mean())
        tilted = lambda lam: np.minimum(np.exp(np.minimum(lam * x, 50)), 3)  # noqa: B023, E731
        low, high = -50.0, 50.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if (size[some] * tilted(lam)).sum() < target else (low, lam)
        assert np.abs(rate[some] - tilted(lam)).max() < 1e-5 and (rate[~some] == 0).all()
        assert abs((size * rate).sum() - target) <= 1e-6 * target


def test_mixed_documents(docs, odd, empty):
    taken = {r["doc_id"]: r["copies"] for r in mixing.op4(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = collections.Counter(r["doc_id"] for r in out.collect())
    assert n == {i: c for i, c in taken.items() if c}
    assert mixing.op4(odd).count() == 7 and mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.op4(empty).count() == 0
    r = mixing.op4(odd).collect()
    assert sum(x["taken"] for x in r) <= 3 * sum(x["size"] for x in r) and {x["source_size"] for x in r} == {sum(x["size"] for x in r)}


def test_mixing_equal_rows(spark):
    """Of rows that repeat, as many are taken as the target needs; so it is with ties and with a source per row."""
    rows = [(1, "ten words of one text that is here four hundred times", "a")] * 400 + [(i, f"some other text {i} " * 5, "b") for i in range(2, 200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.op4(d).collect()
    target = {r["source_size"]: r["target"] for r in got}
    taken = collections.Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 0.01 * t + 11 for s, t in target.items())
    mixed = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(d).collect())
    assert mixed[1] * 11 == sum(r["taken"] for r in got if r["doc_id"] == 1)
    again = mixing.op4(d.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    many = mixing.op4(d.withColumn("source", langid.F.col("doc_id").cast("string"))).collect()
    assert len(many) == len(rows) and abs(sum({r["doc_id"]: r["target"] for r in many}.values()) - sum(r["size"] for r in many)) < 1e-3


# -- 5


def test_language(spark):
    en, fr = "the people and the house of that nation with this", "les gens et la maison de cette nation avec une autre"
    rows = [(i, (en if i % 2 else fr) + f" {i}" * (i % 3), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(200)]
    rows += [(900, en, "fr", "s1"), (901, None, "en", None), (902, "", None, "s1"), (903, "中文字符" * 40, None, "s1"), (904, en, "klingon", "s0")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = by_id(langid.op5(d))
    assert all(got[i]["lang_id"] == ("en" if i % 2 else "fr") and got[i]["kept"] for i in range(200))
    assert got[900]["lang_id"] == "en" and got[904]["lang_id"] == "en"
    assert not got[901]["kept"] and not got[902]["kept"] and not got[903]["kept"] and got[903]["lang_id"] == "und"
    assert {r["doc_id"] for r in langid.kept_documents(d).collect()} == set(range(200)) | {900, 904}
    html = [(i, f"http://www.x{i % 3}.{'fr' if i % 2 else 'com'}/a", f"<html lang='{'fr' if i % 2 else 'en'}'><body><p>{fr if i % 2 else en}</p></html>") for i in range(60)] + [(99, None, None)]
    p = by_id(langid.pages(spark.createDataFrame(html, "page_id bigint, url string, html string")), "page_id")
    assert all(p[i]["lang_id"] == ("fr" if i % 2 else "en") for i in range(60)) and not p[99]["kept"]


def brute_language(rows):
    """Posteriors by the definition, one row and one number at a time, from (id, text, declared, suffix, host); few rows, so that none is left out of the fit."""

    def grams(t):
        x = t.lower() + b"  "
        return [((((a << 16 | b << 8 | c) * 0x9E3779B1) % (1 << 32)) >> 17) for a, b, c in zip(x, x[1:], x[2:], strict=False)]

    texts = [(t or "").encode() for _, t, *_ in rows]
    labelled = collections.Counter(r[2] for r, t in zip(rows, texts, strict=True) if r[2] is not None and t)
    names = sorted(k for k, n in labelled.items() if n >= langid.LEAST)
    logs = []
    for c in names:
        n = np.full(langid.BUCKETS, 0.05)
        for t in (t for r, t in zip(rows, texts, strict=True) if r[2] == c and t):
            for g in grams(t):
                n[g] += 1
        logs.append(np.log(n / n.sum()))
    logs.append(np.full(langid.BUCKETS, -math.log(langid.BUCKETS)))
    k = len(logs)
    soft = lambda x: (e := np.exp(x - x.max())) / e.sum()
    told = [np.array([langid.TEXT_WEIGHT * sum(w[g] for g in grams(t)) for w in logs]) + np.array([0.0] * (k - 1) + [math.log(0.01)]) for t in texts]
    post = [soft(x) for x in told]
    values = [*names, "?"]
    value = [None if r[2] is None else r[2] if r[2] in names else "?" for r in rows]
    say = np.array([sum((p for p, v in zip(post, value, strict=True) if v == x), np.zeros(k)) for x in values]) + 0.5
    say = np.log(say / say.sum(axis=0))
    say[:, -1] = -math.log(len(values))
    top = (sum(post) + 1) / (sum(post).sum() + k)
    out = {}
    for i, r in enumerate(rows):
        prior = top
        for level in (3, 4):
            own = sum((p for j, p in enumerate(post) if rows[j][level] == r[level] is not None), np.zeros(k))
            own = np.maximum(own - post[i], 0) if r[level] is not None else own
            prior = (own + langid.SMOOTH * prior) / (own.sum() + langid.SMOOTH)
        x = soft(told[i] + (say[values.index(value[i])] if value[i] else 0) + np.log(prior))
        out[r[0]] = ([*names, "und"][int(x.argmax())], float(x.max()), [*names, "und"][int(post[i].argmax())], bool(texts[i].strip()))
    return out


def test_language_by_definition(spark):
    rng = np.random.default_rng(4)
    vocabulary = {"en": "the people and house of that nation with this".split(), "fr": "les gens et la maison de cette nation une autre".split(), "de": "die leute und das haus der nation mit einer".split()}
    rows = []
    for i in range(80):
        c = ("en", "fr", "de")[i % 3]
        t = " ".join(rng.choice(vocabulary[c], rng.integers(1, 9)))
        rows.append((i, t, c if i % 5 else ("en", None, "xx")[i % 3], ("com", "fr", None)[i % 3], None if i % 11 == 0 else f"h{i % 4}.x"))
    rows += [(90, None, "fr", "fr", "h1.x"), (91, "", None, None, None), (92, "die la of", None, None, "h0.x"), (93, "中文字符", None, "com", "h0.x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, suffix string, host string").coalesce(1)
    f = langid.F.col
    got = by_id(langid.identify(d, declared=f("declared"), suffix=f("suffix"), host=f("host")))
    want = brute_language(rows)
    for i, (lang, confidence, text_lang, words) in want.items():
        r = got[i]
        assert abs(r["confidence"] - confidence) < 0.02, (i, r, want[i])
        # where two classes are about equal either may come first
        assert r["lang_id"] == lang or confidence < 0.52
        assert r["text_lang"] == text_lang or not words
        assert r["kept"] == (words and r["lang_id"] != "und" and r["confidence"] >= langid.MIN_CONFIDENCE)


def test_language_of_both_tables(spark, docs):
    html = "<html lang='en'><p>the people and the house of that nation</p></html>"
    p = spark.createDataFrame([(i, "http://a.com/", html) for i in range(8)] + [(9, None, None)], "page_id bigint, url string, html string")
    got = langid.op5(docs, p).collect()
    assert sum(r["doc_id"] is not None for r in got) == docs.count() and {r["page_id"] for r in got if r["doc_id"] is None} == {*range(8), 9}
    assert all(r["kept"] and r["declared"] == "en" for r in got if r["doc_id"] is None and r["page_id"] != 9)


def test_language_rare(spark, monkeypatch):
    """A rare label stays a class, and its texts stay, when common labels have far more rows than are sampled."""
    monkeypatch.setattr(langid, "SAMPLE", 20)
    en, fr, zh = "the people and the house of that nation with this", "les gens et la maison de cette nation avec une autre", "中文字符的人民和房子" * 10
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr", f"s{i % 4}") for i in range(1000)] + [(2000 + i, f"{zh} {i}", "zh", "s1") for i in range(6)]
    d = spark.createDataFrame([*rows, (3000, zh, None, None)], "doc_id bigint, text string, lang string, source string")
    got = by_id(langid.op5(d))
    assert all(got[i]["lang_id"] == "zh" and got[i]["kept"] for i in [*range(2000, 2006), 3000])
    assert all(got[i]["lang_id"] == ("en" if i % 2 else "fr") for i in range(1000))
    assert {r["doc_id"] for r in langid.kept_documents(d).collect()} == set(got)


def test_language_repeats_and_many_labels(spark, monkeypatch):
    """A label whose rows all repeat one text is a class; more labels than fit into a worker are an error."""
    monkeypatch.setattr(langid, "SAMPLE", 20)
    en, xx = "the people and the house of that nation with this", "qwx zzk vvj qqp xkz wqv jjx kzq pqx zvw"
    rows = [(i, f"{en} {i}", "en", "s1") for i in range(400)] + [(7000, xx, "xx", "s2")] * 300
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {(r["doc_id"] == 7000, r["lang_id"], r["kept"]) for r in langid.op5(d).collect()}
    assert got == {(True, "xx", True), (False, "en", True)}
    many = spark.createDataFrame([(i, f"text {i}", f"odd{i % 300}", None) for i in range(1500)], "doc_id bigint, text string, lang string, source string")
    with pytest.raises(ValueError, match="more than 256 labels"):
        langid.op5(many)


def test_language_odd(odd, empty):
    same = odd.withColumn("lang", langid.F.lit("en")).withColumn("row", langid.F.lit(1)).withColumn("whole", langid.F.lit("w"))
    kept = langid.kept_documents(same)
    # rows that repeat count each; the null text goes
    assert kept.columns == same.columns and sorted((r["doc_id"] or 0, r["whole"], r["a.b"]) for r in kept.collect()) == [(0, "w", 2), (0, "w", 2), (5, "w", 2), (5, "w", 2), (5, "w", 2), (7, "w", 2)]
    assert langid.op5(odd).count() == 7 and langid.kept_documents(odd).columns == odd.columns
    assert langid.op5(empty).count() == 0


# -- 6


def test_url_lists(spark):
    e = spark.createDataFrame(
        [("bad", "x.com", "block", "add", "2024-01-01"), ("bad", "x.com", "block", "remove", "2024-01-10"), ("bad", "x.com", "block", "add", "2024-01-20"), ("ok", "m.x.com/en", "allow", "add", "2024-01-05"), ("bad", None, "block", "add", "2024-01-01"), ("bad", "y.com", "block", "add", "2024-01-05"), ("bad", "y.com", "block", "remove", "2024-01-05")],
        "list string, pattern string, verdict string, action string, since string",
    ).selectExpr("list", "pattern", "verdict", "action", "cast(since as timestamp) as since")
    c = spark.createDataFrame(
        [(1, "http://x.com/", "2024-01-01"), (2, "http://x.com/", "2024-01-09 23:59:59"), (3, "http://x.com/", "2024-01-10"), (4, "https://u@m.X.com:8080/en/1?q", "2024-01-21"), (5, "http://m.x.com/de", "2024-01-21"), (6, "http://notx.com/", "2024-01-02"), (7, None, "2024-01-02"), (8, "http://x.com/", None), (9, "http://y.com/", "2024-02-01"), (1, "http://x.com/", "2024-01-01")],
        "id int, url string, fetched string",
    ).selectExpr("id", "url", "cast(fetched as timestamp) as fetched", "'mine' as pattern")
    got = urlfilter.judge(c, e).collect()
    assert len(got) == 10
    assert {r["id"] for r in got if r["blocked"]} == {1, 2, 5}
    assert {r["id"]: r["pattern"] for r in got if r["list"]} == {1: "x.com", 2: "x.com", 4: "m.x.com/en", 5: "x.com"}
    # one pattern in two spellings is one pattern; of two lists with patterns of one length allow decides, then the name
    twice = spark.createDataFrame([("bad", "X.com", "block", "add", "2024-01-01"), ("bad", "x.COM", "block", "remove", "2024-01-03"), ("a", "z.com", "block", "add", "2024-01-01"), ("b", "z.com", "allow", "add", "2024-01-01"), ("c", "z.com", "allow", "add", "2024-01-01")], e.columns).selectExpr("list", "pattern", "verdict", "action", "cast(since as timestamp) as since")
    assert {r["id"] for r in urlfilter.judge(c, twice).collect() if r["blocked"]} == {1}
    z = spark.createDataFrame([(1, "http://z.com/" + "p" * 100_000)], "id int, url string").selectExpr("id", "url", "timestamp'2024-01-02' as fetched")
    assert [(r["blocked"], r["list"]) for r in urlfilter.judge(z, twice).collect()] == [(False, "b")]
    assert urlfilter.judge(c, e.where("false")).where("blocked").count() == 0
    assert urlfilter.op6(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# -- 7


def brute_components(rows, n=3, percent=90):
    sets = {}
    for i, t in rows:
        w = find(low(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                a_, b_ = sorted((root(a), root(b)))
                at[b_] = a_
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("small", "n", "percent"), [(32, 3, 90), (2, 3, 90), (1, 5, 80)])
def test_jaccard(docs, rows, monkeypatch, small, n, percent):
    monkeypatch.setattr(jaccard, "SMALL", small)  # with small groups, hubs and dealing anew do the work
    got = jaccard.similarity_components(docs.select("doc_id", "text"), n=n, percent=percent)
    assert {r["k"]: (r["n_shingles"], r["component"]) for r in got.collect()} == brute_components(rows, n, percent)


def test_jaccard_lone_tokens(spark):
    """Documents end at the first order only if nobody shares what they may not differ in: brute force at the limit, in many units."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(102)]
    rows = []
    for i in range(60):
        t = list(base)
        for k in rng.choice(100, i % 7, replace=False):
            t[k] = f"n{i}x{k}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(f"u{i}y{k}" for k in range(30))) for i in range(40)] + [(200, "z " * 200_000), (201, "z " * 100_000 + "y")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op7(d).collect()}
    assert got == brute_components(rows)


def test_jaccard_hubs(spark, monkeypatch):
    """Families that drift and share passages: hubs that meet become one document, which compares and deals for all their groups."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rng = np.random.default_rng(8)
    passages = [[f"p{p}w{i}" for i in range(60)] for p in range(4)]
    rows = []
    for family in range(6):
        t = passages[family % 4] + passages[(family + 1) % 4] + [f"f{family}w{i}" for i in range(40)]
        for _ in range(25):
            if rng.random() < 0.7:  # a word changes from member to member, for good
                t = list(t)
                t[rng.integers(0, len(t))] = f"x{rng.integers(0, 12)}"
            rows.append((len(rows), " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    compared = []
    hubs = jaccard._hubs

    def seen(large):
        star = hubs(large)
        compared.append((star.select("a").distinct().count(), star.count(), star.select("b").distinct().count(), large.select("k").distinct().count()))
        return star

    monkeypatch.setattr(jaccard, "_hubs", seen)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op7(d).collect()}
    assert got == brute_components(rows)
    hub, pairs, members, all_members = compared[0]
    assert members >= all_members - hub and pairs <= 2 * all_members  # every member meets a hub, and few meet several


def test_jaccard_odd(odd, empty):
    got = jaccard.op7(odd).collect()
    assert len(got) == 7 and {r["component_id"] for r in got if r["doc_id"] == 7} == {None}
    assert jaccard.op7(empty).count() == 0
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns and left.where("doc_id = 7").count() == 0 and left.where("doc_id = 6").count() == 1


# -- 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(docs, rows, library):
    got = by_id(bpe.op8(docs))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_round_trip_and_odd(docs, odd, empty, rows):
    texts = dict(rows)
    assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in bpe.decode(bpe.encode(docs.select("doc_id", "text"))).collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in bpe.op8(odd).collect()) == [(0, True), (0, True), (5, True), (5, True), (5, True), (6, False), (7, True)]
    assert bpe.op8(empty).count() == 0


def test_bpe_memory(library):
    """Tokens of a text without a break come in parts of bounded size, and its window doesn't grow."""
    b = bpe.tokenizer(bpe.public_path())
    rng = np.random.default_rng(2)
    for text in ("".join(rng.choice(list("abcdefgh"), 400_000)), "\n\t x" * 60_000, "é,." * 70_000 + "<|endoftext|>" + "q" * 100):
        parts = list(b.encode(text))
        assert [i for p in parts for i in p.tolist()] == library.encode(text, add_special_tokens=False).ids
        assert max(len(p) for p in parts) <= 2 * bpe.SEGMENT


def test_bpe_short_pieces(monkeypatch):
    """The same tokens as by the queue, with two lookups a merge: ranks of neighbours that stay are kept."""
    b, rng, asked = bpe.tokenizer(bpe.public_path()), np.random.default_rng(4), [0]

    class Counting(list):
        def __getitem__(self, i):
            asked[0] += 1
            return super().__getitem__(i)

    monkeypatch.setattr(b, "rank", Counting(b.rank))
    for alphabet in (b"aetonihrs ", bytes(range(256)), b"aaab"):
        for n in range(49):
            data, asked[0] = bytes(rng.choice(list(alphabet), n).astype(np.uint8)), 0
            ids = b._short(data)
            assert ids == b._window([b.single[x] for x in data])
            assert asked[0] <= 2 * (n - len(ids)), data


def test_bpe_long_pieces(library):
    b = bpe.tokenizer(bpe.public_path())
    rng = np.random.default_rng(1)
    for letters in ("ab", "etaoin", "abcdefghijklmnop"):
        s = "".join(rng.choice(list(letters), 9000))
        assert [i for ids in b.stream(s.encode()) for i in ids] == library.encode(s, add_special_tokens=False).ids
    long = ("word " * 30000) + "x" * 70000 + " é" * 40000
    assert np.concatenate(list(b.encode(long))).tolist() == library.encode(long, add_special_tokens=False).ids
    assert "".join(b.decode([np.array([i]) for i in library.encode("né \U0001f600", add_special_tokens=False).ids])) == "né \U0001f600"
    assert "".join(b.decode([np.array([b.single[0xF0], b.single[0x41]])])) == "�A"


# -- 9


def test_media(docs, rows, odd, empty):
    got = by_id(media.op9(docs))
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode_png(p)).hexdigest() and len(r["feature"]) == 16
    assert media.op9(odd).count() == 7 and media.op9(empty).count() == 0


def test_png_filters_and_faults():
    rng = np.random.default_rng(5)
    rows = np.cumsum(rng.integers(0, 3, (40, 192)), axis=0).astype(np.uint8)
    png = media.encode_png(rows.tobytes())
    assert (media.decode_png(png) == rows).all() and (np.frombuffer(zlib.decompress(b"".join(_idat(png))), np.uint8).reshape(40, 193)[:, 0] > 0).any()
    for bad in (png[1:], png[:-3], png[:60] + bytes([png[60] ^ 1]) + png[61:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    # all five filter types, applied by the definition
    kinds, prev, lines = [0, 1, 2, 3, 4] * 8, np.zeros(192, np.int64), []
    for k, row in zip(kinds, rows.astype(np.int64), strict=True):
        left, up_left = np.concatenate((np.zeros(3, np.int64), row[:-3])), np.concatenate((np.zeros(3, np.int64), prev[:-3]))
        p = left + prev - up_left
        pa, pb, pc = abs(p - left), abs(p - prev), abs(p - up_left)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, prev, up_left))
        lines.append((row - [0, left, prev, (left + prev) // 2, paeth][k]) % 256)
        prev = row
    out = media._unfilter(np.array(kinds), np.array(lines).astype(np.uint8), 3)
    assert (out == rows).all()


def _idat(png):
    at = 8
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        if png[at + 4 : at + 8] == b"IDAT":
            yield png[at + 8 : at + 8 + n]
        at += 12 + n


# -- 10


def brute_quality(t):
    w, lines, seen, dup = find(t), (t or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})


def test_quality(docs, rows):
    got = by_id(quality.op10(docs))
    for i, t in rows:
        r, want = got[i], brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r["base_failed"] or not r["kept"])


def test_ablation(docs, odd, empty):
    book = quality.ledger(docs)
    table = {r["rule"]: r for r in quality.ablation(book, "v2").collect()}
    bits = [r["fail_bits"] for r in book.collect()]
    mask = quality.POLICIES["v2"]
    assert set(table) == {r.name for r in quality.RULES if quality.BIT[r.name] & mask}
    for name, r in table.items():
        b = quality.BIT[name]
        assert (r["n_failed"], r["n_only_this"], r["n_kept_without"]) == (sum(bool(x & b) for x in bits), sum(x & mask == b for x in bits), sum(not x & mask & ~b for x in bits))
    names = [r.name for r in quality.RULES]
    for r in quality.op10(docs).collect():
        failed = [n for n in names if r["fail_bits"] & quality.BIT[n]]
        assert r["only_rule"] == (failed[0] if len(failed) == 1 else None)
        assert r["kept_without"] == (sum(not x & ~quality.BIT[failed[0]] for x in bits) if len(failed) == 1 else None)
        assert (r["kept_v1"], r["kept_v2"], r["kept_v3"]) == tuple(not r["fail_bits"] & quality.POLICIES[v] for v in ("v1", "v2", "v3"))
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in quality.op10(odd).collect()) == [(0, 1), (0, 40), (5, 40), (5, 40), (5, 43), (6, 0), (7, 40)]
    assert quality.op10(odd).count() == 7 and quality.ledger(odd).count() == 7 and quality.op10(empty).count() == 0
