"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Training counts words and word pairs of the training documents (every document's tokens are its
lower-cased words and one end).  The exact word counts stay a table.  Pair and word counts are
quantised to powers of two, level q = 1 + floor(log2(count)), and a gram of level q goes into
a Bloom filter q times, as (gram, 1) ... (gram, q).  A reader probes (gram, 1), (gram, 2), ... until a
probe misses; the last hit gives the count.  Smoothing mixes the orders:

    P(w | v) = (count(v w) + STRENGTH * P(w)) / (count(v) + STRENGTH),   P(w) = (count(w) + 1) / (N + V + 1)

Size: all grams are stored, those seen once too, at every input size.  The filter is split by the key space into
buckets of about a million tokens; a bucket's segment has at least BITS_PER_LEVEL bits per stored level, so the
filter grows with the counted grams and its rate of false hits doesn't.  No task holds more than a segment: texts are
worked on in units of about UNIT_BYTES, and a unit's distinct keys are sent, sorted and packed per bucket, to the
segment, with their counts in the training documents.  The task of a bucket sums the counts, fills the segment, probes
it for all keys that were sent and returns a byte (the level) per key to the unit.  Both shuffles grow with the input.

The units are cut from the rows twice (for the keys and for the scores), so docs must give the same rows in the same order
both times, as files do; a unit whose keys aren't those that were answered raises an error.

Counts are the middles of their levels, so over all words after one v the P(w | v) add up to about 1, not to 1 exactly.

Base score: exact add-one unigram probabilities.  The HEAD most frequent words are broadcast
(a fixed number); a document's other words join the count table.

Edge cases: a null or empty text has one token, its end; a null id trains like the id ''; rows that
repeat an id count and are scored each; without training documents N = V = 0 and the score is that
of the smoothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, utf8
from tidemark.llm._text import U64, Words, mix, signed, slices

#: Probes per stored level.
PROBES = 4
#: Bits of a segment per stored level, at least: of absent grams, at most one in 400 seems to be there.
BITS_PER_LEVEL = 16
#: Bytes of text whose grams are asked for together.
UNIT_BYTES = 8 << 20
HEAD = 1 << 18
STRENGTH = 8.0
#: A gram's key is the top 32 + bits bits of its hash, for 2**bits buckets of about a million tokens each; clashes
#: of keys are then a few times rarer than false hits of the filter.
REST = 32
END, BEGIN = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the tokens of some texts, ends included, and where each text's begin."""
    w = Words([t.lower() for t in texts])
    first = w.first + np.arange(len(w.first))
    tok = np.full(int(first[-1]), END, U64)
    ends = np.zeros(len(tok), bool)
    ends[first[1:] - 1] = True
    tok[~ends] = w.hashes()
    return tok, first


def begin_key(bits: int) -> np.ndarray:
    return mix(np.array([BEGIN]) + U64(1)) >> U64(64 - REST - bits)


def gram_keys(tok: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token and of its pair with the one before it (the first with a begin mark)."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[first[:-1]] = BEGIN
    down = U64(64 - REST - bits)
    return mix(tok + U64(1)) >> down, mix(before * U64(0xD1342543DE82EF95) + tok) >> down


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, parts = b.column(0).to_pylist(), []
        for i, j in slices(texts):
            parts.append(np.unique(tokens(texts[i:j])[0], return_counts=True))
        yield _summed(parts, lambda x: signed(x), ["word", "n"])


def _sum_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _summed(parts, cast, names) -> pa.RecordBatch:
    keys, n = _sum_counts(parts)
    return pa.RecordBatch.from_arrays([pa.array(cast(keys)), pa.array(n.astype(np.int64))], names=names)


def _pack(bucket: int, keys: np.ndarray, n: np.ndarray) -> dict:
    return {"bucket": bucket, "keys": keys.astype(np.uint32).tobytes(), "counts": n.astype(np.uint32).tobytes()}


def _unpack(bucket: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, np.uint32).astype(U64) | U64(bucket << REST), np.frombuffer(counts, np.uint32).astype(np.int64)


_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


_ASKED = _PACKED.append(pa.field("unit", pa.int64()))
_ANSWER = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("levels", pa.binary()), ("keys_sum", pa.int64())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(id, rows) of every unit: runs of a batch's rows, the same whenever the same rows are read."""
    unit = None
    for b in batches:
        if unit is None and b.num_rows:
            unit = b.column("part")[0].as_py() << 32
        for i, j in slices(b.column("t"), UNIT_BYTES):
            yield unit, b.slice(i, j - i)
            unit += 1


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys, and the end."""
    return np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=U64) << U64(REST))


def _ask(bits: int):
    """Each unit's distinct keys by bucket, with their counts in its training documents (0 for those of held-out ones only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, b in _units(batches):
            texts, parts = b.column("t").to_pylist(), []
            train = (~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64)
            for i, j in slices(texts):
                tok, first = tokens(texts[i:j])
                n = np.repeat(train[i:j], np.diff(first))
                parts += [_sum_counts([(k, n)]) for k in gram_keys(tok, first, bits)]
                parts.append((begin_key(bits), train[i:j].sum(keepdims=True)))
            keys, n = _sum_counts(parts)
            edge = _edges(keys, bits)
            rows = [_pack(k, keys[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]]) | {"unit": unit} for k in range(1 << bits) if edge[k] < edge[k + 1]]
            yield pa.RecordBatch.from_pylist(rows, schema=_ASKED)

    return run


def _answers(bucket: int, asked: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A bucket's counts to its segment of the filter, and what the segment says about each unit's keys."""
    keys, n = _sum_counts([(k, c) for _, k, c in asked])
    stored = n > 0
    size = 1 << max(10, (BITS_PER_LEVEL * int((np.log2(n[stored]).astype(np.int64) + 1).sum()) - 1).bit_length())
    level = probed_levels(keys, _segment(keys[stored], n[stored], size), size).astype(np.uint8)
    rows = [{"unit": u, "bucket": bucket, "levels": level[np.searchsorted(keys, k)].tobytes(), "keys_sum": int(k.sum().view(np.int64))} for u, k, _ in asked]
    return pa.RecordBatch.from_pylist(rows, schema=_ANSWER)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in the order of buckets: a row per bucket and unit, with the levels of the unit's keys in their order."""
    at, asked = None, []
    for b in batches:
        for bucket, keys, counts, unit in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if at is not None and bucket != at:
                yield _answers(at, asked)
                asked = []
            at = bucket
            asked.append((unit, *_unpack(bucket, keys, counts)))
    if asked:
        yield _answers(at, asked)


def _places(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """Bit numbers of (key, level) within its bucket's segment, probe by probe."""
    h = mix(keys + U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (h >> U64(32)) | U64(1)
    for i in range(PROBES):
        yield (h + U64(i) * step) & U64(size - 1)


def _segment(keys: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The bits (packed) of one bucket's segment of ``size`` bits."""
    seg, level = np.zeros(size, bool), 1
    while True:
        keep = n >= 1 << (level - 1)
        keys, n = keys[keep], n[keep]
        if not len(keys):
            return np.packbits(seg, bitorder="little")
        for place in _places(keys, level, size):
            seg[place] = True
        level += 1


def probed_levels(keys: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """The level of the last hit of each key in a segment of ``size`` bits, or 0."""
    level, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    step = 1
    while len(left) and step < 48:
        hit = np.ones(len(left), bool)
        for at in _places(keys[left], step, size):
            hit &= (table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        left = left[hit]
        level[left] = step
        step += 1
    return level


def level_counts(level: np.ndarray) -> np.ndarray:
    """The counts that stand for levels: 0, or the middle of the level (1 for the first)."""
    return np.where(level > 0, np.ldexp(1.5, level - 1) - 0.5, 0.0)


def _told(keys: np.ndarray, bits: int, answers: list[tuple[int, bytes, int]]) -> np.ndarray:
    """The counts of a unit's sorted keys from the answers (bucket, levels, keys_sum) in the order of buckets."""
    edge = _edges(keys, bits)
    own = np.flatnonzero(np.diff(edge))
    sums = np.add.reduceat(keys, edge[own]).view(np.int64).tolist()
    if [(b, len(x), k) for b, x, k in answers] != list(zip(own.tolist(), np.diff(edge)[own].tolist(), sums, strict=True)):
        raise RuntimeError("the rows of a unit aren't those whose grams were counted: docs must give the same rows in the same order at each reading")
    return level_counts(np.frombuffer(b"".join(x for _, x, _ in answers), np.uint8).astype(np.int64))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the ids of their units."""
    for unit, b in _units(batches):
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "t")), pa.array(np.full(b.num_rows, unit))], names=["doc_id", "held_out", "t", "unit"])


def _score(bits: int, n: int, v: int, shared):
    """Over rows in the order of units, each unit's answers (by bucket) behind its documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def scored(docs: list[tuple], answers: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        head, count = shared.value
        texts = [d[2] for d in docs]
        out = {k: [] for k in ("n_tokens", "known", "logs", "score", "words", "times", "tail")}
        parts = list(slices(texts))
        toks = [tokens(texts[i:j]) for i, j in parts]
        asked = [gram_keys(tok, first, bits) for tok, first in toks]
        keys = np.unique(np.concatenate([begin_key(bits), *(np.unique(np.concatenate(x)) for x in asked)]))
        counts = _told(keys, bits, answers)
        begin = counts[np.searchsorted(keys, begin_key(bits))]
        for (i, j), (tok, first), (one, two) in zip(parts, toks, asked, strict=True):
            own = np.repeat(np.arange(j - i), np.diff(first))
            one, at = np.unique(one, return_inverse=True)
            c1 = counts[np.searchsorted(keys, one)][at]
            two, at = np.unique(two, return_inverse=True)
            c2 = counts[np.searchsorted(keys, two)][at]
            before = np.empty_like(c1)
            before[1:] = c1[:-1]
            before[first[:-1]] = begin[0]
            p = (c2 + STRENGTH * (c1 + 1) / (n + v + 1)) / (np.maximum(before, c2) + STRENGTH)
            out["score"].append(np.bincount(own, np.log10(p), j - i))
            at = np.minimum(np.searchsorted(head, tok), max(0, len(head) - 1))
            found = head[at] == tok if len(head) else np.zeros(len(tok), bool)
            logs = np.zeros(len(tok))
            logs[found] = np.log10(count[at[found]] + 1.0)
            out["logs"].append(np.bincount(own, logs, j - i))
            out["known"].append(np.bincount(own[found], minlength=j - i))
            out["n_tokens"].append(np.diff(first))
            rest, which = tok[~found], own[~found]
            order = np.lexsort((rest, which))
            rest, which = rest[order], which[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (which[1:] != which[:-1])
            at = np.flatnonzero(new)
            out["words"].append(signed(rest[at]))
            out["times"].append(np.diff(np.append(at, len(rest))).astype(np.int32))
            out["tail"].append(np.bincount(which[at], minlength=j - i))
        c = {k: np.concatenate(x) for k, x in out.items()}
        ends = pa.array(np.concatenate(([0], np.cumsum(c["tail"]))).astype(np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.bool_()),
            pa.array(c["n_tokens"].astype(np.int64)), pa.array(c["known"].astype(np.int64)), pa.array(c["logs"]), pa.array(c["score"]),
            pa.ListArray.from_arrays(ends, pa.array(c["words"])), pa.ListArray.from_arrays(ends, pa.array(c["times"])),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, answers = None, [], []
        for b in batches:
            for unit, bucket, doc_id, held, t, levels, keys_sum in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if at is not None and unit != at:
                    yield scored(docs, answers)
                    docs, answers = [], []
                at = unit
                if bucket < 0:
                    docs.append((doc_id, held, t))
                else:
                    answers.append((bucket, levels, keys_sum))
        if at is not None:
            yield scored(docs, answers)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    d = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), held_out(docs[f"`{id_col}`"]).alias("held_out"), F.coalesce(utf8(docs[f"`{text_col}`"]), F.lit(b"")).alias("t"))
    train = d.where(~F.col("held_out")).select("t")

    words = train.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(words, "words")
    n, v = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    # the frequent words, by the least class of counts with which they are at most HEAD
    words_by = words.withColumn("class", F.floor(F.log2("n") * 16))
    sizes = sorted(words_by.groupBy("class").agg(F.count("*")).collect(), reverse=True)  # 1024 classes at most
    total, lowest = 0, None
    for c, size in sizes:
        total += size
        if total > HEAD:
            break
        lowest = c
    top = words_by.where(F.col("class") >= lowest if lowest is not None else F.lit(False)).select("word", "n").toPandas()
    head = top["word"].to_numpy(np.int64).view(U64)
    by = np.argsort(head)

    bits = min(20, max(4, (n >> 20).bit_length()))  # buckets of about a million tokens
    parted = d.withColumn("part", F.spark_partition_id())  # a task's own number would change in the union
    asked = parted.mapInArrow(_ask(bits), "bucket int, keys binary, counts binary, unit bigint").repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(_answer, "unit bigint, bucket int, levels binary, keys_sum bigint")
    placed = parted.mapInArrow(_place, "doc_id bigint, held_out boolean, t binary, unit bigint").withColumn("bucket", F.lit(-1))
    told = answers.unionByName(placed, allowMissingColumns=True).select("unit", "bucket", "doc_id", "held_out", "t", "levels", "keys_sum")
    shared = spark.sparkContext.broadcast((head[by], top["n"].to_numpy(np.int64)[by]))

    ddl = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, score double, words array<bigint>, times array<int>"
    s = told.repartition("unit").sortWithinPartitions("unit", "bucket").mapInArrow(_score(bits, n, v, shared), ddl).withColumn("row", F.monotonically_increasing_id())
    s = cut(s, "scores")
    tail = s.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rest = tail.join(words, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    j = s.drop("words", "times").join(rest, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    return j.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op3(documents: DataFrame) -> DataFrame:
    return score(documents.select("doc_id", "text"))
