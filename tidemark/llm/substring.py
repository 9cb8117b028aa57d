"""Removal of repeated word windows: seed and extend on winnowed anchors.

A window is ``length`` consecutive words of one document.  A word goes if a window covers it whose
word sequence also starts earlier (at a smaller id, or earlier in the same document).

Seeds: winnowing picks in every window the least hash of its ``seed``-word grams, the leftmost of
equal ones.  The choice depends on the window's words alone, so equal windows share an anchor.  Runs
of windows that pick one anchor form a span, about ``length`` words wide and one per
(length - seed + 2) / 2 words; only spans are shuffled, by anchor.

Extension: within an anchor, spans whose words agree to both ends are equal in every window, so all
but the first of them are repeats as a whole.  Where an anchor has several different spans (at the
ends of a repeat), the first span of each kind is extended window by window and compared by window
hash.  Groups are reduced to their first member, in the batch before the shuffle and in a stream
after it; no pairs of a group are formed.  Overlapping repeats then merge into maximal ones, which
by construction have at least ``length`` words.

Anchor and span (or window) hash, 128 bits together, stand for the words.

Edge cases: a null or empty text has no words and keeps the hash of the empty string; a null id
comes before all ids; rows with the same id and position are not earlier than each other, so a row
that is repeated with its id changes nothing; an empty table gives an empty result; columns of the
input that have a result column's name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, key_or, packed, utf8, with_arrow
from tidemark.llm._text import Runs, Words, inside, mix, ngrams, signed, slices

LENGTH, SEED = 20, 8
_FIELDS = [("h", pa.int64()), ("s", pa.int64()), ("k", pa.int64()), ("x", pa.int64()), ("st", pa.int32()), ("en", pa.int32()), ("kind", pa.int8())]
SPANS = pa.schema(_FIELDS)
_DDL = "h bigint, s bigint, k bigint, x bigint, st int, en int, kind tinyint"
FIRST, REPEAT = 0, 1  # kinds of span rows: first of its kind so far, or known to be a repeat


def spans(w: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text's number, first word, end, anchor hash, span hash) of the spans of some texts."""
    starts = inside(w.first, w.per_text, length)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    words = w.hashes()
    value = grams = ngrams(words, seed)
    at, width, reach = np.arange(len(grams)), length - seed + 1, 1
    while reach < width:  # sliding minimum by doubling; ties go to the left
        step = min(reach, width - reach)
        right = value[step:] < value[:-step]
        value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        reach += step
    anchor = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    st, en, anchor = starts[begin], starts[last] + length, anchor[begin]
    own = np.searchsorted(w.first, st, "right") - 1
    kind = mix(Runs(words).of(st, en) + (anchor - st).astype(np.uint64))
    return own, st - w.first[own], en - w.first[own], grams[anchor], kind


def _first_of_batch(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Marks as REPEAT what the batch itself shows to be one, and leaves out equal rows."""
    order = np.lexsort((c["x"], c["st"], c["k"], c["s"], c["h"]))
    c = {n: a[order] for n, a in c.items()}
    group = np.ones(len(order), bool)
    group[1:] = (c["h"][1:] != c["h"][:-1]) | (c["s"][1:] != c["s"][:-1])
    at = np.flatnonzero(group)[np.cumsum(group) - 1] if len(order) else order
    first = (c["k"] == c["k"][at]) & (c["st"] == c["st"][at])
    c["kind"] = np.where(first, FIRST, REPEAT).astype(np.int8)
    same = np.zeros(len(order), bool)
    same[1:] = ~group[1:] & (c["k"][1:] == c["k"][:-1]) & (c["st"][1:] == c["st"][:-1]) & (c["x"][1:] == c["x"][:-1])
    return {n: a[~same] for n, a in c.items()}


def _batch(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c[n], t) for n, t in _FIELDS], schema=SPANS)


def _seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            parts = []
            for i, j in slices(texts):
                own, st, en, h, s = spans(Words(texts[i:j]), length, seed)
                parts.append((signed(h), signed(s), k[i:j][own], x[i:j][own], st, en))
            if parts:
                names = ("h", "s", "k", "x", "st", "en")
                yield _batch(_first_of_batch({n: np.concatenate(p) for n, p in zip(names, zip(*parts, strict=True), strict=True)}))

    return run


def _windows(length: int):
    """From spans that are first of their kind to their windows, as spans of one window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x, texts, todo = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist()
            parts = []
            for i, j in slices(texts):
                w = Words(texts[i:j])
                own = np.repeat(np.arange(j - i), [len(t) for t in todo[i:j]])
                st = np.array([r["st"] for t in todo[i:j] for r in t], np.int64)
                n = np.array([r["en"] for t in todo[i:j] for r in t], np.int64) - length + 1 - st
                h = np.array([r["h"] for t in todo[i:j] for r in t], np.int64)
                which = np.repeat(np.arange(len(st)), n)
                start = st[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = w.first[own[which]] + start
                parts.append((h[which], signed(Runs(w.hashes()).of(at, at + length)), k[i:j][own[which]], x[i:j][own[which]], start, start + length))
            if parts:
                names = ("h", "s", "k", "x", "st", "en")
                yield _batch(_first_of_batch({n: np.concatenate(p) for n, p in zip(names, zip(*parts, strict=True), strict=True)}))

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in the order h, s, k, st: passes on repeats, and the firsts of anchors with several kinds.

    Keeps no more than the first rows of the group that is open at a batch's end.
    """
    held: dict[str, np.ndarray] | None = None
    held_h = None  # the open anchor, if it is known to have several kinds
    for b in batches:
        c = {n: b.column(i).to_numpy() for i, (n, _) in enumerate(_FIELDS)}
        known = c["kind"] == REPEAT
        if known.any():
            yield _batch({n: a[known] for n, a in c.items()})
        c = {n: a[~known] for n, a in c.items()}
        if held is not None:
            c = {n: np.concatenate((held[n], a)) for n, a in c.items()}
        size = len(c["h"])
        if not size:
            continue
        new_h, new_s = np.ones(size, bool), np.ones(size, bool)
        new_h[1:] = c["h"][1:] != c["h"][:-1]
        new_s[1:] = new_h[1:] | (c["s"][1:] != c["s"][:-1])
        at = np.flatnonzero(new_s)[np.cumsum(new_s) - 1]
        first = (c["k"] == c["k"][at]) & (c["st"] == c["st"][at])
        anchor = np.cumsum(new_h) - 1
        several = np.bincount(anchor, weights=new_s) > 1
        if held_h is not None and c["h"][0] == held_h:
            several[0] = True
        open_ = first & (at == at[-1])
        send = (~first | several[anchor]) & ~open_
        c["kind"] = np.where(first, FIRST, REPEAT).astype(np.int8)
        if send.any():
            yield _batch({n: a[send] for n, a in c.items()})
        held, held_h = {n: a[open_] for n, a in c.items()}, c["h"][-1] if several[-1] else None
    if held is not None and held_h is not None:
        yield _batch(held)


def _remove(texts: list[bytes], repeats: list[list | None]) -> dict:
    out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept_text")}
    for t, r in zip(texts, repeats, strict=True):
        words = t.split()
        if not r:
            kept, text, gone = words, t, 0
        else:
            w = Words([t])
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, [x["st"] for x in r], 1)
            np.add.at(edge, [x["en"] for x in r], -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept, gone = [words[i] for i in np.flatnonzero(keep)], int((~keep).sum())
            turn = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
            # runs of kept words with the white space inside them, and before all but the first
            text = b"".join(t[(w.ends[i - 1] if i and n else w.starts[i]) : w.ends[j - 1]] for n, (i, j) in enumerate(turn.reshape(-1, 2)))
        for k, v in zip(out, (len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest(), text.decode("utf-8", "replace")), strict=True):
            out[k].append(v)
    return out


def repeated_spans(keyed: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(k, x, st, en): word ranges to remove, from rows (k, x, t) with id, text hash and UTF-8 text."""
    order = ["h", "s", "k", "st"]
    # what is known to be a repeat only passes through, so it is dealt out evenly
    route = lambda *keys: F.when(F.col("kind") == REPEAT, F.xxhash64("k", "st")).otherwise(F.xxhash64(*keys))
    found = keyed.select("k", "x", "t").mapInArrow(_seeds(length, seed), _DDL)
    found = cut(found.repartition(route("h")).sortWithinPartitions(*order).mapInArrow(_stream, _DDL), "spans")
    todo = found.where(F.col("kind") == FIRST).groupBy("k", "x").agg(F.collect_list(F.struct("st", "en", "h")).alias("todo"))
    windows = keyed.select("k", "x", "t").join(todo, ["k", "x"]).mapInArrow(_windows(length), _DDL)
    ends = windows.repartition(route("h", "s")).sortWithinPartitions(*order).mapInArrow(_stream, _DDL)
    return found.where(F.col("kind") == REPEAT).unionByName(ends.where(F.col("kind") == REPEAT)).select("k", "x", "st", "en")


NEW = ("n_words", "n_removed", "kept_sha256", "kept_text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 (of the kept words joined by spaces) and kept_text.

    kept_text is the text without the removed words; white space elsewhere stays.
    """
    text = F.coalesce(utf8(docs[f"`{text_col}`"]), F.lit(b""))
    row, unpacked = packed(docs, [*NEW, text_col])
    keyed = docs.select(key_or(docs[f"`{id_col}`"]).alias("k"), F.xxhash64(text).alias("x"), text.alias("t"), row)
    gone = repeated_spans(keyed.select("k", "x", "t"), length, seed).groupBy("k", "x").agg(F.collect_set(F.struct("st", "en")).alias("gone"))
    j = keyed.join(gone, ["k", "x"], "left")
    made = with_arrow(j, [F.col("t"), F.col("gone")], _remove, "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return made.select(*unpacked(), *NEW)


def op2(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeats cut out of their texts, those of which only repeats were left out; columns stay as they are."""
    row, unpacked = packed(docs, ["text"])  # the text travels once
    r = remove_repeats(docs.select(docs["doc_id"], docs["text"], row.alias("whole"))).where("n_removed = 0 or n_removed < n_words")
    others = dict(zip([c for c in docs.columns if c.lower() != "text"], unpacked(), strict=True))
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return r.withColumnRenamed("whole", "row").select(*[made.get(c.lower(), others.get(c)).alias(c) for c in docs.columns])


#: For SQL engines that can hold every window of the corpus; small tables only.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM d, unnest(generate_series(1, len(w) - 19)) AS u(s)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM rep, unnest(generate_series(0, 19)) AS u(i)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(generate_series(1, len(w))) AS u(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
