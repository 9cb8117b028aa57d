"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one failure bit
per rule; a policy is a version name and a mask over those bits, so a new policy, or the ablation of
a rule, is bit arithmetic on the ledger and reads no text again.

The ledger is written once (``stored``); the registered query judges by all versions from it and joins the ablation's counts.

Edge cases: a null or empty text has no words (all measurements 0, ``few_words`` fails); repeated
rows and ids are measured row by row; columns of the input that have a ledger column's name are
replaced, all others pass through; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, utf8, with_arrow
from tidemark.llm._text import Words, mix, ngrams, inside, slices

SYMBOLS = "#*$%&|<>"
_COUNTED = np.zeros(256, np.uint8)
_COUNTED[list(SYMBOLS.encode())] = 1
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])


def measure_texts(texts: list[bytes | None]) -> dict:
    """The measurements of some texts, as arrays."""
    texts = [t or b"" for t in texts]
    out = {k.split()[0]: np.zeros(len(texts), np.int64) for k in MEASURES.split(", ")}
    for i, j in slices(texts):
        w = Words(texts[i:j])
        out["n_words"][i:j] = w.per_text
        space = np.ones(len(w.buf), bool)
        delta = np.zeros(len(w.buf) + 1, np.int8)
        delta[w.starts] += 1
        delta[w.ends] -= 1
        np.equal(np.cumsum(delta[:-1], dtype=np.int8), 0, out=space)
        out["word_chars"][i:j] = _per_text(~space & ((w.buf & 0xC0) != 0x80), w.text_at)
        out["n_symbols"][i:j] = _per_text(_COUNTED[w.buf], w.text_at)
        for k in range(i, j):
            lines = [x for x in texts[k].split(b"\n") if x.strip()]
            out["n_lines"][k], out["n_dup_lines"][k] = len(lines), len(lines) - len(set(lines))
        starts = inside(w.first, w.per_text, 3)
        if len(starts):
            owner = w.owner()
            key = ngrams(w.hashes(), 3)[starts] + mix(owner[starts].astype(np.uint64))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(owner), bool)
            for k in range(3):
                covered[starts[twice] + k] = True
            out["n_repeat_words"][i:j] = np.bincount(owner[covered], minlength=j - i)
    return out


@dataclass(frozen=True)
class Rule:
    """A rule's bit is its place in RULES; ``failed`` is an expression over the measurements."""

    name: str
    failed: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("mean_word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: a document is kept if none of the mask's rules failed.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BIT["symbols"],
    "v3": BASE | BIT["symbols"] | BIT["mean_word_length"] | BIT["repeated_lines"],
}


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements and ``fail_bits`` (bigint; bit i is set if RULES[i] failed)."""
    measured = with_arrow(docs, [utf8(docs[f"`{text_col}`"])], measure_texts, MEASURES)
    bits = [F.when(F.expr(r.failed), F.lit(BIT[r.name])).otherwise(0).cast("bigint") for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def verdict(policy: str) -> Column:
    """Whether the policy keeps a row of the ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows only it rejects, and what is kept without it.

    The ledger is first counted by masked bit pattern (at most 2**rules groups, summed before the
    shuffle); the rest works on those counts.
    """
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r.name, BIT[r.name]) for r in RULES if BIT[r.name] & mask]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for n, b in rules]))
    x = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return x.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only_this"),
        total(others == 0).alias("n_kept_without"),
        F.bit_or("bits").alias("any_bits"),
    )


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of docs (id, measurements, bits) as a table: texts are read for it once, and policies read it."""
    return cut(ledger(docs.select(docs[f"`{id_col}`"].alias(id_col), docs[f"`{text_col}`"].alias("text")), "text").drop("text"), "ledger")


def alone(policy: str) -> Column:
    """The rule that alone rejects a row under the policy, null where none or several do."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    return F.coalesce(*[F.when(bits == BIT[r.name], F.lit(r.name)) for r in RULES])


def op10(documents: DataFrame, policy: str = "v3") -> DataFrame:
    """Every document's verdict under all versions of the policy, from the stored ledger; ``kept`` is that of ``policy``.

    ``only_rule`` and ``kept_without`` are the document's part of the ablation: what rejects it alone, and how many are kept without that rule.
    """
    book = stored(documents)
    lost = ablation(book, policy).select(F.col("rule").alias("only_rule"), F.col("n_kept_without").alias("kept_without"))
    rows = book.withColumn("only_rule", alone(policy)).join(F.broadcast(lost), "only_rule", "left")  # a row per rule
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        verdict(policy).alias("kept"), "fail_bits", F.lit(policy).alias("policy"),
        *[verdict(v).alias(f"kept_{v}") for v in POLICIES], "only_rule", "kept_without",
    )


#: The same rows from any SQL engine, with every word as a row; small tables only.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, s, array_to_string(w[s : s + 2], ' ') AS k FROM d, unnest(generate_series(1, len(w) - 2)) AS u(s)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT s + i) AS n FROM rep, unnest([0, 1, 2]) AS v(i) GROUP BY doc_id),
line AS (SELECT doc_id, l FROM d, unnest(string_split(t, chr(10))) AS v(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM line GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'v3' AS policy,
  fail_bits & 3 = 0 AS kept_v1, fail_bits & 11 = 0 AS kept_v2, fail_bits = 0 AS kept_v3, only_rule, CASE WHEN only_rule IS NOT NULL THEN (SELECT count(*) FROM b c WHERE c.fail_bits & (31 - b.fail_bits) = 0) END AS kept_without
FROM (SELECT *, CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'mean_word_length' WHEN 8 THEN 'symbols' WHEN 16 THEN 'repeated_lines' END AS only_rule FROM b) b
"""
