"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, counts, jaccard, langid, lm, media, mixing, quality, replay, substring, urlfilter, warc, yinyang
from tidemark.llm._frames import table


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_members": _on("pages", warc.op1),
        "op2_substring_dedup": _on("documents", substring.op2),
        "op3_bloom_lm": _on("documents", lm.op3),
        "op4_entropy_mixing": _on("documents", mixing.op4),
        "op5_language_fusion": lambda spark, sf_dir: langid.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")),
        "op6_temporal_url_lists": _on("pages", urlfilter.op6),
        "op7_jaccard_join": _on("documents", jaccard.op7),
        "op8_bpe_stream": _on("documents", bpe.op8),
        "op9_png_media": _on("documents", media.op9),
        "op10_rule_ledger": _on("documents", quality.op10),
        "op11_prefix_counts": _on("documents", counts.op11),
        "op12_yinyang": _on("embeddings", yinyang.op12),
        "op13_filter_replay": lambda spark, sf_dir: replay.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_members": warc.SQL,
        "op2_substring_dedup": substring.SQL,
        "op6_temporal_url_lists": urlfilter.SQL,
        "op7_jaccard_join": jaccard.SQL,
        "op10_rule_ledger": quality.SQL,
        "op12_yinyang": yinyang.SQL,
        "op13_filter_replay": replay.SQL,
    }
