"""The queries of this folder and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, chosenpath, hardneg, language, lines, mixing, neighbours, quality, repair, suffixes, topk, transducer, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        topk.op1_exact_top_k,
        mixing.op2_mix_sources,
        warc.op3_warc_round_trip,
        suffixes.op4_substring_dedup,
        quality.op5_quality_classifier,
        neighbours.op6_nearest_neighbours,
        chosenpath.op7_near_duplicates,
        lines.op8_line_dedup,
        bpe.op9_bpe_round_trip,
        language.op10_language_id,
        hardneg.op11_hard_negatives,
        transducer.op12_token_counts,
        repair.op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {
    "op1_exact_top_k": topk.SQL,
    "op2_mix_sources": mixing.SQL,
    "op3_warc_round_trip": warc.SQL,
    "op6_nearest_neighbours": neighbours.SQL,
    "op8_line_dedup": lines.SQL,
    "op11_hard_negatives": hardneg.SQL,
}
