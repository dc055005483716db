"""The corpus operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.ann_collision import op5_ann_collision
from colloquy.llm.license_scan import OP10_SQL, op10_license_scan
from colloquy.llm.line_templates import OP7_SQL, op7_line_templates
from colloquy.llm.mixing import OP8_SQL, op8_mixing
from colloquy.llm.quality import op4_quality
from colloquy.llm.sentencepiece_fst import op1_sentencepiece_fst
from colloquy.llm.simhash_golay import op9_simhash_golay
from colloquy.llm.token_counts import op6_token_counts
from colloquy.llm.topk_fagin import OP3_SQL, op3_topk_fagin
from colloquy.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_fst": op1_sentencepiece_fst,
    "op2_url_filter": op2_url_filter,
    "op3_topk_fagin": op3_topk_fagin,
    "op4_quality": op4_quality,
    "op5_ann_collision": op5_ann_collision,
    "op6_token_counts": op6_token_counts,
    "op7_line_templates": op7_line_templates,
    "op8_mixing": op8_mixing,
    "op9_simhash_golay": op9_simhash_golay,
    "op10_license_scan": op10_license_scan,
}

ORACLE: dict[str, str] = {
    "op2_url_filter": OP2_SQL,
    "op3_topk_fagin": OP3_SQL,
    "op7_line_templates": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op10_license_scan": OP10_SQL,
}
