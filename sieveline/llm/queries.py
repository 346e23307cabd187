"""Queries of this subpackage and, where SQL can express them, what DuckDB should return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_automaton import op5_bpe_automaton
from .chat import OP3_SQL, op3_chat_format
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .flac import op7_flac_media
from .html_extract import op9_html_main_text
from .language_id import op2_language_id
from .mixing import op6_mix_sources
from .near_dedup import op4_near_dedup
from .token_files import op10_token_files
from .warc import op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_mix_sources": op6_mix_sources,
    "op7_flac_media": op7_flac_media,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_main_text": op9_html_main_text,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
}
