"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP3_SQL, op3_chat_format
from .decontaminate import OP1_SQL, op1_decontaminate
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op10_language_id
from .license_scan import OP8_SQL, op8_license_scan
from .near_dedup import op7_near_dedup
from .neighbours import op5_neighbours
from .oracles import OP6_SQL, OP7_SQL
from .quality import op2_quality
from .sentencepiece_codec import op9_sentencepiece
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op4_token_counts
from .url_filter import OP13_SQL, op13_url_filter
from .whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_chat_format": op3_chat_format,
    "op4_token_counts": op4_token_counts,
    "op5_neighbours": op5_neighbours,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_url_filter": op13_url_filter,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_near_dedup": OP7_SQL,
    "op8_license_scan": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_url_filter": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
