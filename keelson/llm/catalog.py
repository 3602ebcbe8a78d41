"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import chat, chunks, filter_audit, jaccard, lexical, lines, neighbours, pieces, repetition, secret_scan, warc
from .mixing import op8_mixing
from .sharding import op10_sharding

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_substring_dedup": chunks.op2_substring_dedup,
    "op3_repetition": repetition.op3_repetition,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_pieces": pieces.op6_pieces,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_mixing": op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_sharding": op10_sharding,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": lines.ORACLE_SQL,
    "op5_chat_formatting": chat.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_lexical_search": lexical.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
