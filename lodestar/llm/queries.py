"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from lodestar.llm.chat import OP4_SQL, op4_snapshot_collapse
from lodestar.llm.hilbert import op8_hilbert
from lodestar.llm.langid import op9_kneser_ney
from lodestar.llm.neardup import op6_super_minhash
from lodestar.llm.ngram_lm import op7_backoff_automaton
from lodestar.llm.packing import op10_min_bin_slack
from lodestar.llm.pieces import op5_nbest_pieces
from lodestar.llm.quality import OP2_SQL, op2_line_rules
from lodestar.llm.topk import OP1_SQL, op1_va_file
from lodestar.llm.toxicity import op3_pattern_grammar

QUERIES = {
    "op1_va_file": op1_va_file,
    "op2_line_rules": op2_line_rules,
    "op3_pattern_grammar": op3_pattern_grammar,
    "op4_snapshot_collapse": op4_snapshot_collapse,
    "op5_nbest_pieces": op5_nbest_pieces,
    "op6_super_minhash": op6_super_minhash,
    "op7_backoff_automaton": op7_backoff_automaton,
    "op8_hilbert": op8_hilbert,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_min_bin_slack": op10_min_bin_slack,
}

ORACLE_SQL = {
    "op1_va_file": OP1_SQL,
    "op2_line_rules": OP2_SQL,
    "op4_snapshot_collapse": OP4_SQL,
}
