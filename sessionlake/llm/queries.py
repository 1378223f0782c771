"""The opN_ queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_format
from .collocations import OP11_SQL, op11_phrase_collocations
from .fmindex import OP4_SQL, op4_decontamination
from .gam import op9_quality
from .hmm import op7_hmm_score
from .jaccard import op3_ngram_jaccard
from .lines import OP13_SQL, op13_line_dedup
from .mixing import OP5_SQL, op5_source_mixing
from .parsing import OP8_SQL, op8_prefix_free_parse
from .phrases import OP2_SQL, op2_repeated_phrases
from .pii import op10_pii_surrogates
from .runs import OP12_SQL, op12_periodic_runs
from .topk import OP1_SQL, op1_exact_topk

QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_repeated_phrases": op2_repeated_phrases,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_decontamination": op4_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_chat_format": op6_chat_format,
    "op7_hmm_score": op7_hmm_score,
    "op8_prefix_free_parse": op8_prefix_free_parse,
    "op9_quality": op9_quality,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES = {
    "op1_exact_topk": OP1_SQL,
    "op2_repeated_phrases": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_source_mixing": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op8_prefix_free_parse": OP8_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
