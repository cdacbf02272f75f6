"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chat, decontamination, line_dedup, url_filter
from .chat import op7_chat
from .decontamination import op3_decontamination
from .fingerprints import op1_fingerprints
from .language import op6_language_id
from .line_dedup import op5_line_dedup
from .minhash import op9_near_duplicates
from .mixing import op10_mixing
from .periodic_runs import op12_periodic_runs
from .repair import op11_structure_repair
from .secret_scan import op8_secret_ownership
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op2_toxicity
from .url_filter import op13_url_filter

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_toxicity, op3_decontamination, op4_suffix_dedup, op5_line_dedup, op6_language_id, op7_chat, op8_secret_ownership,
                                    op9_near_duplicates, op10_mixing, op11_structure_repair, op12_periodic_runs, op13_url_filter)}
ORACLES = {"op3_decontamination": decontamination.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op7_chat": chat.ORACLE, "op13_url_filter": url_filter.ORACLE}
