"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op6_ann
from .decontaminate import OP1_SQL, op1_decontaminate
from .filter_audit import OP13_SQL, op13_filter_audit
from .fingerprints import op12_fingerprints
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .langid import op4_langid
from .lm_score import op2_lm_score
from .packing import op10_packing
from .pii import op9_pii
from .suffix_dedup import OP8_SQL, op8_suffix_dedup
from .toxicity import op5_toxicity
from .vector_codes import OP11_SQL, op11_vector_codes
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_langid": op4_langid,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_warc": op7_warc,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_fingerprints": op12_fingerprints,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op7_warc": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op11_vector_codes": OP11_SQL, "op13_filter_audit": OP13_SQL}
