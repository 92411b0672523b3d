"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from planloom.llm.collocations import OP11_SQL, op11_collocations
from planloom.llm.decontaminate import OP10_SQL, op10_decontamination
from planloom.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from planloom.llm.jaccard_join import op4_jaccard_join
from planloom.llm.line_dedup import OP1_SQL, op1_line_dedup
from planloom.llm.lm_score import op9_lm_score
from planloom.llm.mixing import OP8_SQL, op8_mixing
from planloom.llm.pii import op6_pii
from planloom.llm.quality import op7_quality
from planloom.llm.secret_scan import op2_secret_scan
from planloom.llm.sharding import OP12_SQL, op12_sharding
from planloom.llm.substring_dedup import op3_substring_dedup
from planloom.llm.topk import OP5_SQL, op5_top_k

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_top_k": op5_top_k,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_sharding": op12_sharding,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op5_top_k": OP5_SQL,
    "op8_mixing": OP8_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_sharding": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
