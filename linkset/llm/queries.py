"""The registered query of each operator, and the SQL of those SQL can express."""

from __future__ import annotations

from linkset.llm.alignment import op12_galloping_alignment
from linkset.llm.covertree import OP3_SQL, op3_cover_tree
from linkset.llm.lines import OP13_SQL, op13_line_bitmaps
from linkset.llm.mixing import OP7_SQL, op7_quality_mix
from linkset.llm.packing import op8_length_buckets
from linkset.llm.pii import op2_pii_bootstrap
from linkset.llm.quality import OP5_SQL, op5_quality_rules
from linkset.llm.repeats import OP9_SQL, op9_seed_extend
from linkset.llm.search import OP11_SQL, op11_hybrid_search
from linkset.llm.simhash import op10_simhash_trie
from linkset.llm.tokens import op4_arrow_tokens
from linkset.llm.toxicity import op6_toxicity_crf
from linkset.llm.warc import OP1_SQL, op1_warc_assembly

QUERIES = {f.__name__: f for f in (
    op1_warc_assembly, op2_pii_bootstrap, op3_cover_tree, op4_arrow_tokens, op5_quality_rules,
    op6_toxicity_crf, op7_quality_mix, op8_length_buckets, op9_seed_extend, op10_simhash_trie, op11_hybrid_search,
    op12_galloping_alignment, op13_line_bitmaps)}

ORACLES: dict[str, str] = {
    "op1_warc_assembly": OP1_SQL,
    "op3_cover_tree": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_quality_mix": OP7_SQL,
    "op9_seed_extend": OP9_SQL,
    "op11_hybrid_search": OP11_SQL,
    "op13_line_bitmaps": OP13_SQL,
}
