"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestar.llm import cover_tree, decontaminate, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from lodestar.llm.cover_tree import op10_cover_tree
from lodestar.llm.decontaminate import op5_decontaminate
from lodestar.llm.jaccard_join import op9_jaccard_join
from lodestar.llm.language_id import op1_language_id
from lodestar.llm.line_dedup import op2_line_dedup
from lodestar.llm.secret_scan import op3_secret_scan
from lodestar.llm.sentence_pieces import op7_sentence_pieces
from lodestar.llm.substring_dedup import op6_substring_dedup
from lodestar.llm.suffix_dedup import op4_suffix_dedup
from lodestar.llm.token_counts import op8_token_counts

QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_secret_scan, op4_suffix_dedup, op5_decontaminate, op6_substring_dedup, op7_sentence_pieces, op8_token_counts, op9_jaccard_join, op10_cover_tree)}

ORACLE_SQL = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op4_suffix_dedup": suffix_dedup.ORACLE_SQL, "op5_decontaminate": decontaminate.ORACLE_SQL, "op6_substring_dedup": substring_dedup.ORACLE_SQL, "op9_jaccard_join": jaccard_join.ORACLE_SQL, "op10_cover_tree": cover_tree.ORACLE_SQL}
