"""The queries of this subpackage, for __spark_entry__.py: each takes (spark, sf_dir). SQL has DuckDB's form of those it can express."""

from __future__ import annotations

from . import audit, fim, lines, warc, winnow
from .audit import op11_filter_audit
from .fim import op12_fill_in_middle
from .katz import op6_katz_scores
from .licenses import op10_license_scan
from .lines import op5_line_dedup
from .minhash import op4_minhash_dedup
from .packing import op2_best_fit_packing
from .permutation import op13_permutation_search
from .quality import op8_quality_rules
from .tokens import op1_token_counts
from .toxicity import op9_toxicity
from .warc import op3_warc_round_trip
from .winnow import op7_decontamination

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_best_fit_packing, op3_warc_round_trip, op4_minhash_dedup, op5_line_dedup, op6_katz_scores, op7_decontamination, op8_quality_rules, op9_toxicity, op10_license_scan, op11_filter_audit, op12_fill_in_middle, op13_permutation_search)}
SQL = {"op3_warc_round_trip": warc.SQL, "op5_line_dedup": lines.SQL, "op7_decontamination": winnow.SQL, "op11_filter_audit": audit.SQL, "op12_fill_in_middle": fim.SQL}
