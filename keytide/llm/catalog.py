"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from keytide.llm import licenses, linededup
from keytide.llm.decontam import op8_benchmark_windows
from keytide.llm.embeddings import op7_hyperplane_links
from keytide.llm.extract import op4_tree_extraction
from keytide.llm.langmodel import op3_kneser_ney_scores
from keytide.llm.licenses import op9_license_diagonals
from keytide.llm.linededup import op2_line_runs_dedup
from keytide.llm.mixing import op10_temperature_mix
from keytide.llm.quality import op1_crf_quality
from keytide.llm.sharding import op6_hash_tree_shards
from keytide.llm.simhash import op5_simhash_components

QUERIES = {q.__name__: q for q in (op1_crf_quality, op2_line_runs_dedup, op3_kneser_ney_scores, op4_tree_extraction, op5_simhash_components, op6_hash_tree_shards, op7_hyperplane_links, op8_benchmark_windows, op9_license_diagonals, op10_temperature_mix)}

ORACLES: dict[str, str] = {"op2_line_runs_dedup": linededup.ORACLE, "op9_license_diagonals": licenses.ORACLE}
