"""The queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from .decontam import OP3_SQL, op3_decontamination
from .licenses import OP5_SQL, op5_license_scan
from .lm import OP7_SQL, op7_lm_scores
from .manifest import op12_merkle_manifest
from .media import op4_image_copies
from .minhash import op13_minhash_neardup
from .mixing import OP9_SQL, op9_source_mixing
from .secrets import op1_secret_scan
from .simhash import op6_simhash
from .suffixes import op2_suffix_dedup
from .tokens import op10_token_counts
from .toxicity import op8_toxicity
from .variants import op11_spelling_variants

QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_suffix_dedup, op3_decontamination, op4_image_copies, op5_license_scan, op6_simhash, op7_lm_scores, op8_toxicity, op9_source_mixing, op10_token_counts, op11_spelling_variants, op12_merkle_manifest, op13_minhash_neardup)
}

ORACLE_SQL: dict[str, str] = {"op3_decontamination": OP3_SQL, "op5_license_scan": OP5_SQL, "op7_lm_scores": OP7_SQL, "op9_source_mixing": OP9_SQL}
