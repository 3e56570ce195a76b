"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from docmill.llm.chat import OP8_SQL, op8_chat_format
from docmill.llm.fingerprint import op5_fingerprints
from docmill.llm.forest import op13_minhash_dedup
from docmill.llm.licenses import OP2_SQL, op2_license_matches, op2_license_scan
from docmill.llm.line_dedup import op6_line_dedup
from docmill.llm.mixing import op4_mixing
from docmill.llm.nearest import op7_nearest
from docmill.llm.negatives import OP12_SQL, op12_hard_negatives
from docmill.llm.ngram_join import op1_ngram_join
from docmill.llm.packing import op3_packing
from docmill.llm.quality import op9_quality_classifier
from docmill.llm.secrets import op10_secret_scan
from docmill.llm.whitening import op11_whitening

ALL = (op1_ngram_join, op2_license_scan, op2_license_matches, op3_packing, op4_mixing, op5_fingerprints, op6_line_dedup, op7_nearest, op8_chat_format, op9_quality_classifier, op10_secret_scan, op11_whitening, op12_hard_negatives, op13_minhash_dedup)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": OP2_SQL, "op8_chat_format": OP8_SQL, "op12_hard_negatives": OP12_SQL}
