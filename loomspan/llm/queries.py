"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import line_dedup, oracles
from .decontaminate import op6_decontaminate
from .line_dedup import op2_line_dedup
from .html_text import op9_html_text
from .license_scan import op10_license_scan
from .lm_score import op5_lm_score
from .mixing import op8_mixing
from .near_dup import op3_minhash
from .quality import op1_quality
from .secrets import op7_secrets
from .suffix_dedup import op4_suffix_dedup

QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash": op3_minhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_html_text": op9_html_text,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality": oracles.quality(),
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_minhash": oracles.MINHASH,
    "op4_suffix_dedup": oracles.SUFFIX,
    "op7_secrets": oracles.secrets(),
}
