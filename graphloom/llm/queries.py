"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from . import op5, oracles
from .op1 import op1_decontamination
from .op2 import op2_best_fit_packing
from .op3 import op3_substring_dedup
from .op4 import op4_toxicity
from .op5 import op5_license_scan
from .op6 import op6_warc_derivatives
from .op7 import op7_jaccard_join
from .op8 import op8_secret_scan
from .op9 import op9_pii
from .op10 import op10_webp_media

QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_best_fit_packing, op3_substring_dedup, op4_toxicity, op5_license_scan, op6_warc_derivatives, op7_jaccard_join, op8_secret_scan, op9_pii, op10_webp_media)
}
ORACLES: dict[str, str] = {
    "op3_substring_dedup": oracles.OP3,
    "op5_license_scan": op5.oracle(),
    "op7_jaccard_join": oracles.OP7,
    "op8_secret_scan": oracles.op8(),
}
