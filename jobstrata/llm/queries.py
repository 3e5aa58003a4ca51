"""The thin queries ``opN_<name>`` and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op3_bpe
from .fingerprints import op6_fingerprints
from .licenses import op7_licenses
from .minhash import op2_minhash
from .packing import op4_packing
from .periods import op12_periods
from .pii import op10_pii
from .prefixtrie import OP11_SQL, op11_prefixtrie
from .quality import op1_quality
from .rankarray import op13_rankarray
from .rules import OP8_SQL, op8_rules
from .suffixes import op9_suffixes
from .tokenfiles import op5_tokens

QUERIES = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_tokens": op5_tokens,
    "op6_fingerprints": op6_fingerprints,
    "op7_licenses": op7_licenses,
    "op8_rules": op8_rules,
    "op9_suffixes": op9_suffixes,
    "op10_pii": op10_pii,
    "op11_prefixtrie": op11_prefixtrie,
    "op12_periods": op12_periods,
    "op13_rankarray": op13_rankarray,
}

SQL = {"op8_rules": OP8_SQL, "op11_prefixtrie": OP11_SQL}
