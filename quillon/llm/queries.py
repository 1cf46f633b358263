"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .divergence import OP13_SQL, op13_divergence
from .exact import OP10_SQL, op10_exact_dedup
from .html import op6_html
from .langid import op7_langid
from .licenses import OP2_SQL, op2_licenses
from .mixing import op1_mixing
from .quality import OP4_SQL, op4_quality
from .simhash import op8_simhash
from .slots import op11_sharding
from .sstable import op9_sstable
from .token_counts import op3_token_counts
from .whitening import op12_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_licenses": op2_licenses,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_html": op6_html,
    "op7_langid": op7_langid,
    "op8_simhash": op8_simhash,
    "op9_sstable": op9_sstable,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op2_licenses": OP2_SQL,
    "op4_quality": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op13_divergence": OP13_SQL,
}
