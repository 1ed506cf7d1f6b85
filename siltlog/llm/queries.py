"""Registry of the corpus queries; ``oracle_sql`` holds DuckDB SQL where SQL can express one."""

from __future__ import annotations

from .language_id import op1_language_id
from .minhash import op7_minhash
from .packing import op9_packing
from .permutation_index import op4_permutation_index
from .piece_lattice import op5_piece_lattice
from .pii import op8_pii
from .suffix_array import op2_suffix_array
from .token_counts import op3_token_counts
from .topk import OP6_SQL, op6_topk
from .toxicity import op10_toxicity


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_array": op2_suffix_array,
        "op3_token_counts": op3_token_counts,
        "op4_permutation_index": op4_permutation_index,
        "op5_piece_lattice": op5_piece_lattice,
        "op6_topk": op6_topk,
        "op7_minhash": op7_minhash,
        "op8_pii": op8_pii,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL}
