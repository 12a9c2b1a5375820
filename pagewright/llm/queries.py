"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .backoff import OP6_SQL, op6_stupid_backoff
from .decontaminate import op9_latent_decontamination
from .jpeg import op1_progressive_jpeg
from .language import op5_language_kneser_ney
from .licenses import op7_license_join
from .minhash import OP4_SQL, op4_minhash_near_duplicates
from .pieces import op3_lattice_pieces
from .pii import op2_contextual_pii
from .resample import OP11_SQL, op11_importance_resampling
from .secret_scan import op13_secret_crf
from .sharding import op8_balanced_sharding
from .suffixes import op10_column_bwt_dedup
from .trie import OP12_SQL, op12_conversation_trie

QUERIES = {f.__name__: f for f in (op1_progressive_jpeg, op2_contextual_pii, op3_lattice_pieces, op4_minhash_near_duplicates, op5_language_kneser_ney, op6_stupid_backoff, op7_license_join, op8_balanced_sharding, op9_latent_decontamination, op10_column_bwt_dedup, op11_importance_resampling, op12_conversation_trie, op13_secret_crf)}
ORACLES: dict[str, str] = {"op4_minhash_near_duplicates": OP4_SQL, "op6_stupid_backoff": OP6_SQL, "op11_importance_resampling": OP11_SQL, "op12_conversation_trie": OP12_SQL}
