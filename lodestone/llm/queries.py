"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from .bpe import op5_bpe
from .collocations import OP11_SQL, op11_collocations
from .embeddings import OP1_SQL, op1_embeddings
from .language_id import op7_language_id
from .line_dedup import OP12_SQL, op12_line_dedup
from .minhash import op6_minhash
from .packing import op3_packing
from .pipeline import run as pipeline
from .quality_cnn import op8_quality_cnn
from .quality_rules import OP2_SQL, op2_quality_rules
from .repeats import op10_repeats
from .resampling import op13_resampling
from .token_files import op9_token_files
from .url_filter import op4_url_filter

QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op6_minhash": op6_minhash,
    "op7_language_id": op7_language_id,
    "op8_quality_cnn": op8_quality_cnn,
    "op9_token_files": op9_token_files,
    "op10_repeats": op10_repeats,
    "op11_collocations": op11_collocations,
    "op12_line_dedup": op12_line_dedup,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_embeddings": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op11_collocations": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
}
