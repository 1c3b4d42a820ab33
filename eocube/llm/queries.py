"""Queries over the given tables, one for each operator, and SQL for those that SQL can express."""

from .alignment import op13_cross_tokenizer
from .byte_bpe import op3_byte_bpe
from .decontaminate import ORACLE_OP2, op2_decontamination
from .golay_dedup import op9_near_duplicates
from .huffman import op4_huffman
from .licenses import ORACLE_OP7, op7_license_scan
from .merkle import ORACLE_OP12, op12_merkle_manifest
from .minhash_join import op11_minhash_join
from .pii import op6_pii_surrogates
from .quality_classifier import op8_quality_classifier
from .quality_rules import op5_quality_rules
from .sharding import op10_sharding
from .token_counts import op1_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontamination, op3_byte_bpe, op4_huffman, op5_quality_rules,
        op6_pii_surrogates, op7_license_scan, op8_quality_classifier, op9_near_duplicates, op10_sharding,
        op11_minhash_join, op12_merkle_manifest, op13_cross_tokenizer,
    )
}
ORACLE = {"op2_decontamination": ORACLE_OP2, "op7_license_scan": ORACLE_OP7, "op12_merkle_manifest": ORACLE_OP12}
