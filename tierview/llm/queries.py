"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, hilbert, language, minhash, multiindex, ogg, packing, passages, rotation, suffix

QUERIES = {
    f.__name__: f
    for f in (
        rotation.op1_perspective_rotation,
        hilbert.op2_hilbert_shards,
        multiindex.op3_inverted_multi_index,
        packing.op4_dominance_packing,
        passages.op5_collinear_passages,
        bpe.op6_speculative_bpe,
        ogg.op7_ogg_media,
        minhash.op8_bayesian_minhash,
        language.op9_byte_cnn_language,
        suffix.op10_suffix_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_perspective_rotation": rotation.SQL}
