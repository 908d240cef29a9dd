"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

import functools

from quarry import ship
from quarry.llm import bpe, divergence, exact_dedup, jaccard_join, jpeg_media, language_crf, lbl, packing, spelling, token_binary, token_counts, toxicity, warc


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_token_binary": _shipped(token_binary.op1_token_binary),
    "op2_jaccard_join": _shipped(jaccard_join.op2_jaccard_join),
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_counts": _shipped(token_counts.op4_token_counts),
    "op5_media": _shipped(jpeg_media.op5_media),
    "op6_best_fit_packing": _shipped(packing.op6_best_fit_packing),
    "op7_toxicity": _shipped(toxicity.op7_toxicity),
    "op8_bpe": _shipped(bpe.op8_bpe),
    "op9_lm_scores": _shipped(lbl.op9_lm_scores),
    "op10_language_id": _shipped(language_crf.op10_language_id),
    "op11_spelling_variants": _shipped(spelling.op11_spelling_variants),
    "op12_source_divergence": _shipped(divergence.op12_source_divergence),
    "op13_warc": _shipped(warc.op13_warc),
}
SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_warc": warc.OP13_SQL}
