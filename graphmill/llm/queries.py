"""The queries of this subpackage, by name, and their SQL where SQL can express them."""
from . import codes, exact_dedup, html_extract, kneser_ney, line_dedup, mixing, near_dedup, packing, quality, rules, suffix_dedup, trie, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (quality.op1_quality, warc.op2_warc, packing.op3_packing, mixing.op4_mixing, suffix_dedup.op5_suffix_dedup, rules.op6_quality_rules, near_dedup.op7_near_dedup, html_extract.op8_html_extraction, exact_dedup.op9_exact_dedup, line_dedup.op10_line_dedup, codes.op11_vector_codes, trie.op12_prefix_trie, kneser_ney.op13_kneser_ney)} | {"pipeline": pipeline}

SQL = {"op2_warc": warc.OP2_SQL, "op4_mixing": mixing.OP4_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op11_vector_codes": codes.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL}
