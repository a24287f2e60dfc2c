"""The queries of this package and their DuckDB SQL."""

from clausespark.llm import bitslice, bpe, infill, jaccard, line_dedup, packing, quality_rules, simhash, suffix_dedup, token_files, topk, url_rules, warc


def queries() -> dict:
    return {
        "op1_warc_revisits": warc.op1_warc_revisits,
        "op2_packing": packing.op2_packing,
        "op3_url_rules": url_rules.op3_url_rules,
        "op4_token_files": token_files.op4_token_files,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_block_topk": topk.op8_block_topk,
        "op9_simhash": simhash.op9_simhash,
        "op10_bpe": bpe.op10_bpe,
        "op11_jaccard_join": jaccard.op11_jaccard_join,
        "op12_lexical_search": bitslice.op12_lexical_search,
        "op13_fill_in_middle": infill.op13_fill_in_middle,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc_revisits": warc.OP1_SQL,
        "op3_url_rules": url_rules.OP3_SQL,
        "op8_block_topk": topk.OP8_SQL,
        "op12_lexical_search": bitslice.OP12_SQL,
        "op13_fill_in_middle": infill.OP13_SQL,
    }
