"""The queries of this subpackage and their SQL, for the driver entry."""

from __future__ import annotations

from . import byte_bpe, concurrency, decontamination, itq, line_crf, line_dedup, mixing, quality_rules, simhash, token_files, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_line_crf": line_crf.op3_line_crf,
    "op4_token_files": token_files.op4_token_files,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_itq": itq.op6_itq,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mixing": mixing.op10_mixing,
    "op11_open_sales": concurrency.op11_open_sales,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_itq": itq.OP6_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_open_sales": concurrency.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
