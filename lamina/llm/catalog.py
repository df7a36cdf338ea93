"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontamination, html, jaccard, licenses, lines, oracle, packing, quality, sharding, urls, warc




def queries() -> dict:
    return {
        "op1_best_fit_shards": sharding.op1_best_fit_shards,
        "op2_url_cascade": urls.op2_url_cascade,
        "op3_license_diagonals": licenses.op3_license_diagonals,
        "op4_minhash_lines": lines.op4_minhash_lines,
        "op5_pattern_packing": packing.op5_pattern_packing,
        "op6_parity_jaccard": jaccard.op6_parity_jaccard,
        "op7_host_quality": quality.op7_host_quality,
        "op8_warc_roundtrip": warc.op8_warc_roundtrip,
        "op9_prefix_decontamination": decontamination.op9_prefix_decontamination,
        "op10_lstm_extraction": html.op10_lstm_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.QUERIES)
