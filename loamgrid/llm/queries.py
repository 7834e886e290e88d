"""The registered queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from loamgrid.llm import bpe_codec, decontaminate, fill_in_middle, language_id, license_scan, merkle_manifest, ngram_join, packing, quality_classifier, quality_rules, secret_scan, sharding, token_counts


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_bpe_codec": bpe_codec.op7_bpe_codec,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_language_id": language_id.op9_language_id,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.ORACLE, "op12_merkle_manifest": merkle_manifest.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE}
