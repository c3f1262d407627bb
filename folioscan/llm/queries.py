"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chat_format, fingerprints, langid, licenses, mixing, packing, periodic, pii, quality, simhash, spelling, toxicity, url_filter

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_personal_data": pii.op3_personal_data,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_language_id": langid.op7_language_id,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_near_duplicates": simhash.op10_near_duplicates,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.OP2_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op8_quality_rules": quality.OP8_SQL,
}
