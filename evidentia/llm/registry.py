"""Queries of this subpackage, by name, with SQL where SQL can say the same."""

from __future__ import annotations

from . import centroids, decontaminate, infill, licenses, media, packing, quality, sharding, simhash, substrings, tokencounts, urls, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_token_counts": tokencounts.op3_token_counts,
    "op4_iso_media": media.op4_iso_media,
    "op5_warc_normaliser": warc.op5_warc_normaliser,
    "op6_lpt_sharding": sharding.op6_lpt_sharding,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_elkan_clusters": centroids.op11_elkan_clusters,
    "op12_url_filter": urls.op12_url_filter,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.oracle_sql(),
    "op5_warc_normaliser": warc.oracle_sql(),
    "op7_substring_dedup": substrings.oracle_sql(),
    "op9_decontaminate": decontaminate.oracle_sql(),
    "op11_elkan_clusters": centroids.oracle_sql(),
    "op12_url_filter": urls.oracle_sql(),
    "op13_fill_in_middle": infill.oracle_sql(),
}
