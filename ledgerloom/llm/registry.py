"""The queries of this subpackage and their SQL, by name."""

from . import context_tree, exact_dedup, fingerprints, html_extract, licenses, merkle, mixing, near_dedup, packing, pii, top_k, toxicity, whitening

QUERIES = {
    "op1_multiset_fingerprints": fingerprints.op1_multiset_fingerprints,
    "op2_personal_data": pii.op2_personal_data,
    "op3_context_tree_scores": context_tree.op3_context_tree_scores,
    "op4_license_templates": licenses.op4_license_templates,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_html_main_text": html_extract.op7_html_main_text,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_source_mix": mixing.op10_source_mix,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_exact_top_k": top_k.op13_exact_top_k,
}
SQL = {
    "op4_license_templates": licenses.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op10_source_mix": mixing.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_exact_top_k": top_k.SQL,
}
