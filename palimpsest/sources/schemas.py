"""Schemas of the store's tables (JSON columns become real nested types)."""

from __future__ import annotations

TABLES = {
    "pipeline_runs": "run_id string, asset_ref string, asset_sha256 string, status string, current_stage string, ocr_text string, proofread_text string, warnings array<string>, ocr_lines array<string>, quality_label string, created_at timestamp, updated_at timestamp",
    "pipeline_events": "id long, run_id string, ts timestamp, stage string, event string, message string",
    "chunks": "chunk_id string, run_id string, idx int, start_offset int, end_offset int, text string, created_at timestamp",
    "entity_mentions": "mention_id string, run_id string, chunk_id string, start_offset int, end_offset int, surface string, norm string, label string, ent_type string, confidence double, method string, notes string",
    "entity_candidates": "cand_id string, mention_id string, source string, candidate string, score double, meta map<string,string>",
    "entity_decisions": "decision_id string, run_id string, span_key string, surface string, ent_type string, status string, reason string, start_offset int, end_offset int, meta map<string,string>",
    "entity_attempts": "attempt_id string, decision_id string, attempt_idx int, candidate string, score double, outcome string, meta map<string,string>",
    "ocr_quality_reports": "report_id string, run_id string, pass_idx int, quality_label string, gibberish_score double, non_wordlike_frac double, leading_fragment_ratio double, seam_fragment_ratio double, uncertainty_density double, cross_pass_stability double, token_search_allowed boolean, ner_allowed boolean, detail array<struct<line_idx:int,text:string,gibberish_score:double>>, created_at timestamp",
    "tile_audit": "tile_id string, run_id string, pass_idx int, tile_idx int, x1 int, y1 int, x2 int, y2 int, meta map<string,string>",
    "ocr_attempts": "attempt_id string, run_id string, attempt_idx int, strategy string, gates_passed boolean, text_sha256 string, tile_boxes array<array<int>>, quality_label string, created_at timestamp",
    "ocr_backend_results": "result_id string, run_id string, page_id string, region_id string, backend_name string, model_name string, confidence double, selected boolean, text string, raw map<string,string>, created_at timestamp",
    "ocr_benchmark_references": "benchmark_id string, run_id string, page_id string, source_label string, reference_text string, created_at timestamp",
    "authority_entities": "entity_id string, authority_source string, authority_id string, wikidata_qid string, viaf_id string, geonames_id string, canonical_label string, normalized_label string, entity_type string, description string, created_at timestamp, updated_at timestamp",
    "authority_aliases": "alias_id string, entity_id string, alias string, normalized_alias string, alias_source string",
    "authority_source_assertions": "assertion_id string, entity_id string, source_name string, property_name string, property_value string",
    "evidence_spans": "span_id string, run_id string, asset_ref string, page_id string, region_id string, chunk_id string, mention_id string, raw_text string, normalized_text string, start_offset int, end_offset int, bbox array<double>, polygon array<array<double>>, created_at timestamp, updated_at timestamp",
    "mention_links": "link_id string, mention_id string, entity_id string, evidence_span_id string, confidence double, link_status string, type_compatible boolean, reason string, score_breakdown map<string,double>, created_at timestamp, updated_at timestamp",
}
