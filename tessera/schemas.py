"""Row types of the data model; keys are (document_id, role, canonical_value)."""

from __future__ import annotations

SOURCE_FRAME = "document_id string, text string, token_count int, tokenizer string, window_tokens int, truncated boolean, sha256 string, section string, metadata map<string,string>"
SPAN = "struct<start:int,end:int>"
ATOM = f"document_id string, atom_id string, role string, canonical_value string, surface_form string, local_context string, verification string, char_start int, char_end int, token_start int, token_end int, sentence_index int, occurrence_count int, metadata struct<subtype:string,all_spans:array<{SPAN}>>"
FOCAL = "document_id string, atom_id string, role string, pi double, stratum_size int, populated_strata int, k int"
RECORD = "document_id string, atom_id string, role string, pi double, q double, transmitted int, r_minus double, d_plus double, method string, edit_mechanism string, eligible boolean"
HANDOFF = "document_id string, text string, input_tokens int, output_tokens int, latency_s double, method string, revision string, configuration_hash string, warnings array<string>, budget int"
BUDGET_NEUTRAL = "document_id string, atom_id string, role string, transmitted int, delta_budget double, rendered_tokens int, evicted_atom_id string, value double"
PROVIDER_CALL = "call_id string, provider string, model string, status string, attempt int, input_tokens int, output_tokens int, reasoning_tokens int, cached_tokens int, latency_s double, timestamp_utc string"
RUN_EVENT = "run_id string, sequence long, stage string, payload map<string,string>, timestamp_utc string"
OUTCOME = "document_id_hash string, split string, policy_id string, receiver_id string, receiver_config_hash string, logical_evaluation_id string, raw_response_sha256 string, metric_name string, metric_value double, evaluable_status string, evidence_stratum string, realized_tokens int, outer_fold int, decoder_replicate_ids array<string>"

#: The roles in overlap order.
ROLES = ("entity", "scope", "period", "numeric", "provenance")
