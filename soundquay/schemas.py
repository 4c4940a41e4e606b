"""Explicit schemas (DDL) of the tables that are read and written."""

from __future__ import annotations

MANIFEST = (
    "utterance_id string, path string, lang string, text string, duration_s double, "
    "source string, accent string, clean_id string, noise_subtype string, noise_level string, "
    "noise_clip_id string, snr_db_target double, snr_db_achieved double, mix_seed bigint, "
    "keywords array<string>"
)
NOISE_BANK = (
    "clip_id string, subtype string, path string, duration_s double, source string, "
    "license string, split string, recording_id string"
)
SEGMENTS = (
    "array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>>"
)
INTERVALS = "array<struct<start:double,end:double>>"
LATENCY = "struct<vad:double,preprocess:double,asr:double,keydetector:double,total:double>"
TELEMETRY = (
    "ts timestamp, trace_id string, store_id string, duration_s double, speech_ratio double, "
    "noise_pred string, noise_confidence double, chain_applied array<string>, language string, "
    "avg_logprob double, guard_flags array<string>, rules_fired array<string>, "
    f"latency_ms {LATENCY}, model_version string"
)
RULES = (
    "id string, lang string, wrong string, right string, scope string, "
    "context_any array<string>, context_none array<string>, status string, "
    "provenance struct<source:string,evidence_count:bigint,added:string>, notes string"
)
UTTERANCES = (
    "utterance_id string, path string, lang string, store_id string, captured_at string, "
    "duration_s double, speech_ratio double, meta_json string"
)
TRANSCRIPTIONS = (
    "id bigint, utterance_id string, model_version string, raw_text string, final_text string, "
    "avg_logprob double, guard_flags_json string, created_at string"
)
CORRECTION_ROWS = (
    "id bigint, transcription_id bigint, rule_id string, before string, after string, "
    "confidence double"
)
VERDICTS = (
    "id bigint, transcription_id bigint, verdict string, corrected_reference string, "
    "confusion_json string, order_core_match boolean, confidence double, created_at string"
)
REVIEW_QUEUE = (
    "id bigint, transcription_id bigint, reason string, status string, reviewer_note string, "
    "resolved_at string"
)
METRIC_RUNS = (
    "run_id string, model_version string, dataset_id string, metrics_json string, "
    "created_at string"
)
POS_TICKETS = "order_id string, store_id string, items_json string, created_at string"
CYCLE_STATE = "cycle_id string, step string, data_json string, created_at string"
EFFECTIVENESS = (
    "lang string, subtype string, level string, chain string, wer double, ker double, n bigint, "
    "latency_ms double"
)
