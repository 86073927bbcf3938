"""Canonical table schemas."""

from __future__ import annotations

TRANSCRIPTS = (
    "call_id string, path string, file_name string, uploaded_at timestamp, "
    "size_bytes bigint, raw string"
)
TURNS = "call_id bigint, turn bigint, speaker string, text string"
JOBS = (
    "job_id string, job_type string, status string, started_at timestamp, "
    "completed_at timestamp, progress int, error string"
)
METRICS = (
    "metric_name string, component string, environment string, value double, ts timestamp"
)
EVENTS = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)

# The stored result document of one call.
ANALYSIS = (
    "call_id string, file_name string, processing_id string, text string, word_count bigint, "
    "duration_minutes double, "
    "sentiment struct<score: double, confidence: double, emotions: map<string, double>>, "
    "topics array<struct<name: string, relevance: double>>, "
    "speakers array<struct<speaker: string, role: string, turn_count: bigint, word_count: bigint, "
    "share_pct: double, positive_share: double, negative_share: double, neutral_share: double, "
    "engagement: double, concerns: array<string>>>, "
    "moments array<struct<phrase: string, context: string, t: double, intensity: double, "
    "topic: string, speaker: string, follow_up: string>>, "
    "lead struct<class: string, score: double, confidence: double, interest: array<string>, "
    "buying: array<string>, concerns: array<string>, personality: string, decision: string, "
    "strategy: string, next_actions: array<string>, risk_factors: array<string>, "
    "conversion_probability: double>, "
    "key_phrases array<string>, technical_terms array<string>, competitors array<string>, "
    "pricing array<string>, objections array<string>, "
    "flow struct<total_sentences: bigint, average_sentence_length: double, "
    "question_count: bigint, exclamation_count: bigint, conversation_pace: string>, "
    "timeline array<struct<t: double, v: double>>, "
    "questions struct<total_questions: bigint, open_ended: bigint, yes_no: bigint, "
    "clarifying: bigint, sample_questions: array<string>>, "
    "confidences map<string, double>"
)
