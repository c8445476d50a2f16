"""Schemas of the reconciliation tables, and checks in place of database constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = {
    "objects": "id string, code string, name string, address string, created_at timestamp",
    "processes": "id string, object_id string, status string, scenario string, created_at timestamp, updated_at timestamp",
    "files": "file_id string, process_id string, object_id string, file_name string, sha256 string, size bigint, page_count int, doc_stage string, discipline string, document_code string, revision string, approval_status string, approval_date date, predecessor_id string, successor_id string, signature_status string, check_status string, is_current boolean, selection_status string, selection_reason string, uploaded_at timestamp",
    "upload_status": "process_id string, doc_stage string, upload_status string",
    "parse_jobs": "job_id string, process_id string, file_id string, page_from int, page_to int, status string, quality string, layout_key string",
    "params": "code string, name string, unit string, section string, priority string, data_type string, matrix_version string, is_active boolean",
    "evidence_groups": "group_id string, process_id string, param_code string, element_key string",
    "evidence_fragments": "fragment_id string, group_id string, file_id string, role string, page int, bbox array<double>, quote string",
    "checks": "check_id string, group_id string, rule_type string, expected_value string, actual_value string, delta string, rationale string, input_hash string",
    "findings": "id string, check_id string, process_id string, finding_status string, inspector_status string, review_priority string, version int",
    "protocols": "protocol_id string, process_id string, version int, status string, sync_status string",
    "outbox": "event_id string, event_type string, key string, payload string, status string, attempts int, available_at timestamp, locked_at timestamp, created_at timestamp",
    "registry_entries": "id string, process_id string, raw string, file_id string, match_status string",
    "extract_jobs": "id string, process_id string, params array<string>, status string, attempts int, facts_key string, started_at timestamp, finished_at timestamp, last_error string",
    "facts": "id string, process_id string, object_id string, file_id string, file_sha256 string, stage string, param_code string, rule_code string, element_key string, value_raw string, value_norm string, unit string, page int, bbox array<double>, quote string, confidence double, method string, extractor_version string, has_change_notice boolean",
    "suspicions": "id string, process_id string, object_id string, discovery_method string, confidence double, description string, pd_reference string, rd_reference string, review_priority string, normative_base string, finding_status string, inspector_status string, evidence string",
    "normative_base": "id string, document_name string, document_number string, section string, parameter_name string, min_value double, max_value double, effective_from date, effective_to date",
    "logical_rules": "id string, rule_name string, condition string, expected string, normative_base string, is_active boolean",
    "audit_log": "id bigint, user_id string, action string, object_type string, object_id string, details string, before string, after string, ip string, user_agent string, request_id string, ts timestamp",
    "processed_events": "consumer string, event_id string, processed_at timestamp",
    "users": "id string, login string, password_hash string, full_name string, role string, is_active boolean, created_at timestamp",
    "idempotency_keys": "key string, user_id string, request_hash string, response_status int, response_body string, created_at timestamp, expires_at timestamp",
    "monitoring_metrics": "id bigint, metric string, value double, labels string, recorded_at timestamp",
    "rejection_log": "id string, violation_id string, rejection_reason string, ai_verdict string, suggested_fix string, retraining_status string",
    "dispute_log": "id string, violation_id string, inspector_comment string, ai_comment string, resolution_status string, resolved_by string",
    "model_versions": "model_version string, artifact_hash string, dataset_version string, metrics_json string, approval_status string, approved_by string, deployed_at timestamp, rollback_to string",
    "dataset_items": "id string, evidence_group_id string, gold_label string, expert_id string, reason_code string, dataset_version string, split string, object_group_id string, created_at timestamp",
    "ml_retraining_log": "id string, model_version string, dataset_version string, split_hashes string, precision double, recall double, f1 double, false_positive_rate double, per_category_metrics string, approval_status string, approved_by string",
}

# Unique keys, references (column > table.column) and value lists of the tables.
KEYS = {
    "objects": "id", "processes": "id", "files": "file_id|process_id sha256", "upload_status": "process_id doc_stage", "parse_jobs": "job_id", "params": "code", "evidence_groups": "group_id", "evidence_fragments": "fragment_id",
    "checks": "check_id", "findings": "id", "protocols": "protocol_id|process_id version", "outbox": "event_id", "registry_entries": "id", "extract_jobs": "id", "facts": "id", "suspicions": "id", "normative_base": "id", "logical_rules": "id",
    "audit_log": "id", "processed_events": "consumer event_id", "users": "id|login", "idempotency_keys": "key", "monitoring_metrics": "id", "rejection_log": "id", "dispute_log": "id", "model_versions": "model_version", "dataset_items": "id", "ml_retraining_log": "id",
}
REFERENCES = {
    "processes": "object_id>objects.id", "files": "object_id>objects.id process_id>processes.id predecessor_id>files.file_id successor_id>files.file_id", "registry_entries": "process_id>processes.id file_id>files.file_id", "upload_status": "process_id>processes.id",
    "parse_jobs": "process_id>processes.id file_id>files.file_id", "extract_jobs": "process_id>processes.id", "facts": "process_id>processes.id object_id>objects.id file_id>files.file_id", "suspicions": "process_id>processes.id object_id>objects.id",
    "evidence_groups": "process_id>processes.id", "evidence_fragments": "group_id>evidence_groups.group_id file_id>files.file_id", "checks": "group_id>evidence_groups.group_id", "findings": "check_id>checks.check_id", "protocols": "process_id>processes.id",
    "audit_log": "user_id>users.id", "idempotency_keys": "user_id>users.id", "rejection_log": "violation_id>findings.id", "dispute_log": "violation_id>findings.id resolved_by>users.id", "model_versions": "approved_by>users.id rollback_to>model_versions.model_version",
    "dataset_items": "evidence_group_id>evidence_groups.group_id expert_id>users.id", "ml_retraining_log": "model_version>model_versions.model_version approved_by>users.id",
}
LISTED = {
    "processes": "status=process_status scenario=scenario", "files": "doc_stage=doc_stage check_status=check_status approval_status=approval_status", "upload_status": "doc_stage=doc_stage upload_status=upload_status", "parse_jobs": "quality=quality",
    "findings": "finding_status=finding_status inspector_status=inspector_status", "protocols": "status=protocol_status sync_status=sync_status", "outbox": "status=outbox_status", "facts": "stage=doc_stage", "users": "role=role", "dataset_items": "reason_code=reason_code",
}

# Allowed values of the status columns.
ALLOWED = {
    "process_status": "PENDING PARSING READY VERIFYING COMPLETED FINALIZED",
    "scenario": "FULL PD_RD_ONLY PD_ID_ONLY RD_ID_ONLY SINGLE_ONLY PARTIALLY_LOADED",
    "doc_stage": "PD RD ID",
    "upload_status": "UPLOADED PARTIAL MISSING",
    "check_status": "UPLOADING UPLOADED REJECTED_FORMAT REJECTED_SIZE REJECTED_CORRUPTED REJECTED_VIRUS ACCEPTED",
    "approval_status": "DRAFT APPROVED FOR_CONSTRUCTION SUPERSEDED CANCELLED",
    "finding_status": "NEGATIVE_VERIFIED CANDIDATE CONFIRMED_VIOLATION MISSING_EVIDENCE NOT_APPLICABLE NOT_COMPARABLE CLARIFICATION_REQUIRED SUSPICION",
    "inspector_status": "PENDING CONFIRMED_VIOLATION NEGATIVE_VERIFIED CLARIFICATION_REQUIRED",
    "reason_code": "WRONG_REVISION APPROVED_CHANGE OCR_ERROR LINKING_ERROR NOT_APPLICABLE DUPLICATE OTHER",
    "quality": "OK LOW_QUALITY ABSTAIN FAILED",
    "protocol_status": "DRAFT VERIFICATION_COMPLETED PROTOCOL_FINALIZED",
    "sync_status": "NOT_REQUIRED PENDING_SYNC SYNCED SYNC_FAILED",
    "outbox_status": "pending publishing published failed",
    "role": "inspector supervisor admin ml_engineer",
}


def allowed(kind: str, x: Column) -> Column:
    """Null passes, as a database check does."""
    return x.isNull() | x.isin(*ALLOWED[kind].split())


def violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows with a value that isn't allowed; ``checks`` maps columns to kinds."""
    return df.where(~reduce(lambda a, b: a & b, (allowed(kind, F.col(c)) for c, kind in checks.items())))
