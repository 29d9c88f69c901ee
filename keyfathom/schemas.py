"""Table schemas; readers always get one, nothing is inferred."""

from __future__ import annotations

FILES = "repo_id string, file_path string, content string"

FINDINGS = (
    "finding_id string, scan_run_id string, repo_id string, file_path string, line_number int, "
    "algorithm string, algo_type string, context string, context_start_line int, risk_level string, "
    "quantum_status string, quantum_safe boolean, nist_replacement string, migration_status string, "
    "resolved_at timestamp, resolved_by string, resolution_note string, migrated_to string, "
    "source_type string, dependency_name string, dependency_version string, ecosystem string, "
    "ai_validated boolean, ai_label string, ai_confidence double, ai_explanation string, "
    "archived boolean, archived_at timestamp, archived_by string, reachable boolean, "
    "call_depth int, call_chain array<string>, in_test_path boolean, created_at timestamp")

SECRETS = (
    "secret_id string, scan_run_id string, repo_id string, file_path string, line_number int, "
    "finding_type string, algorithm string, key_size int, curve string, quantum_status string, "
    "risk_level string, nist_replacement string, subject string, issuer string, not_before timestamp, "
    "not_after timestamp, expiry_status string, serial string, config_key string, config_value string, "
    "context string, migration_status string, archived boolean")

SCAN_RUNS = ("scan_run_id string, repo_id string, status string, scan_type string, started_at timestamp, "
             "completed_at timestamp, total_files long, scanned_files long, total_findings long")

REPOS = ("repo_id string, project_id string, name string, url string, branch string, risk_level string, "
         "last_scanned_at timestamp, agility_level int, agility_label string, agility_score long, "
         "has_hybrid boolean")

CVES = ("finding_id string, cve_id string, summary string, cvss_score double, cvss_severity string, "
        "source string")

GATE_CONFIGS = ("repo_id string, fail_on_broken boolean, fail_on_vulnerable boolean, fail_on_weak boolean, "
                "fail_on_critical boolean, fail_on_high boolean")

RAW_EVENTS = "host_id string, timestamp_ns long, pid long, tid long, probe_id long, comm string"

RUNTIME_REPORT = (
    "host_id string, received_at timestamp, hostname string, agent_version string, kernel_info string, "
    "findings array<struct<algorithm:string,symbol:string,library:string,process_name:string,pid:long,"
    "occurrences:long,first_seen:timestamp,last_seen:timestamp>>")

TLS_OBSERVATIONS = (
    "finding_id string, endpoint_raw string, scan_status string, tls_version string, cipher_name string, "
    "cipher_bits int, key_type string, key_size int, key_curve string, sig_algorithm string, "
    "cert_subject string, cert_issuer string, cert_not_before timestamp, cert_not_after timestamp")

ADVISORIES = ("id string, ecosystem string, package string, summary string, details string, "
              "aliases array<string>, severity array<string>")

WEBHOOKS = "delivery_id string, repo_id string, provider string, event_type string, body string, received_at timestamp"

MEMBERS = ("artifact_id string, artifact_name string, jar string, layer int, file_path string, "
           "size long, content binary")
