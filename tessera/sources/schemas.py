"""Spark schemas of the data model."""

from __future__ import annotations

REPO = "struct<url: string, commit: string, snapshot_sha256: string, docker_image: string>"
TASK = f"task_id string, dataset_version string, task_type string, question string, repo {REPO}, gold string, needle string, scoring string, canary string, license string, meta map<string, string>"
TELEMETRY = "struct<input_tokens_norm: bigint, output_tokens_norm: bigint, cache_tokens_norm: bigint, build_tokens_norm: bigint, native_input: bigint, native_output: bigint, latency_ms: bigint, trace_uri: string>"
PROVIDER = "struct<name: string, version: string, config: variant>"
SCORE = "struct<correct: boolean, raw: double, scorer: string>"
RUN_RECORD = f"run_id string, task_id string, dataset_version string, harness_version string, provider {PROVIDER}, model string, repeat bigint, seed bigint, telemetry {TELEMETRY}, score {SCORE}, timestamp timestamp"
DIMS = "struct<correctness: int, completeness: int, faithfulness: int, _parse_error: boolean>"
VOTE = f"struct<dims: {DIMS}, rationale: string, passed: boolean, raw_response: string, prompt: string>"
JUDGE_AUDIT = f"judge_run_id string, rubric_version string, judge_model string, task_id string, dataset_version string, candidate string, n_votes int, majority_pass boolean, confidence double, votes array<{VOTE}>, timestamp timestamp"
HUMAN_LABEL = "task_id string, label string, annotator_id string, timestamp string, rationale string"
CANDIDATE = "task_id string, candidate string, source string"
QUESTION = "task_id string, repo_id string, question string, reference string, difficulty string, meta map<string, string>"
USAGE = "ts timestamp, model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, total_tokens bigint, latency_ms bigint, response_id string"
GRAPH = "nodes array<struct<id: string, label: string, source_file: string, source_location: string>>, links array<struct<source: string, target: string, relation: string>>"
REPO_PIN = "short_id string, url string, commit string, license string, language string, snapshot_sha256 string"

# The enumerations of the data model.
TASK_TYPES = ("needle_function", "repo_qa", "patch")
SCORERS = ("auto_contains", "unit_test", "llm_judge")
