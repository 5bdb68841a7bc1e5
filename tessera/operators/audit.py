"""Audit rules over run records and judge logs; each finding has code, severity, provider, task_id, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import injected, injection_evidence

FLOOR_TOLERANCE = 0.20
# The config markers that the rules look for.
GAMING_POLICY = "rule_respecting_output_gaming"
GAMING_TACTICS = ("candidate_dump", "judge_injection", "lexical_overlap", "gold_leak", "needle_dump", "harness_path_exfil")
BREACH_KEYS = ("reads_gold", "reads_needle")
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")


def _findings(df: DataFrame, code: str, severity, provider, task_id, evidence) -> DataFrame:
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return df.select(F.lit(code).alias("code"), lit(severity).alias("severity"), lit(provider).cast("string").alias("provider"), lit(task_id).cast("string").alias("task_id"), lit(evidence).alias("evidence"))


def first_configs(runs: DataFrame, order: str) -> DataFrame:
    """The first config that is not empty of each provider and version (config is JSON text)."""
    filled = runs.where("config IS NOT NULL AND config NOT IN ('', '{}')")
    return filled.groupBy("provider", "version").agg(F.min_by("config", order).alias("config"))


def config_findings(runs: DataFrame, order: str = "seq") -> DataFrame:
    """Providers whose config declares that they game the benchmark."""
    configs = first_configs(runs, order).withColumn("_v", F.try_parse_json("config"))
    out = None
    for key in BREACH_KEYS:
        text = F.try_variant_get("_v", f"$.{key}", "string")
        hit = _findings(configs.where(text.isNotNull() & ~text.isin("false", "0", "", "[]", "{}")), "C1.gaming_config", "HIGH", F.col("provider"), None, F.lit(key))
        out = hit if out is None else out.unionByName(hit)
    policy = F.try_variant_get("_v", "$.policy", "string") == GAMING_POLICY
    low = _findings(configs.where(policy), "C1.gaming_config", "LOW", F.col("provider"), None, F.lit("policy"))
    listed = F.filter(F.try_variant_get("_v", "$.tactics", "array<string>"), lambda t: t.isin(*GAMING_TACTICS))
    known = configs.withColumn("_t", listed).where(F.size("_t") > 0)
    medium = _findings(known, "C1.gaming_config", "MEDIUM", F.col("provider"), None, F.array_join("_t", ","))
    return out.unionByName(low).unionByName(medium)


def injection_findings(audit: DataFrame, runs: DataFrame, order: str = "seq") -> DataFrame:
    """Candidates that address the judge, laid to the last run of the same log and task if there is one."""
    hits = audit.where(injected(F.col("candidate"))).withColumn("evidence", injection_evidence(F.col("candidate")))
    owners = runs.groupBy(F.col("trace_uri").alias("uri"), "task_id").agg(F.max_by("provider", order).alias("provider"))
    return _findings(hits.join(owners, ["uri", "task_id"], "left"), "C2.judge_injection", "HIGH", F.col("provider"), F.col("task_id"), F.col("evidence"))


def floor_findings(runs: DataFrame, claims: Sequence[str], floor: str = "zero-context", tolerance: float = FLOOR_TOLERANCE) -> DataFrame:
    """Providers claimed to use no context that beat the floor by more than the tolerance on common keys."""
    keys = ["task_id", "repeat", "model"]
    base = runs.where(F.col("provider") == floor).select(*keys, F.col("correct").alias("_floor"))
    pairs = runs.where(F.col("provider").isin(*claims) & (F.col("provider") != floor)).join(base, keys)
    means = pairs.groupBy("provider").agg(F.avg(F.col("correct") - F.col("_floor")).alias("_d"), F.count(F.lit(1)).alias("_n"))
    evidence = F.concat(F.lit("n="), F.col("_n").cast("string"))
    return _findings(means.where(F.col("_d") > tolerance), "C3.priors_floor_anomaly", "HIGH", F.col("provider"), None, evidence)


def trace_findings(runs: DataFrame) -> DataFrame:
    """Reserved for traces of agents: finds nothing."""
    return _findings(runs.limit(0), "C4.agent_trace", "INFO", None, None, "")


def ranked(findings: DataFrame) -> DataFrame:
    """Findings by severity, code, provider and task."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.orderBy(place, "code", F.coalesce("provider", F.lit("")), F.coalesce("task_id", F.lit("")))


def scan(runs: DataFrame, audit: DataFrame, claims: Sequence[str] = (), **options) -> DataFrame:
    """All rules' findings in order."""
    out = config_findings(runs).unionByName(injection_findings(audit, runs)).unionByName(trace_findings(runs))
    return ranked(out.unionByName(floor_findings(runs, claims, **options)) if claims else out)


def gate(findings: DataFrame) -> int:
    """Exit code: 1 if anything is HIGH."""
    return int(not findings.where("severity = 'HIGH'").isEmpty())


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
