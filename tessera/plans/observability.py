"""Observability registries: SLIs, SLO targets, alarm definitions, telemetry rules.

These are configuration rows; the operators in :mod:`tessera.operators.slo`
and :mod:`tessera.operators.telemetry` turn them into Column expressions or
small broadcast tables.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the source configuration).
# SLO targets: availability, latency thresholds (ms), burn budget pct/windows.
# ---------------------------------------------------------------------------
SLO = {
    "availability_target": 0.9995,
    "conversation_first_paint_ms": 3000,
    "conversation_end_to_end_ms": 15000,
    "deal_progress_ms": 300,
    "fast_burn_pct_of_budget": 2,
    "slow_burn_pct_of_budget": 5,
    "fast_burn_window_minutes": 60,
    "slow_burn_window_minutes": 360,
}

# SLIs: id, request-log path prefix, latency threshold key.  Filter is
# message = 'request_completed' AND path starts with prefix AND status < 400.
SLIS = (
    ("conversation-first-paint", "/v1/runtime/agents", "conversation_first_paint_ms"),
    ("conversation-end-to-end", "/v1/runtime/conversation/turn", "conversation_end_to_end_ms"),
    ("deal-progress", "/v1/lending/deals", "deal_progress_ms"),
)

# Telemetry processors.
REDACT_KEYS = ("http.request.body", "http.response.body", "db.statement")
TENANT_ATTR = "axira.tenant_id"
TENANT_DEFAULT = "unknown"
RESOURCE_NAMESPACE = "axira"
LLM_SPAN_RE = r"^axira\.llm_call(:|$)"
LOG_INDEX_PREFIX = "axira-logs"
LLM_INDEX_PREFIX = "axira-llm"
ID_FIELD_RE = ("^(tenantId|userId|agentId|caseId|phaseId|missionId|parentMissionId|workflowRunId|stepId|"
               "subWorkflowId|capabilityId|capabilityInvocationId|agentTaskId|toolCallId|llmCallId|"
               "decisionEvalId|ruleEvalId|workCardId|correlationId|spinePath|traceId|spanId)$")
ID_IGNORE_ABOVE = 1024
MESSAGE_RAW_IGNORE_ABOVE = 8192

# Audit archive filter.
AUDIT_MESSAGES = ("am_decision", "cap_authz_decision", "authorization_decision")
AUDIT_SERVICES = ("axira-gateway", "axira-agent-runtime", "axira-workflow-engine")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Alarm:
    alarm_id: str
    metric: str
    stat: str            # Average | Sum | Minimum | Maximum | SampleCount | pNN
    period_s: int
    op: str              # > >= < <=
    threshold: float
    n: int               # evaluation periods
    m: int               # datapoints to alarm
    missing: str = "missing"   # not_breaching | breaching | missing | ignore


def error_budget_minutes(target: float) -> float:
    """AGG11: monthly (30 d) error budget in minutes, rounded half-up to 2 places."""
    import math
    return math.floor((1 - target) * 30 * 24 * 60 * 100 + 0.5) / 100


def burn_rate(pct_of_budget: float, window_minutes: int, pct_is_percent: bool = False) -> float:
    """AGG12: burn multiplier as coded (pct taken as given, Q6); opt-in /100."""
    pct = pct_of_budget / 100 if pct_is_percent else pct_of_budget
    return pct * 30 * 24 / (window_minutes / 60)


def burn_threshold(target: float, pct_of_budget: float, window_minutes: int,
                   pct_is_percent: bool = False) -> float:
    """AGG12: error-rate threshold ``(1 - target) * burn_rate``."""
    return (1 - target) * burn_rate(pct_of_budget, window_minutes, pct_is_percent)


def sli_latency_alarms() -> list:
    """The three SLI latency alarms: p95 over 5 min above threshold, 3 of 3."""
    return [Alarm(f"sli-{sid}", f"sli/{sid}/latency-ms", "p95", 300, ">", float(SLO[key]), 3, 3, "not_breaching")
            for sid, _, key in SLIS]


# ---------------------------------------------------------------------------
# The alarm rows (metric, statistic, period in seconds, rule, N, M, missing data).
# A burn alarm's statistic is the average of an error flag, i.e. errors / requests.
# ---------------------------------------------------------------------------
CATALOG = (
    Alarm("burn-fast", "availability/error-flag", "Average", 3600, ">", 0.72, 1, 1, "not_breaching"),
    Alarm("burn-slow", "availability/error-flag", "Average", 21600, ">", 0.30, 1, 1, "not_breaching"),
    Alarm("db-cpu", "db/cpu", "Average", 300, ">", 80.0, 3, 3),
    Alarm("db-replica-lag", "db/replica-lag", "Average", 300, ">", 1000.0, 2, 2, "not_breaching"),
    Alarm("search-red", "search/status-red", "Maximum", 60, ">=", 1.0, 1, 1, "not_breaching"),
    Alarm("lb-target-5xx", "lb/target-5xx", "Sum", 300, ">", 10.0, 1, 1, "not_breaching"),
    Alarm("lb-own-5xx", "lb/own-5xx", "Sum", 300, ">", 10.0, 1, 1, "not_breaching"),
    Alarm("queue-age", "queue/projection-consumer/oldest-age", "Maximum", 60, ">", 900.0, 3, 3, "not_breaching"),
    Alarm("cache-cpu", "cache/cpu", "Average", 300, ">", 80.0, 3, 3, "not_breaching"),
    Alarm("cache-memory", "cache/memory", "Average", 300, ">", 80.0, 3, 3, "not_breaching"),
    Alarm("cache-evictions", "cache/evictions", "Sum", 300, ">", 0.0, 3, 3, "not_breaching"),
    Alarm("model-throttles", "model/throttles", "Sum", 300, ">=", 1.0, 1, 1, "not_breaching"),
    Alarm("base-db-cpu", "base/db-cpu", "Average", 300, ">=", 80.0, 3, 3),
    Alarm("base-db-connections", "base/db-connections", "Average", 300, ">=", 150.0, 2, 2),
    Alarm("base-db-free-storage", "base/db-free-storage", "Average", 300, "<", 10737418240.0, 1, 1),
    Alarm("backup-errors", "backup/errors", "Sum", 3600, ">=", 1.0, 1, 1),
)
SERVICE_PCT, BASE_SERVICE_PCT = 85.0, 85.0
# ---------------------------------------------------------------------------


def alarm_catalog(services=(), queues=(), targets=(), base_services=(), desired_tasks: int = 1) -> list:
    """Every alarm row: the fixed ones, the three SLI alarms, and those per service, dead-letter queue and target group."""
    out = [*sli_latency_alarms(), *CATALOG]
    for s in services:
        out += [Alarm(f"{s}-{m}", f"service/{s}/{m}", "Average", 300, ">", SERVICE_PCT, 3, 3) for m in ("cpu", "memory")]
    for s in base_services:
        out += [Alarm(f"base-{s}-{m}", f"base/{s}/{m}", "Average", 300, ">=", BASE_SERVICE_PCT, 3, 3) for m in ("cpu", "memory")]
    out += [Alarm(f"{q}-dlq", f"dlq/{q}/visible", "Maximum", 60, ">=", 1.0, 1, 1) for q in queues]
    out += [Alarm(f"{t}-unhealthy", f"target/{t}/unhealthy", "Maximum", 60, ">", 0.0, 3, 3, "not_breaching") for t in targets]
    out.append(Alarm("running-tasks-low", "workflow/running-tasks", "Minimum", 60, "<", float(desired_tasks), 5, 5, "breaching"))
    return out
