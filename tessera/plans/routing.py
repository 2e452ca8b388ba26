"""Routing registries: topics, consumers, queues, allow-lists, notification maps.

Edges are configuration data; :func:`edges_frame` turns them into a small
DataFrame whose size is fixed by the configuration (safe to broadcast).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the source configuration).
# Base messaging: 18 topics and 9 consumers with their subscriptions (58 edges).
# ---------------------------------------------------------------------------
TOPIC_NAMES = (
    "axira-events-deal", "axira-events-document", "axira-events-agent", "axira-events-mission",
    "axira-events-approval", "axira-events-loan", "axira-events-knowledge", "axira-events-evidence",
    "axira-events-platform", "axira-events-orchestration", "axira-events-case", "axira-events-compliance",
    "axira-events-intake", "axira-events-investigation", "axira-events-monitoring", "axira-events-screening",
    "axira-events-sar", "axira-events-user-profile",
)

CONSUMERS = (
    ("projection-consumer", (
        "axira-events-deal", "axira-events-document", "axira-events-agent", "axira-events-loan",
        "axira-events-knowledge", "axira-events-evidence", "axira-events-platform", "axira-events-orchestration",
        "axira-events-case", "axira-events-intake", "axira-events-investigation", "axira-events-monitoring")),
    ("projection-consumer-priority", ("axira-events-approval", "axira-events-mission")),
    ("search-indexer", (
        "axira-events-deal", "axira-events-document", "axira-events-loan", "axira-events-knowledge",
        "axira-events-case")),
    ("notification-dispatcher", (
        "axira-events-approval", "axira-events-mission", "axira-events-loan", "axira-events-case",
        "axira-events-monitoring")),
    ("compliance-monitor", (
        "axira-events-deal", "axira-events-document", "axira-events-approval", "axira-events-loan",
        "axira-events-compliance", "axira-events-screening", "axira-events-sar", "axira-events-investigation")),
    ("agui-streamer", ("axira-events-agent", "axira-events-mission", "axira-events-orchestration")),
    ("workflow-trigger", (
        "axira-events-deal", "axira-events-mission", "axira-events-approval", "axira-events-orchestration")),
    ("webhook-dispatcher", TOPIC_NAMES),
    ("user-profile-cache-refresh", ("axira-events-user-profile",)),
)

PRIORITY_TOPICS = ("axira-events-approval", "axira-events-mission")

# Staging messaging: every domain topic fans out to every standard queue,
# plus the priority lane of queues that have one.
SNS_DOMAINS = (
    "platform", "knowledge", "evidence", "agent", "documents", "human-loop", "orchestration", "rules",
    "prompts", "events", "knowledge-platform", "dimensions",
    "deal", "loan", "covenant", "draw", "underwriting", "closing",
    "case", "subject", "finding", "screening", "sar", "monitoring",
)
# (queue, visibility timeout s, retention days, has priority lane)
STANDARD_QUEUES = (
    ("projection-consumer", 60, 4, True), ("search-indexer", 30, 4, False),
    ("notification-dispatcher", 30, 4, False), ("compliance-monitor", 60, 4, False),
    ("agui-streamer", 30, 1, False), ("workflow-trigger", 60, 4, False),
    ("webhook-dispatcher", 30, 4, False), ("governance-events", 60, 4, False),
    ("reconciliation-starter", 60, 4, False),
)

# Ops-plane subscription allow-lists on the event ``kind`` attribute.
KIND_ALLOWLISTS = {
    "slack": ("alert.fired", "alert.resolved", "alert.acknowledged", "alert.escalated", "service.unhealthy",
              "service.recovered", "deployment.rolled_back", "capability.cert_failed", "runbook.drafted"),
    "runbook": ("runbook.drafted",),
    "incident": ("infra.snapshot", "error_group.new", "error_group.spike", "service.unhealthy",
                 "service.recovered", "circuit_breaker.opened", "deployment.rolled_back"),
}

# Dead-letter thresholds (max receives before the dead-letter queue).
MAX_RECEIVE_DEFAULT = 3
MAX_RECEIVE_PROD = 5
# Replay guard / freshness (ops receiver).
REPLAY_TTL_S = 600
MAX_CLOCK_SKEW_S = 300
# Content-based FIFO deduplication interval.
FIFO_DEDUP_S = 300

# Operational notifications: 17 event types -> internal channel / customer category.
INTERNAL_CHANNEL = {
    "deploy_started": "#axira-deployments", "deploy_succeeded": "#axira-deployments",
    "deploy_failed": "#axira-deployments", "deploy_rollback": "#axira-deployments",
    "canary_promoted": "#axira-deployments", "canary_rollback": "#axira-deployments",
    "accuracy_regression": "#axira-incidents", "secret_rotation_failed": "#axira-incidents",
    "subscription_suspended": "#axira-incidents",
    "release_available": "#axira-releases", "release_hotfix": "#axira-releases",
    "tenant_provisioned": "#axira-tenants", "subscription_past_due": "#axira-tenants",
}
INTERNAL_CHANNEL_DEFAULT = "#axira-deployments"
INCIDENTS_CHANNEL = "#axira-incidents"
CUSTOMER_CATEGORY = {
    "deploy_started": "deployments", "deploy_succeeded": "deployments", "deploy_failed": "deployments",
    "deploy_rollback": "deployments", "canary_promoted": "deployments", "canary_rollback": "deployments",
    "secret_rotation_completed": "deployments", "feature_flag_changed": "deployments",
    "accuracy_regression": "incidents", "secret_rotation_failed": "incidents", "subscription_suspended": "incidents",
    "release_available": "releases", "release_hotfix": "releases",
    "certification_completed": "certifications", "certification_failed": "certifications",
}
CUSTOMER_CATEGORY_DEFAULT = "deployments"
URGENCY_EMOJI = {"info": "ℹ️", "warning": "⚠️", "p2": "\U0001f7e0", "p1": "\U0001f534"}
URGENCY_COLOR = {"info": "good", "warning": "warning", "p2": "warning", "p1": "attention"}
# ---------------------------------------------------------------------------


def base_edges() -> list:
    """(topic, consumer, priority) for the base stack: 58 edges."""
    return [(t, c, t in PRIORITY_TOPICS) for c, topics in CONSUMERS for t in topics]


def staging_edges() -> list:
    """(topic, queue, priority) for the staging all-to-all fan-out: 24 x 9 + 24 = 240 edges."""
    out = []
    for d in SNS_DOMAINS:
        for q, _, _, lane in STANDARD_QUEUES:
            out.append((d, q, False))
            if lane:
                out.append((d, q + "-priority", True))
    return out


def edges_frame(spark, edges=None):
    edges = base_edges() if edges is None else edges
    return spark.createDataFrame(edges, "topic string, consumer string, priority boolean")

# ---------------------------------------------------------------------------
# Edge origin allow-list (published CDN origin ranges).
# ---------------------------------------------------------------------------
ORIGIN_ALLOW_V4 = (
    "173.245.48.0/20", "103.21.244.0/22", "103.22.200.0/22", "103.31.4.0/22", "141.101.64.0/18",
    "108.162.192.0/18", "190.93.240.0/20", "188.114.96.0/20", "197.234.240.0/22", "198.41.128.0/17",
    "162.158.0.0/15", "104.16.0.0/13", "104.24.0.0/14", "172.64.0.0/13", "131.0.72.0/22",
)
ORIGIN_ALLOW_V6 = (
    "2400:cb00::/32", "2606:4700::/32", "2803:f800::/32", "2405:b500::/32", "2405:8100::/32",
    "2a06:98c0::/29", "2c0f:f248::/32",
)
# Rate limits: requests per IP per 5 minutes (edge); events per customer per minute (receiver).
IP_RATE_LIMIT_5MIN = 2000
CUSTOMER_RATE_LIMIT_1MIN = 1000
