"""Dispatch registry: event type -> fact table, columns, JSON paths, merge key.

The registry is data, not code paths: one generic projection
(:mod:`tessera.operators.project`) compiles every entry into a single
``select``.  Entries are validated at import, like a constructor check.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ENVELOPE = (("event_id", "id", "string"), ("event_time", "time", "timestamp"),
            ("tenant_id", "tenantid", "string"), ("case_id", "caseid", "string"))
ENVELOPE_COLS = tuple(c for c, _, _ in ENVELOPE)

_SPARK_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(),
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "decimal(18,2)": T.DecimalType(18, 2),
}


@dataclass(frozen=True)
class FactTable:
    name: str
    columns: tuple  # ((name, type_name), ...) without envelope columns

    @property
    def schema(self) -> T.StructType:
        fields = [T.StructField(c, _SPARK_TYPES[t], True) for c, _, t in ENVELOPE]
        fields += [T.StructField(c, _SPARK_TYPES[t], True) for c, t in self.columns]
        return T.StructType(fields)

    def type_of(self, col: str) -> str:
        for c, t in self.columns:
            if c == col:
                return t
        for c, _, t in ENVELOPE:
            if c == col:
                return t
        raise KeyError(col)


@dataclass(frozen=True)
class FactDispatch:
    event_type: str
    table: str
    columns: tuple
    paths: tuple
    merge_key: str | None = None
    types: tuple = field(default=())

    def __post_init__(self):
        if len(self.columns) != len(self.paths):
            raise ValueError(f"{self.event_type}: {len(self.columns)} columns vs {len(self.paths)} paths")
        if self.merge_key is not None and self.merge_key not in self.columns:
            raise ValueError(f"{self.event_type}: merge key {self.merge_key} not in columns")
        if len(set(self.columns)) != len(self.columns):
            raise ValueError(f"{self.event_type}: duplicate column")

    @property
    def is_merge(self) -> bool:
        return self.merge_key is not None

    @property
    def strategy(self) -> str:
        return "MERGE" if self.is_merge else "INSERT"

    def update_columns(self) -> tuple:
        """Columns a MERGE overwrites: every listed column except envelope and key."""
        return tuple(c for c in self.columns if c not in ENVELOPE_COLS and c != self.merge_key)


# ---------------------------------------------------------------------------
# The 24 fact tables (column, type) and the 38 event-type
# entries (column, path).  Column names, JSON paths, strategies and merge keys
# must equal the producer contract, so they are stated verbatim here.
# A path is either an envelope field (``type``/``time``) or ``data.<a>.<b>``.
# ---------------------------------------------------------------------------
_TABLES = (
    FactTable("fact_orchestration_mission", (
        ("fact_mission_id", "string"),
        ("parent_mission_id", "string"),
        ("scope", "string"),
        ("process_spec_id", "string"),
        ("process_spec_version", "string"),
        ("template_name", "string"),
        ("entity_type", "string"),
        ("entity_id", "string"),
        ("started_by", "string"),
        ("workflow_run_id", "string"),
        ("priority", "string"),
        ("started_at", "timestamp"),
        ("completed_at", "timestamp"),
        ("total_duration_ms", "long"),
        ("steps_executed", "int"),
    )),
    FactTable("fact_orchestration_mission_state", (
        ("fact_mission_id", "string"),
        ("from_state", "string"),
        ("to_state", "string"),
        ("duration_in_from_state_ms", "long"),
        ("transition_reason", "string"),
        ("transitioned_at", "timestamp"),
    )),
    FactTable("fact_capability_invocation", (
        ("call_id", "string"),
        ("fact_capability_id", "string"),
        ("fact_capability_version", "string"),
        ("kind", "string"),
        ("duration_ms", "long"),
        ("output_size_bytes", "long"),
        ("side_effects", "string"),
        ("idempotent_hit", "boolean"),
        ("manifest_hash", "string"),
        ("completed_at", "timestamp"),
    )),
    FactTable("fact_agent_task", (
        ("task_id", "string"),
        ("task_event_type", "string"),
        ("agent_name", "string"),
        ("skill_id", "string"),
        ("correlation_id", "string"),
        ("priority", "string"),
        ("product_id", "string"),
        ("submitted_at", "timestamp"),
        ("model_used", "string"),
        ("started_at", "timestamp"),
        ("agent_version", "string"),
        ("fact_capability_id", "string"),
        ("outcome", "string"),
        ("duration_ms", "long"),
        ("tokens_input", "long"),
        ("tokens_output", "long"),
        ("estimated_cost_usd", "decimal(18,2)"),
        ("fact_confidence", "double"),
        ("proposal_count", "int"),
        ("tool_call_count", "int"),
        ("deal_id", "string"),
        ("fact_user_id", "string"),
        ("fact_actor_role", "string"),
        ("completed_at", "timestamp"),
        ("error_code", "string"),
        ("error_message", "string"),
        ("error_retryable", "boolean"),
        ("retry_count", "int"),
        ("failed_at", "timestamp"),
        ("cancelled_by", "string"),
        ("cancelled_at", "timestamp"),
        ("waiting_question", "string"),
        ("delegated_to_agent", "string"),
        ("delegated_task_id", "string"),
    )),
    FactTable("fact_agent_action", (
        ("proposal_id", "string"),
        ("task_id", "string"),
        ("agent_name", "string"),
        ("action_type", "string"),
        ("fact_path", "string"),
        ("proposed_value", "string"),
        ("fact_confidence", "double"),
        ("proposed_at", "timestamp"),
    )),
    FactTable("fact_agent_tool_call", (
        ("task_id", "string"),
        ("tool_name", "string"),
        ("mcp_server", "string"),
        ("duration_ms", "long"),
        ("success", "boolean"),
        ("error_class", "string"),
        ("cost_usd", "decimal(18,2)"),
        ("called_at", "timestamp"),
    )),
    FactTable("fact_safety_event", (
        ("task_id", "string"),
        ("safety_event_type", "string"),
        ("agent_name", "string"),
        ("detection_count", "int"),
        ("entity_types", "string"),
        ("action", "string"),
        ("phase", "string"),
        ("severity", "string"),
        ("detected_at", "timestamp"),
    )),
    FactTable("fact_human_loop_event", (
        ("event_type", "string"),
        ("deal_id", "string"),
        ("approval_id", "string"),
        ("approval_type", "string"),
        ("required_roles", "string"),
        ("authority_tier", "string"),
        ("sla_hours", "int"),
        ("event_at", "timestamp"),
        ("user_id", "string"),
        ("band", "string"),
        ("decision", "string"),
        ("duration_from_request_ms", "long"),
        ("reason", "string"),
        ("card_id", "string"),
        ("card_type", "string"),
        ("completed_by_user_id", "string"),
        ("action", "string"),
        ("fact_id", "string"),
        ("fact_path", "string"),
        ("old_value", "string"),
        ("new_value", "string"),
    )),
    FactTable("fact_decision", (
        ("decision_id", "string"),
        ("definition_name", "string"),
        ("definition_version", "string"),
        ("outcome", "string"),
        ("fact_confidence", "double"),
        ("entity_type", "string"),
        ("entity_id", "string"),
        ("input_snapshot_ref", "string"),
        ("contributing_rules", "string"),
        ("next_actions", "string"),
        ("required_approvals", "string"),
        ("evaluated_at", "timestamp"),
    )),
    FactTable("fact_evidence_pack", (
        ("pack_id", "string"),
        ("seal_hash", "string"),
        ("node_count", "int"),
        ("edge_count", "int"),
        ("sealed_by_user_id", "string"),
        ("sealed_at", "timestamp"),
        ("label", "string"),
    )),
    FactTable("fact_document", (
        ("document_id", "string"),
        ("document_event_type", "string"),
        ("extraction_path", "string"),
        ("template_id", "string"),
        ("fields_extracted", "int"),
        ("avg_confidence", "double"),
        ("high_confidence_count", "int"),
        ("low_confidence_count", "int"),
        ("validation_errors", "string"),
        ("duration_ms", "long"),
        ("document_classification", "string"),
        ("event_at", "timestamp"),
    )),
    FactTable("fact_stage_transitions", (
        ("stage_event_type", "string"),
        ("stage_ownership_id", "string"),
        ("outgoing_stage_ownership_id", "string"),
        ("entity_type", "string"),
        ("entity_id", "string"),
        ("from_stage", "string"),
        ("to_stage", "string"),
        ("incoming_owner_user_id", "string"),
        ("incoming_owner_role", "string"),
        ("contributor_user_ids", "string"),
        ("reviewer_user_ids", "string"),
        ("backup_owner_user_id", "string"),
        ("outgoing_stage_held_by", "string"),
        ("from_stage_duration_ms", "long"),
        ("transitioned_at", "timestamp"),
    )),
    FactTable("fact_lending_deal_event", (
        ("event_type", "string"),
        ("deal_id", "string"),
        ("event_at", "timestamp"),
        ("borrower_id", "string"),
        ("fact_program_id", "string"),
        ("partner_id", "string"),
        ("property_address", "string"),
        ("property_type", "string"),
        ("deal_amount_usd", "decimal(18,2)"),
        ("deal_amount_currency", "string"),
        ("purpose", "string"),
        ("estimated_close_date", "date"),
        ("initiated_by_user_id", "string"),
        ("intake_channel", "string"),
        ("classification_channel", "string"),
        ("loan_type", "string"),
        ("product_type", "string"),
        ("classification_property_type", "string"),
        ("asset_class", "string"),
        ("deal_segment", "string"),
        ("express_eligible", "boolean"),
        ("express_rules_failed", "string"),
        ("uw_path", "string"),
        ("soft_quote_amount", "decimal(18,2)"),
        ("soft_quote_revision", "int"),
        ("loi_amount", "decimal(18,2)"),
    )),
    FactTable("fact_lending_sponsor", (
        ("sponsor_id", "string"),
        ("sponsor_event_type", "string"),
        ("sponsor_name", "string"),
        ("tier", "string"),
        ("fico", "int"),
        ("completed_transactions", "int"),
        ("total_exposure_usd", "decimal(18,2)"),
        ("research_findings", "string"),
        ("event_at", "timestamp"),
    )),
    FactTable("fact_lending_sponsor_snapshot", (
        ("sponsor_id", "string"),
        ("sponsor_name", "string"),
        ("sponsor_tier", "string"),
        ("open_deals_count", "int"),
        ("total_exposure_usd", "decimal(18,2)"),
        ("deal_spread", "string"),
        ("on_track_count", "int"),
        ("off_track_count", "int"),
        ("snapshot_at", "timestamp"),
    )),
    FactTable("fact_lending_sponsor_risk_signal", (
        ("sponsor_id", "string"),
        ("sponsor_name", "string"),
        ("signal_type", "string"),
        ("severity", "string"),
        ("trigger_deal_id", "string"),
        ("details", "string"),
        ("detected_at", "timestamp"),
    )),
    FactTable("fact_lending_loan_approval", (
        ("deal_id", "string"),
        ("loan_event_type", "string"),
        ("loan_amount_usd", "decimal(18,2)"),
        ("interest_rate", "double"),
        ("term_months", "int"),
        ("ltv", "double"),
        ("ltc", "double"),
        ("ltarv", "double"),
        ("event_at", "timestamp"),
        ("loan_amount_currency", "string"),
        ("authority_tier", "string"),
        ("band", "string"),
        ("approved_by_user_id", "string"),
        ("fact_actor_role", "string"),
        ("deviation_category", "string"),
        ("conditions", "string"),
    )),
    FactTable("fact_lending_dscr", (
        ("deal_id", "string"),
        ("base_noi", "decimal(18,2)"),
        ("base_debt_service", "decimal(18,2)"),
        ("base_dscr", "double"),
        ("base_passes", "boolean"),
        ("rate_plus_2_noi", "decimal(18,2)"),
        ("rate_plus_2_debt_service", "decimal(18,2)"),
        ("rate_plus_2_dscr", "double"),
        ("rate_plus_2_passes", "boolean"),
        ("vacancy_20_noi", "decimal(18,2)"),
        ("vacancy_20_debt_service", "decimal(18,2)"),
        ("vacancy_20_dscr", "double"),
        ("vacancy_20_passes", "boolean"),
        ("rent_decline_10_noi", "decimal(18,2)"),
        ("rent_decline_10_debt_service", "decimal(18,2)"),
        ("rent_decline_10_dscr", "double"),
        ("rent_decline_10_passes", "boolean"),
        ("all_scenarios_pass", "boolean"),
        ("computed_at", "timestamp"),
    )),
    FactTable("fact_lending_gross_yield", (
        ("deal_id", "string"),
        ("gross_yield_bps", "int"),
        ("sub_threshold_flag", "boolean"),
        ("threshold_bps", "int"),
        ("spread_bps", "int"),
        ("origination_fee_bps", "int"),
        ("exit_fee_bps", "int"),
        ("other_fees_bps", "int"),
        ("computed_at", "timestamp"),
    )),
    FactTable("fact_lending_doc_perfection", (
        ("deal_id", "string"),
        ("matrix", "string"),
        ("total_criteria", "int"),
        ("criteria_passed", "int"),
        ("criteria_failed", "int"),
        ("all_documents_perfected", "boolean"),
        ("evaluated_at", "timestamp"),
    )),
    FactTable("fact_studio_session", (
        ("session_id", "string"),
        ("session_event_type", "string"),
        ("deal_id", "string"),
        ("fact_user_id", "string"),
        ("duration_ms", "long"),
        ("branch_count", "int"),
        ("branch_depth_max", "int"),
        ("chosen_branch_id", "string"),
        ("saved_as_quote", "boolean"),
        ("abandoned_branches", "int"),
        ("event_at", "timestamp"),
    )),
    FactTable("fact_lending_fast_quote", (
        ("deal_id", "string"),
        ("fast_quote_event_type", "string"),
        ("preliminary_quote_usd", "decimal(18,2)"),
        ("fact_confidence", "double"),
        ("event_at", "timestamp"),
    )),
    FactTable("fact_lending_market", (
        ("deal_id", "string"),
        ("market_event_type", "string"),
        ("flagged_field", "string"),
        ("borrower_value", "decimal(18,2)"),
        ("market_value", "decimal(18,2)"),
        ("gap_absolute", "decimal(18,2)"),
        ("gap_pct", "double"),
        ("sources", "string"),
        ("property_type", "string"),
        ("event_at", "timestamp"),
    )),
    FactTable("fact_lending_multiphase", (
        ("deal_id", "string"),
        ("multiphase_event_type", "string"),
        ("sub_type", "string"),
        ("phase_count", "int"),
        ("total_units", "int"),
        ("event_at", "timestamp"),
    )),
)
FACT_TABLES = {t.name: t for t in _TABLES}


def _entry(event_type: str, table: str, mapping: tuple, merge_key: str | None = None) -> FactDispatch:
    """A dispatch entry; column types come from its fact table."""
    columns = tuple(c for c, _ in mapping)
    return FactDispatch(event_type, table, columns, tuple(p for _, p in mapping), merge_key,
                        tuple(FACT_TABLES[table].type_of(c) for c in columns))


_ENTRIES = (
    _entry("axira.orchestration.mission.started.v1", "fact_orchestration_mission", (
        ("fact_mission_id", "data.missionId"),
        ("parent_mission_id", "data.parentMissionId"),
        ("scope", "data.scope"),
        ("process_spec_id", "data.processSpecId"),
        ("process_spec_version", "data.processSpecVersion"),
        ("template_name", "data.templateName"),
        ("entity_type", "data.entityType"),
        ("entity_id", "data.entityId"),
        ("started_by", "data.startedBy"),
        ("workflow_run_id", "data.workflowRunId"),
        ("priority", "data.priority"),
        ("started_at", "data.startedAt"),
    )),
    _entry("axira.orchestration.mission.completed.v1", "fact_orchestration_mission", (
        ("fact_mission_id", "data.missionId"),
        ("completed_at", "data.completedAt"),
        ("total_duration_ms", "data.totalDurationMs"),
        ("steps_executed", "data.stepsExecuted"),
    ), merge_key="fact_mission_id"),
    _entry("axira.orchestration.mission.state_changed.v1", "fact_orchestration_mission_state", (
        ("fact_mission_id", "data.missionId"),
        ("from_state", "data.fromState"),
        ("to_state", "data.toState"),
        ("duration_in_from_state_ms", "data.durationInFromStateMs"),
        ("transition_reason", "data.transitionReason"),
        ("transitioned_at", "data.transitionedAt"),
    )),
    _entry("axira.capability.completed.v1", "fact_capability_invocation", (
        ("call_id", "data.callId"),
        ("fact_capability_id", "data.capabilityId"),
        ("fact_capability_version", "data.capabilityVersion"),
        ("kind", "data.kind"),
        ("duration_ms", "data.durationMs"),
        ("output_size_bytes", "data.outputSize"),
        ("side_effects", "data.sideEffects"),
        ("idempotent_hit", "data.idempotentHit"),
        ("manifest_hash", "data.manifestHash"),
        ("completed_at", "data.completedAt"),
    )),
    _entry("axira.agent.task.submitted.v1", "fact_agent_task", (
        ("task_id", "data.taskId"),
        ("task_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("skill_id", "data.skillId"),
        ("correlation_id", "data.correlationId"),
        ("priority", "data.priority"),
        ("product_id", "data.productId"),
        ("submitted_at", "time"),
    )),
    _entry("axira.agent.task.started.v1", "fact_agent_task", (
        ("task_id", "data.taskId"),
        ("task_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("model_used", "data.modelUsed"),
        ("started_at", "time"),
    ), merge_key="task_id"),
    _entry("axira.agent.task.completed.v1", "fact_agent_task", (
        ("task_id", "data.taskId"),
        ("task_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("agent_version", "data.agentVersion"),
        ("skill_id", "data.skillId"),
        ("fact_capability_id", "data.capabilityId"),
        ("outcome", "data.outcome"),
        ("duration_ms", "data.durationMs"),
        ("tokens_input", "data.tokensUsed.input"),
        ("tokens_output", "data.tokensUsed.output"),
        ("estimated_cost_usd", "data.estimatedCostUsd"),
        ("fact_confidence", "data.confidence"),
        ("proposal_count", "data.proposalCount"),
        ("tool_call_count", "data.toolCallCount"),
        ("model_used", "data.modelUsed"),
        ("deal_id", "data.dealId"),
        ("fact_user_id", "data.userId"),
        ("fact_actor_role", "data.actorRole"),
        ("completed_at", "data.completedAt"),
    ), merge_key="task_id"),
    _entry("axira.agent.task.failed.v1", "fact_agent_task", (
        ("task_id", "data.taskId"),
        ("task_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("error_code", "data.errorCode"),
        ("error_message", "data.errorMessage"),
        ("error_retryable", "data.retryable"),
        ("retry_count", "data.retryCount"),
        ("failed_at", "time"),
    ), merge_key="task_id"),
    _entry("axira.agent.task.cancelled.v1", "fact_agent_task", (
        ("task_id", "data.taskId"),
        ("task_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("cancelled_by", "data.cancelledBy"),
        ("cancelled_at", "time"),
    ), merge_key="task_id"),
    _entry("axira.agent.task.waiting_human.v1", "fact_agent_task", (
        ("task_id", "data.taskId"),
        ("task_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("waiting_question", "data.question"),
    ), merge_key="task_id"),
    _entry("axira.agent.task.delegated.v1", "fact_agent_task", (
        ("task_id", "data.taskId"),
        ("task_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("delegated_to_agent", "data.delegatedTo"),
        ("delegated_task_id", "data.delegatedTaskId"),
    ), merge_key="task_id"),
    _entry("axira.agent.action.proposed.v1", "fact_agent_action", (
        ("proposal_id", "data.proposalId"),
        ("task_id", "data.taskId"),
        ("agent_name", "data.agentName"),
        ("action_type", "data.actionType"),
        ("fact_path", "data.factPath"),
        ("proposed_value", "data.proposedValue"),
        ("fact_confidence", "data.confidence"),
        ("proposed_at", "data.proposedAt"),
    )),
    _entry("axira.agent.tool.called.v1", "fact_agent_tool_call", (
        ("task_id", "data.taskId"),
        ("tool_name", "data.toolName"),
        ("mcp_server", "data.mcpServer"),
        ("duration_ms", "data.durationMs"),
        ("success", "data.success"),
        ("error_class", "data.errorClass"),
        ("cost_usd", "data.costUsd"),
        ("called_at", "data.calledAt"),
    )),
    _entry("axira.safety.pii.detected.v1", "fact_safety_event", (
        ("task_id", "data.taskId"),
        ("safety_event_type", "type"),
        ("agent_name", "data.agentName"),
        ("detection_count", "data.detectionCount"),
        ("entity_types", "data.entityTypes"),
        ("action", "data.action"),
        ("phase", "data.phase"),
        ("severity", "data.severity"),
        ("detected_at", "data.detectedAt"),
    )),
    _entry("axira.human_loop.approval.requested.v1", "fact_human_loop_event", (
        ("event_type", "type"),
        ("deal_id", "data.dealId"),
        ("approval_id", "data.approvalId"),
        ("approval_type", "data.approvalType"),
        ("required_roles", "data.requiredRoles"),
        ("authority_tier", "data.authorityTier"),
        ("sla_hours", "data.slaHours"),
        ("event_at", "data.requestedAt"),
    )),
    _entry("axira.human_loop.approval.decided.v1", "fact_human_loop_event", (
        ("event_type", "type"),
        ("deal_id", "data.dealId"),
        ("user_id", "data.userId"),
        ("approval_id", "data.approvalId"),
        ("approval_type", "data.approvalType"),
        ("authority_tier", "data.authorityTier"),
        ("band", "data.band"),
        ("decision", "data.decision"),
        ("duration_from_request_ms", "data.durationFromRequestMs"),
        ("reason", "data.reason"),
        ("event_at", "data.decidedAt"),
    )),
    _entry("axira.human_loop.work_card.completed.v1", "fact_human_loop_event", (
        ("event_type", "type"),
        ("card_id", "data.cardId"),
        ("card_type", "data.cardType"),
        ("completed_by_user_id", "data.completedBy"),
        ("action", "data.action"),
        ("reason", "data.reason"),
        ("event_at", "data.completedAt"),
    )),
    _entry("axira.human_loop.fact.overridden.v1", "fact_human_loop_event", (
        ("event_type", "type"),
        ("user_id", "data.overriddenBy"),
        ("fact_id", "data.factId"),
        ("fact_path", "data.factPath"),
        ("old_value", "data.oldValue"),
        ("new_value", "data.newValue"),
        ("reason", "data.reason"),
        ("event_at", "data.overriddenAt"),
    )),
    _entry("axira.decision.evaluated.v1", "fact_decision", (
        ("decision_id", "data.decisionId"),
        ("definition_name", "data.definitionName"),
        ("definition_version", "data.definitionVersion"),
        ("outcome", "data.outcome"),
        ("fact_confidence", "data.confidence"),
        ("entity_type", "data.entityType"),
        ("entity_id", "data.entityId"),
        ("input_snapshot_ref", "data.inputSnapshotRef"),
        ("contributing_rules", "data.contributingRules"),
        ("next_actions", "data.nextActions"),
        ("required_approvals", "data.requiredApprovals"),
        ("evaluated_at", "data.evaluatedAt"),
    )),
    _entry("axira.evidence.pack.sealed.v1", "fact_evidence_pack", (
        ("pack_id", "data.packId"),
        ("seal_hash", "data.sealHash"),
        ("node_count", "data.nodeCount"),
        ("edge_count", "data.edgeCount"),
        ("sealed_by_user_id", "data.sealedBy"),
        ("sealed_at", "data.sealedAt"),
        ("label", "data.label"),
    )),
    _entry("axira.document.extracted.v1", "fact_document", (
        ("document_id", "data.documentId"),
        ("document_event_type", "type"),
        ("extraction_path", "data.extractionPath"),
        ("template_id", "data.templateId"),
        ("fields_extracted", "data.fieldsExtracted"),
        ("avg_confidence", "data.avgConfidence"),
        ("high_confidence_count", "data.highConfidenceCount"),
        ("low_confidence_count", "data.lowConfidenceCount"),
        ("validation_errors", "data.validationErrors"),
        ("duration_ms", "data.durationMs"),
        ("document_classification", "data.classification"),
        ("event_at", "data.extractedAt"),
    )),
    _entry("axira.platform.stage.transitioned.v1", "fact_stage_transitions", (
        ("stage_event_type", "type"),
        ("stage_ownership_id", "data.stageOwnershipId"),
        ("outgoing_stage_ownership_id", "data.outgoingStageOwnershipId"),
        ("entity_type", "data.entityType"),
        ("entity_id", "data.entityId"),
        ("from_stage", "data.fromStage"),
        ("to_stage", "data.toStage"),
        ("incoming_owner_user_id", "data.incomingOwnerUserId"),
        ("incoming_owner_role", "data.incomingOwnerRole"),
        ("contributor_user_ids", "data.contributorUserIds"),
        ("reviewer_user_ids", "data.reviewerUserIds"),
        ("backup_owner_user_id", "data.backupOwnerUserId"),
        ("outgoing_stage_held_by", "data.heldBy"),
        ("from_stage_duration_ms", "data.fromStageDurationMs"),
        ("transitioned_at", "data.transitionedAt"),
    )),
    _entry("axira.lending.deal.intake_completed.v1", "fact_lending_deal_event", (
        ("event_type", "type"),
        ("deal_id", "data.dealId"),
        ("event_at", "data.completedAt"),
        ("borrower_id", "data.borrowerId"),
        ("fact_program_id", "data.programId"),
        ("partner_id", "data.partnerId"),
        ("property_address", "data.intakeSummary.propertyAddress"),
        ("property_type", "data.intakeSummary.propertyType"),
        ("deal_amount_usd", "data.intakeSummary.dealAmount"),
        ("deal_amount_currency", "data.intakeSummary.dealAmountCurrency"),
        ("purpose", "data.intakeSummary.purpose"),
        ("estimated_close_date", "data.intakeSummary.estimatedCloseDate"),
        ("initiated_by_user_id", "data.initiatedBy"),
        ("intake_channel", "data.intakeChannel"),
        ("classification_channel", "data.classifications.channel"),
        ("loan_type", "data.classifications.loanType"),
        ("product_type", "data.classifications.productType"),
        ("classification_property_type", "data.classifications.propertyType"),
        ("asset_class", "data.classifications.assetClass"),
        ("deal_segment", "data.dealSegment"),
    )),
    _entry("axira.lending.deal.classified.v1", "fact_lending_deal_event", (
        ("event_type", "type"),
        ("deal_id", "data.dealId"),
        ("event_at", "data.classifiedAt"),
        ("express_eligible", "data.expressEligible"),
        ("express_rules_failed", "data.expressRulesFailed"),
        ("uw_path", "data.uwPath"),
    )),
    _entry("axira.lending.deal.soft_quote_issued.v1", "fact_lending_deal_event", (
        ("event_type", "type"),
        ("deal_id", "data.dealId"),
        ("event_at", "data.eventAt"),
        ("intake_channel", "data.intakeChannel"),
        ("soft_quote_amount", "data.softQuoteAmount"),
        ("soft_quote_revision", "data.softQuoteRevision"),
    )),
    _entry("axira.lending.deal.loi_issued.v1", "fact_lending_deal_event", (
        ("event_type", "type"),
        ("deal_id", "data.dealId"),
        ("event_at", "data.eventAt"),
        ("loi_amount", "data.loiAmount"),
    )),
    _entry("axira.lending.sponsor.assessed.v1", "fact_lending_sponsor", (
        ("sponsor_id", "data.sponsorId"),
        ("sponsor_event_type", "type"),
        ("sponsor_name", "data.sponsorName"),
        ("tier", "data.tier"),
        ("fico", "data.fico"),
        ("completed_transactions", "data.completedTransactions"),
        ("total_exposure_usd", "data.totalExposureUsd"),
        ("research_findings", "data.researchFindings"),
        ("event_at", "data.assessedAt"),
    )),
    _entry("axira.lending.sponsor.dashboard_snapshot.v1", "fact_lending_sponsor_snapshot", (
        ("sponsor_id", "data.sponsorId"),
        ("sponsor_name", "data.sponsorName"),
        ("sponsor_tier", "data.sponsorTier"),
        ("open_deals_count", "data.openDealsCount"),
        ("total_exposure_usd", "data.totalExposureUsd"),
        ("deal_spread", "data.dealSpread"),
        ("on_track_count", "data.onTrackDealsCount"),
        ("off_track_count", "data.offTrackDealsCount"),
        ("snapshot_at", "data.snapshotAt"),
    )),
    _entry("axira.lending.sponsor.risk_signal.v1", "fact_lending_sponsor_risk_signal", (
        ("sponsor_id", "data.sponsorId"),
        ("sponsor_name", "data.sponsorName"),
        ("signal_type", "data.signalType"),
        ("severity", "data.severity"),
        ("trigger_deal_id", "data.triggerDealId"),
        ("details", "data.details"),
        ("detected_at", "data.detectedAt"),
    )),
    _entry("axira.lending.loan.structured.v1", "fact_lending_loan_approval", (
        ("deal_id", "data.dealId"),
        ("loan_event_type", "type"),
        ("loan_amount_usd", "data.loanAmount"),
        ("interest_rate", "data.interestRate"),
        ("term_months", "data.term"),
        ("ltv", "data.ltv"),
        ("ltc", "data.ltc"),
        ("ltarv", "data.ltarv"),
        ("event_at", "data.structuredAt"),
    )),
    _entry("axira.lending.loan.approved.v1", "fact_lending_loan_approval", (
        ("deal_id", "data.dealId"),
        ("loan_event_type", "type"),
        ("loan_amount_usd", "data.loanAmount"),
        ("loan_amount_currency", "data.loanAmountCurrency"),
        ("authority_tier", "data.authorityTier"),
        ("band", "data.band"),
        ("approved_by_user_id", "data.approvedBy"),
        ("fact_actor_role", "data.actorRole"),
        ("deviation_category", "data.deviationCategory"),
        ("conditions", "data.conditions"),
        ("event_at", "data.approvedAt"),
    )),
    _entry("axira.lending.dscr.computed.v1", "fact_lending_dscr", (
        ("deal_id", "data.dealId"),
        ("base_noi", "data.scenarios.base.noi"),
        ("base_debt_service", "data.scenarios.base.debtService"),
        ("base_dscr", "data.scenarios.base.dscr"),
        ("base_passes", "data.scenarios.base.passes"),
        ("rate_plus_2_noi", "data.scenarios.rate_plus_2pct.noi"),
        ("rate_plus_2_debt_service", "data.scenarios.rate_plus_2pct.debtService"),
        ("rate_plus_2_dscr", "data.scenarios.rate_plus_2pct.dscr"),
        ("rate_plus_2_passes", "data.scenarios.rate_plus_2pct.passes"),
        ("vacancy_20_noi", "data.scenarios.vacancy_20pct.noi"),
        ("vacancy_20_debt_service", "data.scenarios.vacancy_20pct.debtService"),
        ("vacancy_20_dscr", "data.scenarios.vacancy_20pct.dscr"),
        ("vacancy_20_passes", "data.scenarios.vacancy_20pct.passes"),
        ("rent_decline_10_noi", "data.scenarios.rent_decline_10pct.noi"),
        ("rent_decline_10_debt_service", "data.scenarios.rent_decline_10pct.debtService"),
        ("rent_decline_10_dscr", "data.scenarios.rent_decline_10pct.dscr"),
        ("rent_decline_10_passes", "data.scenarios.rent_decline_10pct.passes"),
        ("all_scenarios_pass", "data.allScenariosPass"),
        ("computed_at", "data.computedAt"),
    )),
    _entry("axira.lending.gross_yield.computed.v1", "fact_lending_gross_yield", (
        ("deal_id", "data.dealId"),
        ("gross_yield_bps", "data.grossYieldBps"),
        ("sub_threshold_flag", "data.subThresholdFlag"),
        ("threshold_bps", "data.thresholdBps"),
        ("spread_bps", "data.components.spreadBps"),
        ("origination_fee_bps", "data.components.originationFeeBps"),
        ("exit_fee_bps", "data.components.exitFeeBps"),
        ("other_fees_bps", "data.components.otherFeesBps"),
        ("computed_at", "data.computedAt"),
    )),
    _entry("axira.lending.document.perfection_evaluated.v1", "fact_lending_doc_perfection", (
        ("deal_id", "data.dealId"),
        ("matrix", "data.matrix"),
        ("total_criteria", "data.totalCriteria"),
        ("criteria_passed", "data.criteriaPassed"),
        ("criteria_failed", "data.criteriaFailed"),
        ("all_documents_perfected", "data.allDocumentsPerfected"),
        ("evaluated_at", "data.evaluatedAt"),
    )),
    _entry("axira.studio.session.ended.v1", "fact_studio_session", (
        ("session_id", "data.sessionId"),
        ("session_event_type", "type"),
        ("deal_id", "data.dealId"),
        ("fact_user_id", "data.userId"),
        ("duration_ms", "data.durationMs"),
        ("branch_count", "data.branchCount"),
        ("branch_depth_max", "data.branchDepthMax"),
        ("chosen_branch_id", "data.chosenBranchId"),
        ("saved_as_quote", "data.savedAsQuote"),
        ("abandoned_branches", "data.abandonedBranches"),
        ("event_at", "data.endedAt"),
    )),
    _entry("axira.lending.fast_quote.preliminary_issued.v1", "fact_lending_fast_quote", (
        ("deal_id", "data.dealId"),
        ("fast_quote_event_type", "type"),
        ("preliminary_quote_usd", "data.preliminaryQuoteAmount"),
        ("fact_confidence", "data.confidence"),
        ("event_at", "data.issuedAt"),
    )),
    _entry("axira.lending.market.unrealistic_flagged.v1", "fact_lending_market", (
        ("deal_id", "data.dealId"),
        ("market_event_type", "type"),
        ("flagged_field", "data.flaggedField"),
        ("borrower_value", "data.borrowerValue"),
        ("market_value", "data.marketValue"),
        ("gap_absolute", "data.gap.absolute"),
        ("gap_pct", "data.gap.pct"),
        ("sources", "data.sources"),
        ("property_type", "data.propertyType"),
        ("event_at", "data.flaggedAt"),
    )),
    _entry("axira.lending.multiphase.detected.v1", "fact_lending_multiphase", (
        ("deal_id", "data.dealId"),
        ("multiphase_event_type", "type"),
        ("sub_type", "data.subType"),
        ("phase_count", "data.phaseCount"),
        ("total_units", "data.totalUnits"),
        ("event_at", "data.detectedAt"),
    )),
)
REGISTRY = {e.event_type: e for e in _ENTRIES}


VERSION_TYPE = T.StructType([T.StructField("event_time", T.TimestampType()), T.StructField("event_id", T.StringType())])


def merge_groups(table: str, registry=None) -> dict:
    """Column groups a table's MERGE entries update together.

    Columns listed by exactly the same set of MERGE event types form one
    group; each group carries a hidden version column ``_v_<types-hash>``
    holding (event_time, event_id) of the event that last set it, so a late
    arriving older event never overwrites a newer one (order independence).
    Returns ``{version_col: (columns, event_types)}``.
    """
    import hashlib
    registry = REGISTRY if registry is None else registry
    carriers: dict = {}
    for e in registry.values():
        if e.table == table and e.is_merge:
            for c in e.update_columns():
                carriers.setdefault(c, set()).add(e.event_type)
    groups: dict = {}
    for c, types in carriers.items():
        key = ",".join(sorted(types))
        vcol = "_v_" + hashlib.sha1(key.encode()).hexdigest()[:10]
        cols, _ = groups.setdefault(vcol, ([], tuple(sorted(types))))
        cols.append(c)
    return {k: (tuple(v[0]), v[1]) for k, v in groups.items()}


def make_registry(entries) -> dict:
    """Build a registry from ``FactDispatch`` objects (tests, testdata bindings)."""
    return {e.event_type: e for e in entries}


def load_order(event_types, registry=None) -> list:
    """Apply order inside a tick: INSERT types before MERGE types, then by name.

    Driver-side ordering over at most a few dozen type names (metadata only).
    """
    registry = REGISTRY if registry is None else registry
    known = [t for t in event_types if t in registry]
    return sorted(known, key=lambda t: (registry[t].is_merge, t))
