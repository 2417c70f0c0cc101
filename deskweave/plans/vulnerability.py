"""Vulnerability findings: identity, risk, decision and portfolio reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.operators.joins import broadcast_if_small

# Fixed values of the policy.
CRITICALITY_POINTS = {"critical": 10, "high": 7, "medium": 3, "low": 0}
PRIORITY_BANDS = (("P1", 85, 24), ("P2", 70, 168), ("P3", 40, 720), ("P4", 0, 2160))
SEVERITIES = ("critical", "high", "medium", "low")
ID_PATTERN = r"^(CVE-\d{4}-\d{4,}|ADV-[A-Z0-9-]+)$"
ACTIONABLE_STATES = ("open", "remediation_in_progress", "remediation_pending_verification")
AUDIT_EVENTS = {
    "QUARANTINE": ("SCHEMA_VALIDATION_FAILED", "RECORD_QUARANTINED", "FEED_QUALITY_INCIDENT_CREATED"),
    "DEFER_ENRICHMENT": ("FINDING_INGESTED", "CVE_ENRICHED", "ASSET_MATCH_FAILED", "DATA_QUALITY_TASK_CREATED"),
    "SUPPRESS_VALID_EXCEPTION": ("FINDING_INGESTED", "CVE_ENRICHED", "RISK_SCORED", "VALID_EXCEPTION_APPLIED", "REVIEW_SCHEDULED"),
    "REOPEN_EXPIRED_EXCEPTION": ("FINDING_REOBSERVED", "RISK_SCORED", "EXCEPTION_EXPIRED", "TICKET_CREATED", "PATCH_QUEUED"),
    "VERIFY_AND_CLOSE": ("STALE_FINDING_RECEIVED", "NEWER_INVENTORY_EVIDENCE_FOUND", "TARGETED_RESCAN_REQUESTED"),
    "ESCALATE_OVERDUE": ("SLA_BREACH_DETECTED", "FAILED_REMEDIATION_CORRELATED", "TICKET_ESCALATED", "COMPLIANCE_OWNER_NOTIFIED"),
    "UPDATE_EXISTING": ("FINDING_DEDUPLICATED", "SOURCE_EVIDENCE_MERGED", "TICKET_UPDATED"),
    "ISOLATE_AND_ESCALATE": ("FINDING_INGESTED", "CVE_ENRICHED", "RISK_SCORED", "NO_FIX_IDENTIFIED", "TICKET_CREATED",
                             "ISOLATION_REQUESTED", "SECURITY_ESCALATED"),
    "TRACK_ONLY": ("FINDING_INGESTED", "CVE_ENRICHED", "RISK_SCORED", "BACKLOG_TRACKING_ADDED"),
}
REASONS = {
    "QUARANTINE": "INVALID_UNTRUSTED_INPUT",
    "DEFER_ENRICHMENT": "ASSET_CONTEXT_REQUIRED_FOR_RISK",
    "SUPPRESS_VALID_EXCEPTION": "APPROVED_UNEXPIRED_EXCEPTION",
    "REOPEN_EXPIRED_EXCEPTION": "RISK_EXCEPTION_EXPIRED",
    "VERIFY_AND_CLOSE": "NEWER_INVENTORY_SHOWS_FIXED_VERSION",
    "ESCALATE_OVERDUE": "P1_SLA_BREACH_AND_PATCH_FAILURE",
    "UPDATE_EXISTING": "SAME_ASSET_VULNERABILITY_COMPONENT_VERSION",
    "ISOLATE_AND_ESCALATE": "EXPLOITED_EOL_COMPONENT_NO_FIX",
    "TRACK_ONLY": "LOW_RISK_BELOW_TICKET_THRESHOLD",
}
TICKET_ACTIONS = {
    "QUARANTINE": "create_feed_quality_incident", "DEFER_ENRICHMENT": "create_data_quality_task",
    "REOPEN_EXPIRED_EXCEPTION": "create", "VERIFY_AND_CLOSE": "close_after_rescan", "ESCALATE_OVERDUE": "escalate",
    "UPDATE_EXISTING": "append_evidence", "ISOLATE_AND_ESCALATE": "create", "CREATE_TICKET": "create",
}
REMEDIATION_ACTIONS = {
    "SUPPRESS_VALID_EXCEPTION": "defer_until_exception_expiry", "REOPEN_EXPIRED_EXCEPTION": "schedule_patch",
    "VERIFY_AND_CLOSE": "trigger_targeted_rescan", "ESCALATE_OVERDUE": "retry_patch_after_failure_review",
    "UPDATE_EXISTING": "keep_existing_job", "ISOLATE_AND_ESCALATE": "request_network_isolation",
    "TRACK_ONLY": "add_to_monthly_patch_backlog",
}
PATCH_POLICY_ACTIONS = {"rebuild_and_redeploy": "trigger_container_rebuild", "vendor_agent_upgrade": "schedule_vendor_agent_upgrade"}


def _flag(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(False))


def _lookup(key: Column, values: dict) -> Column:
    chain = F
    for k, v in values.items():
        value = F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
        chain = chain.when(key == k, value)
    return chain


def malformed(df_columns: Sequence[str]) -> Column:
    """A record that cannot be trusted: bad time, unknown severity or an id outside the known forms."""
    bad = F.col("observed_at").try_cast("timestamp").isNull() | ~F.coalesce(F.col("vulnerability_id").rlike(ID_PATTERN), F.lit(False))
    if "scanner_severity" in df_columns:
        bad = bad | ~F.coalesce(F.col("scanner_severity").isin(*SEVERITIES), F.lit(False))
    return bad


def quarantine_split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)."""
    bad = malformed(findings.columns)
    return findings.where(~bad), findings.where(bad)


def canonical_id() -> Column:
    """Same asset, vulnerability, component and version is one finding; null if any part is unknown."""
    parts = [F.col(c).cast("string") for c in ("asset_id", "vulnerability_id", "component", "installed_version")]
    return F.concat(F.lit("VF-"), parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit("-"), parts[3])


def risk_score() -> Column:
    """0..100; null without asset context or a base score."""
    points = F.round(F.col("cvss_score") * 6).cast("int")
    for flag, value in (("known_exploited", 15), ("active_exploitation", 10), ("internet_facing", 10), ("regulated_data", 5),
                        ("validated_compensating_control", -15)):
        points = points + F.when(_flag(flag), value).otherwise(0)
    points = points + F.when(F.col("environment") == "prod", 5).otherwise(0)
    points = points + F.coalesce(_lookup(F.col("business_criticality"), CRITICALITY_POINTS), F.lit(0))
    return F.when(F.col("asset_id").isNotNull(), F.least(F.greatest(points, F.lit(0)), F.lit(100)))


def _band(score: Column, place: int) -> Column:
    chain = F
    for band in PRIORITY_BANDS:
        chain = chain.when(score >= band[1], F.lit(band[place]))
    return chain


def priority(score: str = "risk_score") -> Column:
    return _band(F.col(score), 0)


def sla_hours(score: str = "risk_score") -> Column:
    return _band(F.col(score), 2)


def due_at(received: Column) -> Column:
    return received + F.make_dt_interval(F.lit(0), F.col("sla_hours"))


def assessed(findings: DataFrame) -> DataFrame:
    """Findings with asset columns: trust, identity, score, priority, time limit."""
    rows = findings.withColumn("malformed", malformed(findings.columns))
    rows = rows.withColumns({
        "canonical_finding_id": F.when(~F.col("malformed"), canonical_id()), "risk_score": F.when(~F.col("malformed"), risk_score())})
    rows = rows.withColumns({"priority": priority(), "sla_hours": sla_hours()})
    return rows.withColumn("due_at", due_at(F.col("received_at")))


def case_flags(cases: DataFrame) -> DataFrame:
    """Flat, assessed rows with decision flags from nested workflow events (see ``VULNERABILITY_CASE``)."""
    state = F.col("existing_state")
    flat = cases.select(
        "case_id",
        F.col("ingestion_event.observed_at").alias("observed_at"),
        F.col("ingestion_event.received_at").try_cast("timestamp").alias("received_at"),
        "scanner_finding.*", "cve_enrichment.*", "asset_context.*",
        F.coalesce(state["validated_compensating_control"], F.lit(False)).alias("validated_compensating_control"),
        state.alias("_state"),
    )
    rows = assessed(flat)
    inventory, known = F.col("_state.current_inventory"), F.col("_state.canonical_findings")

    def at(value: Column) -> Column:
        return value.try_cast("timestamp")

    def some(items: Column, test) -> Column:
        return F.coalesce(F.exists(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))

    exceptions, received = F.col("_state.exceptions"), F.col("received_at")
    same = F.concat(F.lit("-"), F.col("vulnerability_id"), F.lit("-"))
    return rows.withColumns({
        "valid_exception": some(exceptions, lambda e: (e["status"] == "approved") & (at(e["expires_at"]) > received)),
        "expired_exception": some(exceptions, lambda e: at(e["expires_at"]) <= received),
        "fixed_in_inventory": (at(inventory["collected_at"]) > at(F.col("observed_at"))) & (inventory["installed_version"] == F.col("fixed_version")),
        "overdue": some(F.col("_state.tickets"), lambda t: at(t["due_at"]) < received),
        "known_finding": some(known, lambda k: k["canonical_finding_id"] == F.col("canonical_finding_id")),
        "other_asset_known": some(known, lambda k: (k["canonical_finding_id"] != F.col("canonical_finding_id")) & F.contains(k["canonical_finding_id"], same)),
        "no_fix": ~F.coalesce(F.col("fix_available"), F.lit(True)) & (F.col("_state.product_lifecycle") == "end_of_life"),
    }).drop("_state")


def decided(cases: DataFrame) -> DataFrame:
    """First matching rule wins.

    Expects ``priority`` and the flags malformed, valid_exception, expired_exception, fixed_in_inventory,
    overdue, known_finding; optional: no_fix, asset_type, patch_policy, advisory_type, other_asset_known.
    """
    have = set(cases.columns)
    chain = (
        F.when(_flag("malformed"), "QUARANTINE")
        .when(F.col("asset_id").isNull(), "DEFER_ENRICHMENT")
        .when(_flag("valid_exception"), "SUPPRESS_VALID_EXCEPTION")
        .when(_flag("expired_exception"), "REOPEN_EXPIRED_EXCEPTION")
        .when(_flag("fixed_in_inventory"), "VERIFY_AND_CLOSE")
        .when(_flag("overdue"), "ESCALATE_OVERDUE")
        .when(_flag("known_finding"), "UPDATE_EXISTING")
        .when(_flag("no_fix"), "ISOLATE_AND_ESCALATE")
        .when(F.col("priority") == "P4", "TRACK_ONLY")
        .otherwise("CREATE_TICKET")
    )
    optional = {"asset_type": F.lit("server"), "patch_policy": F.lit(None).cast("string"), "advisory_type": F.lit(None).cast("string"),
                "other_asset_known": F.lit(False)}
    rows = cases.withColumns({"decision": chain, **{n: d for n, d in optional.items() if n not in have}})
    patch = F.coalesce(_lookup(F.col("patch_policy"), PATCH_POLICY_ACTIONS), F.lit("schedule_patch"))
    return rows.withColumns({
        "dashboard_bucket": _bucket(),
        "reason_code": _reason(),
        "audit_events": _audit_events(),
        "ticket_action": _lookup(F.col("decision"), TICKET_ACTIONS),
        "remediation_action": F.when(F.col("decision") == "CREATE_TICKET", patch).otherwise(_lookup(F.col("decision"), REMEDIATION_ACTIONS)),
    }).drop(*[n for n in optional if n not in have])


def _bucket() -> Column:
    level = F.lower(F.col("priority"))
    decision = F.col("decision")
    return (
        F.when(decision == "QUARANTINE", "quarantined_feed_record")
        .when(decision == "DEFER_ENRICHMENT", "unscored_missing_asset_context")
        .when(decision == "SUPPRESS_VALID_EXCEPTION", F.concat(F.lit("accepted_risk_"), level))
        .when(decision == "VERIFY_AND_CLOSE", "remediation_pending_verification")
        .when(decision == "ESCALATE_OVERDUE", F.concat(F.lit("overdue_"), level))
        .when(decision == "ISOLATE_AND_ESCALATE", F.concat(F.lit("open_actionable_"), level, F.lit("_no_fix")))
        .when(decision == "TRACK_ONLY", F.concat(F.lit("tracked_"), level))
        .when((decision == "CREATE_TICKET") & _flag("validated_compensating_control"), F.concat(F.lit("open_actionable_"), level, F.lit("_with_control")))
        .otherwise(F.concat(F.lit("open_actionable_"), level))
    )


def _reason() -> Column:
    """Stable code per decision; a new ticket's code says what kind of finding it is (null if none applies)."""
    ticket = (
        F.when(F.col("asset_type") == "container_image", "PATCHABLE_CONTAINER_FINDING")
        .when(_flag("validated_compensating_control"), "RISK_REDUCED_BUT_STILL_ACTIONABLE")
        .when(F.col("advisory_type") == "vendor_non_cve", "ACTIONABLE_VENDOR_ADVISORY_WITHOUT_CVE")
        .when(_flag("other_asset_known"), "SAME_CVE_DIFFERENT_ASSET_IS_DISTINCT")
        .when((F.col("priority") == "P1") & (F.col("environment") == "prod"), "CRITICAL_EXPLOITED_PRODUCTION_ASSET")
    )
    return F.when(F.col("decision") == "CREATE_TICKET", ticket).otherwise(_lookup(F.col("decision"), REASONS))


def _audit_events() -> Column:
    advisory = F.col("advisory_type") == "vendor_non_cve"
    start = F.when(advisory, F.array(F.lit("ADVISORY_INGESTED"), F.lit("NON_CVE_ENRICHMENT_ACCEPTED"))).when(
        _flag("other_asset_known"), F.array(F.lit("FINDING_INGESTED"), F.lit("CROSS_ASSET_MATCH_REJECTED_AS_DUPLICATE"))
    ).otherwise(F.array(F.lit("FINDING_INGESTED"), F.lit("CVE_ENRICHED")))
    control = F.when(_flag("validated_compensating_control"), F.array(F.lit("COMPENSATING_CONTROL_VALIDATED"))).otherwise(F.array().cast("array<string>"))
    work = F.when(F.col("asset_type") == "container_image", "CONTAINER_REBUILD_QUEUED").when(advisory, "OWNER_APPROVAL_REQUESTED").otherwise("PATCH_QUEUED")
    ticket = F.concat(start, control, F.array(F.lit("RISK_SCORED"), F.lit("TICKET_CREATED"), work))
    return F.when(F.col("decision") == "CREATE_TICKET", ticket).otherwise(_lookup(F.col("decision"), AUDIT_EVENTS))


def matched_assets(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset columns by hostname or address: one equi-join on the unpivoted names; no match leaves nulls."""
    names = F.filter(F.array_distinct(F.array("hostname", "ip_address")), lambda n: n.isNotNull())
    rest = [c for c in assets.columns if c not in ("hostname", "ip_address")]
    by_name = assets.select(F.explode(names).alias("_name"), F.struct(*rest).alias("_asset"))
    by_name = by_name.groupBy("_name").agg(F.min("_asset").alias("_asset"))
    joined = findings.join(broadcast_if_small(by_name), F.col("asset_ref") == F.col("_name"), "left")
    return joined.select(*findings.columns, *[F.col(f"_asset.{c}").alias(c) for c in rest])


def enriched(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """Trusted vulnerability intelligence by id; nulls where there is none."""
    return findings.join(advisories, "vulnerability_id", "left")


def with_exceptions(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Flags for an approved exception still running at receipt, and for one that has run out.

    An exception that was never granted (rejected, requested, withdrawn) is neither. Exceptions are first reduced to one row per (asset, vulnerability), so the join never multiplies rows.
    """
    granted = exceptions.where((F.col("status") == "expired") | (F.col("status") == "approved") & F.col("expires_at").isNotNull())
    scope = granted.groupBy("asset_id", "vulnerability_id").agg(
        F.max(F.when(F.col("status") == "approved", F.col("expires_at"))).alias("_until"), F.count(F.lit(1)).alias("_any")
    )
    joined = findings.join(broadcast_if_small(scope), ["asset_id", "vulnerability_id"], "left")
    valid = F.coalesce(F.col("received_at") < F.col("_until"), F.lit(False))
    return joined.withColumn("valid_exception", valid).withColumn(
        "expired_exception", F.col("_any").isNotNull() & ~valid
    ).drop("_until", "_any")


def newest_evidence(observations: DataFrame, inventory: DataFrame, keys: Sequence[str], observed: str, collected: str, version: str) -> DataFrame:
    """Joins the newest inventory row per key and tells whether it is younger than the observation."""
    newest = inventory.groupBy(*keys).agg(
        F.max(F.struct(collected, version)).alias("_new")
    ).select(*keys, F.col(f"_new.{collected}").alias("evidence_at"), F.col(f"_new.{version}").alias("evidence_version"))
    joined = observations.join(newest, list(keys), "left")
    return joined.withColumn("newer_evidence", F.coalesce(F.col("evidence_at") > F.col(observed), F.lit(False)))


def finding_sources(findings: DataFrame) -> DataFrame:
    """(canonical id, source) pairs without repeats: the source list of a finding in rows, of any length."""
    return findings.where(F.col("canonical_finding_id").isNotNull()).select(
        "canonical_finding_id", F.concat_ws(":", "scanner_id", F.col("event_id").cast("string")).alias("source")
    ).distinct()


def deduplicated(findings: DataFrame) -> DataFrame:
    """One row per canonical finding; its sources are the rows of ``finding_sources``.

    Scanners are folded first, so a finding reported without end still costs one row per task and scanner.
    """
    named = findings.where(F.col("canonical_finding_id").isNotNull())
    per_scanner = named.groupBy("canonical_finding_id", "scanner_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("received_at").alias("_first"), F.max("risk_score").alias("_risk")
    )
    return per_scanner.groupBy("canonical_finding_id").agg(
        F.sum("_n").alias("observations"),
        F.count(F.lit(1)).alias("scanners"),
        F.min("_first").alias("first_received_at"),
        F.max("_risk").alias("risk_score"),
    )


def workload(decisions: DataFrame) -> DataFrame:
    """Counts by decision and priority with all subtotals; grouping flags tell subtotals from nulls."""
    return decisions.cube("decision", "priority").agg(
        F.count(F.lit(1)).alias("findings"), F.grouping("decision").alias("all_decisions"), F.grouping("priority").alias("all_priorities")
    )


def _active() -> Column:
    return F.col("state").isin(*ACTIONABLE_STATES)


def portfolio_totals(findings: DataFrame) -> DataFrame:
    """Findings by id, however often a row repeats one: an id counts in every state that a row of it has.

    The mean is over all rows with a ticket. Rows without an id are in the mean only.
    """
    each = findings.groupBy("finding_id").agg(
        F.bool_or(_active()).alias("active"),
        F.bool_or(_active() & F.col("overdue")).alias("late"),
        F.bool_or(F.col("state") == "accepted_risk").alias("accepted"),
        F.bool_or(F.col("state") == "closed_remediated").alias("closed"),
        F.sum("detection_to_ticket_minutes").alias("minutes"),
        F.count("detection_to_ticket_minutes").alias("tickets"),
    )
    named = F.col("finding_id").isNotNull()
    return each.agg(
        F.count("finding_id").alias("total_unique_findings"),
        F.count_if(named & F.col("active")).alias("active_actionable_findings"),
        F.count_if(named & F.col("late")).alias("overdue_active_findings"),
        F.count_if(named & F.col("accepted")).alias("accepted_risk_findings"),
        F.count_if(named & F.col("closed")).alias("closed_remediated_findings"),
        F.round(F.try_divide(F.sum("minutes").cast("double"), F.sum("tickets")), 6).alias("mean_detection_to_ticket_minutes"),
    )


def portfolio_breakdown(findings: DataFrame) -> DataFrame:
    """Active findings by priority, environment and region; priorities without findings count zero."""
    dimensions = ("priority", "environment", "region")
    sets = findings.where(_active()).groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.count(F.lit(1)).alias("active"), *[F.grouping(d).alias(f"_no_{d}") for d in dimensions]
    )
    name, value = F, F
    for d in dimensions:
        name = name.when(F.col(f"_no_{d}") == 0, d)
        value = value.when(F.col(f"_no_{d}") == 0, F.col(d))
    rows = sets.select(name.alias("dimension"), value.alias("value"), "active")
    zeros = findings.sparkSession.createDataFrame([("priority", band[0], 0) for band in PRIORITY_BANDS], "dimension string, value string, active bigint")
    return rows.unionByName(zeros).groupBy("dimension", "value").agg(F.sum("active").alias("active"))


def _scoped(findings: DataFrame) -> DataFrame:
    return findings.withColumn("framework", F.explode("compliance_scopes")).where(F.col("framework") != "")


def audit_report(findings: DataFrame) -> DataFrame:
    """Counts per compliance framework; the evidence lists are rows of ``audit_evidence``."""
    return _scoped(findings).groupBy("framework").agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(_active()).alias("active_actionable"),
        F.count_if(_active() & F.col("overdue")).alias("overdue"),
        F.count_if(F.col("state") == "accepted_risk").alias("accepted_risk"),
        F.count_if(F.col("state") == "closed_remediated").alias("closed_remediated"),
        F.count(F.coalesce("ticket_id", "exception_id")).alias("evidence_rows"),
    )


def audit_evidence(findings: DataFrame) -> DataFrame:
    """One row per framework and evidence reference, so a framework may have any number of them."""
    proof = F.coalesce("ticket_id", "exception_id")
    return _scoped(findings).where(proof.isNotNull()).select(
        "framework", F.concat_ws(":", "finding_id", proof).alias("evidence_ref")
    )
