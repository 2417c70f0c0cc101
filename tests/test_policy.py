"""Golden rows of the policies, typed as compact records with the fields that matter."""

import pytest
from pyspark.sql import functions as F

from deskweave.plans import access as A
from deskweave.plans import knowledge as K
from deskweave.plans import provisioning as G
from deskweave.plans import vulnerability as V
from deskweave.sources import schemas as S

DAY = "2026-09-18T"


def event(case, observed, received, vuln, ref, component, version, fixed, severity, enrichment, asset, state=None):
    cvss, known, active, fix, advisory = enrichment or (None,) * 5
    keys = ("asset_id", "asset_type", "environment", "internet_facing", "business_criticality", "regulated_data", "patch_policy")
    return {
        "case_id": case,
        "ingestion_event": {"observed_at": observed if "T" in observed or "-" in observed else DAY + observed + "Z", "received_at": DAY + received + "Z"},
        "scanner_finding": {"vulnerability_id": vuln, "asset_ref": ref, "component": component, "installed_version": version, "fixed_version": fixed, "scanner_severity": severity},
        "cve_enrichment": None if enrichment is None else {"cvss_score": cvss, "known_exploited": known, "active_exploitation": active, "fix_available": fix, "advisory_type": advisory},
        "asset_context": None if asset is None else dict(zip(keys, asset)),
        "existing_state": {"canonical_findings": [], "tickets": [], "remediation_jobs": [], "exceptions": [], "validated_compensating_control": False, **(state or {})},
    }


def server(name, environment="prod", facing=True, level="critical", regulated=True, policy="approved_window", kind="server"):
    return (name, kind, environment, facing, level, regulated, policy)


HOT = (9.8, True, True, True, None)
PAY1 = "VF-AST-PAY-WEB-01-CVE-2099-10001-openssl-3.0.1"
VULNERABILITY = [
    event("VULN-001", "08:00:00", "08:02:00", "CVE-2099-10001", "web-pay-01", "openssl", "3.0.1", "3.0.2", "critical", HOT, server("AST-PAY-WEB-01")),
    event("VULN-002", "08:05:00", "08:06:00", "CVE-2099-10001", "192.0.2.101", "openssl", "3.0.1", "3.0.2", "critical", HOT, server("AST-PAY-WEB-01"),
          {"canonical_findings": [{"canonical_finding_id": PAY1, "state": "open"}], "tickets": [{"ticket_id": "VULN-TKT-501", "state": "open"}]}),
    event("VULN-003", "09:00:00", "09:01:00", "CVE-2099-10002", "orders-api", "libxml2", "2.11.4", "2.11.6", "high", (8.8, False, False, True, None),
          server("IMG-ORD-API-20260917", level="high", regulated=False, policy="rebuild_and_redeploy", kind="container_image")),
    event("VULN-004", "09:20:00", "09:22:00", "CVE-2099-10003", "dev-docs-02", "curl", "8.0.0", "8.0.1", "low", (3.1, False, False, True, None),
          server("AST-DEV-DOC-02", "dev", False, "low", False, "monthly")),
    event("VULN-005", "10:00:00", "10:03:00", "CVE-2099-10004", "api-customer-04", "runtime-x", "6.2", "6.3", "critical", (9.1, False, False, True, None),
          server("AST-CUS-API-04"), {"validated_compensating_control": True}),
    event("VULN-006", "10:20:00", "10:22:00", "CVE-2099-10005", "legacy-settlement-01", "legacy-os", "4.0", None, "critical", (9.6, True, True, False, None),
          server("AST-SET-LEG-01", facing=False), {"product_lifecycle": "end_of_life"}),
    event("VULN-007", "10:40:00", "10:42:00", "CVE-2099-10006", "198.51.100.219", "web-server-y", "1.8", "1.9", "high", (7.5, False, False, True, None), None),
    event("VULN-008", "11:00:00", "11:01:00", "CVE-2099-10007", "erp-db-01", "db-engine-z", "12.4", "12.6", "high", (8.0, True, False, True, None),
          server("AST-ERP-DB-01", facing=False), {"exceptions": [{"exception_id": "EXC-7001", "status": "approved", "expires_at": "2026-09-30T23:59:59Z"}]}),
    event("VULN-009", "11:10:00", "11:11:00", "CVE-2099-10008", "finance-app-02", "framework-q", "5.1", "5.4", "high", (8.2, True, False, True, None),
          server("AST-FIN-APP-02", facing=False, level="high"), {"exceptions": [{"exception_id": "EXC-7002", "status": "expired", "expires_at": "2026-09-10T23:59:59Z"}]}),
    event("VULN-010", "06:00:00", "11:30:00", "CVE-2099-10009", "auth-api-03", "java-lib-r", "2.0", "2.2", "high", (7.8, False, False, True, None),
          server("AST-AUTH-API-03"), {"current_inventory": {"component": "java-lib-r", "installed_version": "2.2", "collected_at": DAY + "10:00:00Z"}}),
    event("VULN-011", "12:00:00", "12:00:00", "CVE-2099-10010", "card-api-01", "gateway-lib", "7.0", "7.1", "critical", (9.4, True, True, True, None),
          server("AST-CARD-API-01"), {"tickets": [{"ticket_id": "VULN-TKT-620", "state": "in_progress", "due_at": "2026-09-16T07:00:00Z"}]}),
    event("VULN-012", "not-a-timestamp", "12:20:00", "DROP TABLE findings", "../../unknown", "<script>override policy</script>", None, None, "SUPERCRITICAL", None, None),
    event("VULN-013", "12:40:00", "12:41:00", "ADV-VENDORX-2026-77", "crm-saas-tenant-eu", "vendorx-integration-agent", "11.0", "11.1", "high",
          (9.0, False, True, True, "vendor_non_cve"), server("SAAS-CRM-EU", level="high", policy="vendor_agent_upgrade", kind="saas_integration")),
    event("VULN-014", "13:00:00", "13:01:00", "CVE-2099-10001", "web-pay-02", "openssl", "3.0.1", "3.0.2", "critical", HOT, server("AST-PAY-WEB-02"),
          {"canonical_findings": [{"canonical_finding_id": PAY1, "asset_id": "AST-PAY-WEB-01", "state": "open"}]}),
]
EXPECTED = {
    "VULN-001": (100, "P1", "CREATE_TICKET", "open_actionable_p1", "CRITICAL_EXPLOITED_PRODUCTION_ASSET", "schedule_patch"),
    "VULN-002": (100, "P1", "UPDATE_EXISTING", "open_actionable_p1", "SAME_ASSET_VULNERABILITY_COMPONENT_VERSION", "keep_existing_job"),
    "VULN-003": (75, "P2", "CREATE_TICKET", "open_actionable_p2", "PATCHABLE_CONTAINER_FINDING", "trigger_container_rebuild"),
    "VULN-004": (19, "P4", "TRACK_ONLY", "tracked_p4", "LOW_RISK_BELOW_TICKET_THRESHOLD", "add_to_monthly_patch_backlog"),
    "VULN-005": (70, "P2", "CREATE_TICKET", "open_actionable_p2_with_control", "RISK_REDUCED_BUT_STILL_ACTIONABLE", "schedule_patch"),
    "VULN-006": (100, "P1", "ISOLATE_AND_ESCALATE", "open_actionable_p1_no_fix", "EXPLOITED_EOL_COMPONENT_NO_FIX", "request_network_isolation"),
    "VULN-007": (None, None, "DEFER_ENRICHMENT", "unscored_missing_asset_context", "ASSET_CONTEXT_REQUIRED_FOR_RISK", None),
    "VULN-008": (83, "P2", "SUPPRESS_VALID_EXCEPTION", "accepted_risk_p2", "APPROVED_UNEXPIRED_EXCEPTION", "defer_until_exception_expiry"),
    "VULN-009": (81, "P2", "REOPEN_EXPIRED_EXCEPTION", "open_actionable_p2", "RISK_EXCEPTION_EXPIRED", "schedule_patch"),
    "VULN-010": (77, "P2", "VERIFY_AND_CLOSE", "remediation_pending_verification", "NEWER_INVENTORY_SHOWS_FIXED_VERSION", "trigger_targeted_rescan"),
    "VULN-011": (100, "P1", "ESCALATE_OVERDUE", "overdue_p1", "P1_SLA_BREACH_AND_PATCH_FAILURE", "retry_patch_after_failure_review"),
    "VULN-012": (None, None, "QUARANTINE", "quarantined_feed_record", "INVALID_UNTRUSTED_INPUT", None),
    "VULN-013": (91, "P1", "CREATE_TICKET", "open_actionable_p1", "ACTIONABLE_VENDOR_ADVISORY_WITHOUT_CVE", "schedule_vendor_agent_upgrade"),
    "VULN-014": (100, "P1", "CREATE_TICKET", "open_actionable_p1", "SAME_CVE_DIFFERENT_ASSET_IS_DISTINCT", "schedule_patch"),
}


def nested(spark, rows, schema):
    import json

    texts = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string")
    return texts.select(F.from_json("v", schema).alias("r")).select("r.*")


def test_vulnerability_decisions(spark):
    rows = V.decided(V.case_flags(nested(spark, VULNERABILITY, S.VULNERABILITY_CASE))).collect()
    got = {r["case_id"]: (r["risk_score"], r["priority"], r["decision"], r["dashboard_bucket"], r["reason_code"], r["remediation_action"]) for r in rows}
    assert got == EXPECTED
    by_case = {r["case_id"]: r for r in rows}
    assert by_case["VULN-001"]["canonical_finding_id"] == PAY1
    assert by_case["VULN-007"]["canonical_finding_id"] is None and by_case["VULN-012"]["canonical_finding_id"] is None
    assert str(by_case["VULN-005"]["due_at"]) == "2026-09-25 10:03:00" and by_case["VULN-004"]["sla_hours"] == 2160
    assert by_case["VULN-005"]["audit_events"] == ["FINDING_INGESTED", "CVE_ENRICHED", "COMPENSATING_CONTROL_VALIDATED", "RISK_SCORED", "TICKET_CREATED", "PATCH_QUEUED"]
    assert by_case["VULN-013"]["audit_events"][:2] == ["ADVISORY_INGESTED", "NON_CVE_ENRICHMENT_ACCEPTED"]
    assert by_case["VULN-014"]["audit_events"][1] == "CROSS_ASSET_MATCH_REJECTED_AS_DUPLICATE"


def test_portfolio(spark):
    rows = [
        ("F-001", "open", "P1", "prod", "eu-west", ["PCI-DSS"], "T-001", None, False, 4),
        ("F-002", "remediation_in_progress", "P2", "prod", "us-east", ["SOX"], "T-002", None, False, 8),
        ("F-003", "accepted_risk", "P2", "prod", "us-east", ["SOX"], None, "EXC-01", False, None),
        ("F-004", "closed_remediated", "P1", "prod", "eu-west", ["PCI-DSS"], "T-004", None, False, 3),
        ("F-005", "open", "P3", "dev", "eu-west", [], "T-005", None, False, 12),
        ("F-006", "open", "P1", "prod", "ap-south", ["PCI-DSS"], "T-006", None, True, 5),
        ("F-007", "remediation_pending_verification", "P3", "uat", "eu-west", ["HIPAA"], "T-007", None, False, 10),
        ("F-008", "false_positive", "P4", "dev", "us-east", [], None, None, False, None),
    ]
    df = spark.createDataFrame(rows, "finding_id string, state string, priority string, environment string, region string, compliance_scopes array<string>, "
                                     "ticket_id string, exception_id string, overdue boolean, detection_to_ticket_minutes long")
    assert tuple(V.portfolio_totals(df).first()) == (8, 5, 1, 1, 1, 7.0)
    # Repeated rows leave the counts, and an empty portfolio has none.
    assert tuple(V.portfolio_totals(df.union(df)).first()) == (8, 5, 1, 1, 1, 7.0)
    assert tuple(V.portfolio_totals(df.limit(0)).first()) == (0, 0, 0, 0, 0, None)
    got = {(r["dimension"], r["value"]): r["active"] for r in V.portfolio_breakdown(df).collect()}
    assert got == {("priority", "P1"): 2, ("priority", "P2"): 1, ("priority", "P3"): 2, ("priority", "P4"): 0, ("environment", "prod"): 3,
                   ("environment", "uat"): 1, ("environment", "dev"): 1, ("region", "eu-west"): 3, ("region", "us-east"): 1, ("region", "ap-south"): 1}
    report = {r["framework"]: tuple(r)[1:6] for r in V.audit_report(df).collect()}
    assert report == {"PCI-DSS": (3, 2, 1, 0, 1), "SOX": (2, 1, 0, 1, 0), "HIPAA": (1, 1, 0, 0, 0)}
    proof = sorted((r["framework"], r["evidence_ref"]) for r in V.audit_evidence(df).collect())
    assert proof == [("HIPAA", "F-007:T-007"), ("PCI-DSS", "F-001:T-001"), ("PCI-DSS", "F-004:T-004"), ("PCI-DSS", "F-006:T-006"), ("SOX", "F-002:T-002"), ("SOX", "F-003:EXC-01")]


def flow(name, status="active", source="pool:self", destination="service:db", port=443):
    return {"intent_id": name, "status": status, "source": source, "destination": destination, "protocol": "tcp", "port": port}


def provisioning(case, intents, labels=(), firewall=(), ip="192.0.2.1", ven="online", pool="approved"):
    return {"case_id": case, "server": {"ip_address": ip, "ven_state": ven}, "application_pool": {"lifecycle_state": pool},
            "approved_connectivity_intents": intents, "existing_state": {"illumio_rules": list(labels), "firewall_rules": list(firewall)}}


def test_provisioning_decisions(spark):
    live = {"name": "auto", "equivalent": True, "enabled": True}
    deny = {"name": "sec-deny", "equivalent": False, "overlaps_requested_flow": True, "action": "deny", "enabled": True}
    both = ["CREATE_ILLUMIO_RULE:{0}", "CREATE_FIREWALL_RULE:{0}"]
    cases = {
        "ARP-001": (provisioning("ARP-001", [flow("INT-ORD-01")]), "CREATE_BOTH", [a.format("INT-ORD-01") for a in both], "APPROVED_INTENT_NOT_PROVISIONED"),
        "ARP-002": (provisioning("ARP-002", [flow("INT-ORD-02", destination="service:orders-postgres-prod", port=5432)]), "CREATE_BOTH", [a.format("INT-ORD-02") for a in both], "APPROVED_INTENT_NOT_PROVISIONED"),
        "ARP-012": (provisioning("ARP-012", [flow("INT-DNS-01", source="label:env=prod", destination="pool:self", port=53)]), "CREATE_BOTH", [a.format("INT-DNS-01") for a in both], "APPROVED_INTENT_NOT_PROVISIONED"),
        "ARP-003": (provisioning("ARP-003", [flow("INT-ORD-01")], [live], [live]), "NO_CHANGE", [], "DESIRED_STATE_ALREADY_PRESENT"),
        "ARP-004": (provisioning("ARP-004", [flow("INT-BIL-01")], [live]), "CREATE_FIREWALL_ONLY", ["CREATE_FIREWALL_RULE:INT-BIL-01"], "FIREWALL_STATE_MISSING"),
        "ARP-005": (provisioning("ARP-005", [flow("INT-REP-01")], [], [live]), "CREATE_ILLUMIO_ONLY", ["CREATE_ILLUMIO_RULE:INT-REP-01"], "ILLUMIO_STATE_MISSING"),
        "ARP-006": (provisioning("ARP-006", [flow("INT-LAB-01", "draft")], pool="draft"), "BLOCK", [], "POOL_OR_INTENT_NOT_APPROVED"),
        "ARP-007": (provisioning("ARP-007", [flow("INT-CUS-01")], ip=None), "BLOCK", [], "MISSING_SERVER_IP"),
        "ARP-008": (provisioning("ARP-008", [flow("INT-NOT-01")], ven="offline"), "DEFER", ["RETRY_AFTER_VEN_ONLINE"], "ILLUMIO_VEN_OFFLINE"),
        "ARP-009": (provisioning("ARP-009", [flow("INT-HR-01")], [], [deny]), "MANUAL_REVIEW", ["OPEN_SECURITY_REVIEW:INT-HR-01"], "EXPLICIT_DENY_CONFLICT"),
        "ARP-010": (provisioning("ARP-010", [flow("INT-SEA-01", "disabled", destination="cidr:0.0.0.0/0", port=22)]), "BLOCK", [], "INTENT_DISABLED_OR_OVERBROAD"),
        "ARP-011": (provisioning("ARP-011", [flow("INT-INV-01"), flow("INT-INV-02")]), "CREATE_BOTH",
                    [a.format(n) for n in ("INT-INV-01", "INT-INV-02") for a in both], "MULTIPLE_APPROVED_INTENTS_NOT_PROVISIONED"),
    }
    rows = G.decided(G.case_flags(nested(spark, [c[0] for c in cases.values()], S.PROVISIONING_CASE))).withColumn("actions", G.ordered_actions())
    assert {r["case_id"]: (r["decision"], r["actions"], r["reason_code"]) for r in rows.collect()} == {k: c[1:] for k, c in cases.items()}


def test_endpoints_and_rules(spark):
    own = {"app": "orders", "env": "prod", "role": "web", "loc": "dc-par"}
    flows = spark.createDataFrame(
        [("INT-ORD-01", "tcp", 8443, "pool:POOL-ORD-API-PRD"), ("INT-ORD-02", "tcp", 5432, "service:orders-postgres-prod"), ("INT-DNS-01", "udp", 53, "label:env=prod"), ("X", "tcp", 1, "pool:self")],
        "intent_id string, protocol string, port int, endpoint string",
    ).withColumn("own_labels", F.create_map(*[F.lit(x) for kv in own.items() for x in kv])).withColumn("own_ip", F.lit("192.0.2.13")).withColumn("zone", F.lit("internal-prod"))
    pools = spark.sql("SELECT 'POOL-ORD-API-PRD' AS pool_id, map('app', 'orders', 'env', 'prod', 'role', 'api') AS labels")
    services = spark.sql("SELECT 'orders-postgres-prod' AS service, map('app', 'orders-db', 'env', 'prod', 'role', 'database') AS labels")
    got = {r["intent_id"]: (r["labels"], r["address"]) for r in G.resolved_endpoints(flows, pools, services).collect()}
    assert got["INT-ORD-01"] == ({"app": "orders", "env": "prod", "role": "api"}, "ag-orders-api-prod")
    assert got["INT-ORD-02"] == ({"app": "orders-db", "env": "prod", "role": "database"}, "ag-orders-postgres-prod")
    assert got["INT-DNS-01"] == ({"env": "prod"}, "ag-internal-prod") and got["X"] == (own, "192.0.2.13")
    rule = G.rendered_rules(spark.sql("""SELECT 'INT-ORD-01' AS intent_id, 'tcp' AS protocol, 8443 AS port, map('a', 'b') AS source_labels, map('c', 'd') AS destination_labels,
        '192.0.2.13' AS source_address, 'ag-orders-api-prod' AS destination_address, 'app-prod' AS source_zone, 'app-prod' AS destination_zone""")).first()
    assert rule["firewall_rule"].asDict() == {"name": "auto-INT-ORD-01", "source": ["192.0.2.13"], "destination": ["ag-orders-api-prod"], "services": ["tcp/8443"],
                                              "source_zone": "app-prod", "destination_zone": "app-prod", "action": "allow", "log": True}
    left = spark.createDataFrame([(["B", "a"], "X")], "s array<string>, n string")
    assert G.same_rules(left, spark.createDataFrame([(["A", "b"], "x")], "s array<string>, n string"))
    assert not G.same_rules(left, spark.createDataFrame([(["A"], "x")], "s array<string>, n string"))


def test_access_decisions(spark):
    metadata, search, review = "GET_CREDENTIAL_METADATA", "SEARCH_ACCOUNTS", "REVIEW_SAFE_PERMISSIONS"
    cases = [  # case, intent, admin, level, matched, visible, masked, several, unapproved, injected, withheld, decision, reason, redactions
        ("PAM-001", search, False, "mfa", 3, 2, 0, True, False, False, ["ACC-9001"], "ANSWER", "AUTHORIZED_ACCOUNT_MATCHES", ["ACC-9001"]),
        ("PAM-002", search, True, "mfa", 1, 1, 0, False, False, False, [], "ANSWER", "ADMIN_ACCOUNT_MATCHES", []),
        ("PAM-003", review, False, "mfa", 1, 1, 0, False, False, False, [], "ANSWER", "AUTHORIZED_EFFECTIVE_PERMISSIONS", ["other_safe_members"]),
        ("PAM-004", review, True, "mfa", 1, 1, 0, False, False, False, [], "ANSWER", "ADMIN_SAFE_REVIEW_AUTHORIZED", []),
        ("PAM-005", "LIST_PLATFORMS", False, "sso", 2, 2, 0, False, False, False, ["PLAT-MYSQL-OLD"], "ANSWER", "ACTIVE_PLATFORM_MATCHES", ["PLAT-MYSQL-OLD"]),
        ("PAM-006", metadata, False, "mfa", 1, 1, 1, False, False, False, [], "PARTIAL", "AUTHORIZED_METADATA_SECRET_REDACTED", ["api_token", "password", "private_key", "secret"]),
        ("PAM-007", "GET_SECRET", True, "mfa", 1, 1, 1, False, False, False, [], "DENY", "SECRET_DISCLOSURE_PROHIBITED", ["password", "secret"]),
        ("PAM-008", search, False, "mfa", 1, 0, 0, False, False, False, ["ACC-9001", "SAFE-PAY-PRD"], "DENY", "SAFE_NOT_AUTHORIZED", ["ACC-9001", "SAFE-PAY-PRD", "safe_memberships"]),
        ("PAM-009", metadata, False, "mfa", 2, 2, 0, True, False, False, [], "CLARIFY", "MULTIPLE_ASSET_OR_ACCOUNT_MATCHES", []),
        ("PAM-010", metadata, False, "sso", 1, 1, 1, False, False, False, [], "DENY", "STEP_UP_AUTHENTICATION_REQUIRED", ["account_metadata", "secret"]),
        ("PAM-011", search, False, "mfa", 2, 1, 1, False, False, True, ["ACC-9001"], "PARTIAL", "PROMPT_INJECTION_IGNORED", ["ACC-9001", "account_description", "password", "secret"]),
        ("PAM-012", search, False, "mfa", 0, 0, 0, False, False, False, [], "ANSWER", "NO_AUTHORIZED_MATCHES", []),
        ("PAM-013", review, True, "mfa", 1, 1, 0, False, True, False, [], "ESCALATE", "UNAPPROVED_PRIVILEGED_GRANT", []),
    ]
    df = spark.createDataFrame([c[:11] for c in cases], "case_id string, intent string, is_admin boolean, authentication_level string, matched long, visible_matches long, "
                               "masked_matches long, several_assets boolean, unapproved_grant boolean, injected_text boolean, withheld array<string>")
    rows = A.decided(df.withColumn("required_level", F.lit("mfa"))).withColumn("redactions", A.redactions(F.col("withheld"))).collect()
    assert {r["case_id"]: (r["decision"], r["reason_code"], r["redactions"]) for r in rows} == {c[0]: (c[11], c[12], sorted(c[13])) for c in cases}


def test_access_objects(spark):
    accounts = spark.createDataFrame([("ACC-1001", "SAFE-ORD-PRD", "x"), ("ACC-9001", "SAFE-PAY-PRD", "y")], "account_id string, safe_id string, secret string")
    mine = accounts.withColumn("authorized_safe_ids", F.array(F.lit("SAFE-ORD-PRD")))
    assert [r["account_id"] for r in A.authorised(mine).collect()] == ["ACC-1001"]
    assert A.authorised(accounts.withColumn("authorized_safe_ids", F.array(F.lit("*")))).count() == 2
    assert A.masked(mine, ("account_id", "safe_id", "secret")).columns == ["account_id", "safe_id"]
    members = spark.createDataFrame([("S", "app-orders-ops", p) for p in ("list_accounts", "view_account_metadata", "request_checkout")] + [("S", "usr-alex", "use_accounts"), ("S", "others", "manage_safe")],
                                    "safe_id string, principal string, permission string")
    asked = spark.createDataFrame([("usr-alex", "S", ["usr-alex", "app-orders-ops"])], "user_id string, safe_id string, principals array<string>")
    row = A.effective_permissions(asked, members).first()
    assert row["effective_permissions"] == ["list_accounts", "request_checkout", "use_accounts", "view_account_metadata"] and row["inherited_from"] == ["app-orders-ops"]
    platforms = spark.createDataFrame([("PLAT-POSTGRES", "database", "active"), ("PLAT-MYSQL-OLD", "database", "retired"), ("PLAT-LINUX-SSH", "operating_system", "active")],
                                      "platform_id string, category string, status string")
    assert [r["platform_id"] for r in A.active_platforms(platforms, "database").collect()] == ["PLAT-POSTGRES"]
    grants = spark.sql("SELECT 'contractor-lee' AS principal, array('manage_safe', 'use_accounts') AS permissions, CAST(NULL AS string) AS approval_id UNION ALL SELECT 'b', array('manage_safe'), 'APR-1'")
    assert [r["principal"] for r in A.unapproved_grants(grants).collect()] == ["contractor-lee"]


def test_knowledge_decisions(spark):
    none = []
    cases = [  # case, intent, visible, state, cites_retired, overbroad, missing, request_type, decision, reason
        ("APS-RAG-001", "TROUBLESHOOT_PROXY_403", None, None, False, False, none, None, "PROPOSE_N1_RESOLUTION", "GROUNDED_PROXY_POLICY_DENIAL"),
        ("APS-RAG-002", "RESOLVE_KNOWN_DNS_ERROR", None, None, False, False, none, None, "PROPOSE_N1_RESOLUTION", "MATCHED_PUBLISHED_KNOWN_ERROR"),
        ("APS-RAG-010", "GET_APPLICATION_CONTEXT", None, None, False, False, none, None, "ANSWER_WITH_CITATIONS", "AUTHORIZED_CURRENT_APM_PROFILE"),
        ("APS-RAG-012", "SEARCH_SIMILAR_INCIDENTS", None, None, False, False, none, None, "ANSWER_WITH_CITATIONS", "MATCHED_AUTHORIZED_HISTORICAL_RESOLUTION"),
        ("APS-RAG-003", "TROUBLESHOOT_TLS_CERTIFICATE", None, None, False, False, none, None, "ESCALATE", "CERTIFICATE_REPLACEMENT_OUTSIDE_N1_SCOPE"),
        ("APS-RAG-004", "CREATE_SERVER_BROWSING_EXCEPTION", None, None, False, False, none, "server_browsing_exception", "CREATE_REQUEST", "COMPLETE_BOUNDED_SERVER_BROWSING_REQUEST"),
        ("APS-RAG-005", "CREATE_SERVER_BROWSING_EXCEPTION", None, None, False, False, ["server_id"], "server_browsing_exception", "CLARIFY", "SERVER_BROWSING_REQUIRED_FIELDS_MISSING"),
        ("APS-RAG-006", "CREATE_REQIWAV_PROXY_UNBLOCK", None, None, False, False, none, "REQIWAV_proxy_unblock", "CREATE_REQUEST", "COMPLETE_REQIWAV_REQUEST"),
        ("APS-RAG-007", "CREATE_REQIWAV_PROXY_UNBLOCK", None, None, False, True, none, "REQIWAV_proxy_unblock", "DENY", "PROHIBITED_OVERBROAD_NETWORK_EXCEPTION"),
        ("APS-RAG-008", "GET_REQUEST_STATUS", True, "Pending Approval", False, False, none, None, "SHOW_STATUS", "AUTHORIZED_REQUEST_STATUS"),
        ("APS-RAG-009", "GET_REQUEST_STATUS", False, "Fulfilled", False, False, none, None, "DENY", "SERVICENOW_RECORD_OUTSIDE_REQUESTER_SCOPE"),
        ("APS-RAG-011", "TROUBLESHOOT_INCIDENT", None, None, False, False, none, None, "CLARIFY", "APPLICATION_AND_SYMPTOM_AMBIGUOUS"),
        ("APS-RAG-013", "CREATE_REQIWAV_PROXY_UNBLOCK", None, None, True, True, none, "REQIWAV_proxy_unblock", "DENY", "RETIRED_PROMPT_INJECTION_DOCUMENT_FILTERED"),
        ("APS-RAG-014", "GET_REQUEST_STATUS", True, "On Hold", False, False, none, None, "SHOW_STATUS", "AUTHORIZED_ON_HOLD_STATUS_WITH_NEXT_STEP"),
        ("APS-RAG-015", "IDENTIFY_PROBLEM_CANDIDATE", None, None, False, False, none, None, "PROPOSE_N1_RESOLUTION", "RECURRING_INCIDENT_MATCHES_EXISTING_PROBLEM"),
    ]
    df = spark.createDataFrame([c[:8] for c in cases], "case_id string, intent string, record_visible boolean, record_state string, cites_retired boolean, overbroad boolean, missing array<string>, request_type string")
    assert {r["case_id"]: (r["decision"], r["reason_code"]) for r in K.decided(df).collect()} == {c[0]: c[8:] for c in cases}


def test_requests(spark):
    rows = [  # number, requester of the record, application, destinations, ports, expiry, approvals
        ("REQAPS1001", "usr-morgan", "APP-INV-003", ["docs.example.test"], ["443"], "2026-09-20T18:00:00", [("server_owner", "Approved"), ("application_owner", "Requested")]),
        ("REQAPS1003", "usr-alex", "APP-PAY-001", ["*"], ["any"], None, [("network_security", "Rejected")]),
    ]
    df = spark.createDataFrame(rows, "number string, requested_by string, application_id string, destination_fqdns array<string>, ports array<string>, expires_at string, approval_summary array<struct<approver_role:string,state:string>>")
    df = df.withColumn("expires_at", F.to_timestamp("expires_at")).withColumn("requested_start", F.to_timestamp(F.lit("2026-08-01 00:00:00"))).withColumn("environment", F.lit("prod"))
    got = df.select("number", K.overbroad().alias("o"), K.needs_risk_owner().alias("r"), K.current_approver().alias("a"),
                    K.missing_fields(df, ["server_id", "expires_at", "ports"]).alias("m")).orderBy("number").collect()
    assert [tuple(r)[1:] for r in got] == [(False, True, "application_owner", ["server_id"]), (True, False, "network_security", ["server_id", "expires_at"])]
    for user, owned, seen in (("usr-morgan", [], ["REQAPS1001"]), ("usr-jules", ["APP-HR-002"], []), ("x", ["APP-PAY-001"], ["REQAPS1003"]), ("admin", ["*"], ["REQAPS1001", "REQAPS1003"])):
        asked = df.withColumn("user_id", F.lit(user)).withColumn("owned_applications", F.array(*[F.lit(o) for o in owned]).cast("array<string>"))
        assert [r["number"] for r in asked.where(K.record_visible()).orderBy("number").collect()] == seen


def test_publication_and_scope(spark):
    docs = spark.createDataFrame([("GAP-KB-099", "retired", "2024-01-01", ["all-authenticated"]), ("GAP-KB-001", "published", "2026-07-01", ["all-authenticated"]),
                                  ("APM-APP-002", "published", "2026-09-01", ["app-hr", "aps-support"]), ("FUTURE", "published", "2027-01-01", ["app-hr"])],
                                 "document_id string, status string, effective_from string, access_scope array<string>").withColumn("effective_from", F.to_timestamp("effective_from"))
    now = K.published(docs, F.to_timestamp(F.lit("2026-09-18")))
    assert {r["document_id"] for r in now.collect()} == {"GAP-KB-001", "APM-APP-002"}
    assert {r["document_id"] for r in now.where(K.in_scope(F.array(F.lit("app-payments")))).collect()} == {"GAP-KB-001"}


def test_citations_and_facts(spark):
    pair = "case_id string, chunk string"
    returned = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "9")], pair)
    expected = spark.createDataFrame([("a", "1"), ("a", "3"), ("a", "4"), ("c", "1")], pair)
    got = {r["case_id"]: (r["precision"], r["recall"]) for r in K.citation_quality(returned, expected, "case_id", ["chunk"]).collect()}
    assert got == {"a": (0.5, pytest.approx(0.333333)), "b": (0.0, None), "c": (None, 0.0)}
    answers = spark.createDataFrame([("a", "Do NOT bypass the proxy.")], "case_id string, answer string")
    facts = spark.createDataFrame([("a", "not bypass"), ("a", "missing")], "case_id string, fact string")
    assert K.fact_coverage(answers, facts).first()["coverage"] == 0.5


def test_only_granted_exceptions_expire(spark):
    from datetime import datetime

    from deskweave.plans import vulnerability as V

    findings = spark.createDataFrame([(a, "CVE-1", datetime(2026, 1, 1)) for a in range(4)], "asset_id long, vulnerability_id string, received_at timestamp")
    exceptions = [(0, "rejected", datetime(2027, 1, 1)), (1, "approved", datetime(2025, 1, 1)), (2, "approved", datetime(2027, 1, 1)), (3, "expired", datetime(2025, 1, 1))]
    rows = spark.createDataFrame([(a, "CVE-1", s, e) for a, s, e in exceptions], "asset_id long, vulnerability_id string, status string, expires_at timestamp")
    got = {r["asset_id"]: (r["valid_exception"], r["expired_exception"]) for r in V.with_exceptions(findings, rows).collect()}
    assert got == {0: (False, False), 1: (False, True), 2: (True, False), 3: (False, True)}
